"""Flow fields: aggregates of paths over edges, residuals, and basis bookkeeping.

``field`` is (e, value); ``paths`` is (path_id, pos, e, value); a basis is (b, pos, e) with
``coefs`` (b, coef).  Sums by edge combine before their shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut

#: Classes of equal rows, and (row, edge) pairs, that are broadcast at most; beyond, the joins shuffle.
MOST_CLASSES, MOST_SHARED = 100_000, 500_000
#: (row, edge) pairs of a task of products.
DEALT = 1000


def field_from_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Each edge gets the value of a path as often as the path takes it; others are 0."""
    total = paths.groupBy("e").agg(F.sum("value").alias("value"))
    return edges.select("e").join(total, "e", "left").select("e", F.coalesce("value", F.lit(0.0)).alias("value"))


def paths_from_sets(trajectories: DataFrame) -> DataFrame:
    """Edge trajectories (traj_id, edges) as paths of value 1."""
    d = trajectories.select(F.col("traj_id").alias("path_id"), F.posexplode("edges").alias("pos", "e"))
    return d.select("path_id", F.col("pos").cast("long"), "e", F.lit(1.0).alias("value"))


def multiplicity(basis: DataFrame) -> DataFrame:
    """(b, e, mult): how often a basis path takes an edge."""
    return basis.groupBy("b", "e").agg(F.count("*").alias("mult"))


def decomposition_field(edges: DataFrame, basis: DataFrame, coefs: DataFrame) -> DataFrame:
    total = basis.join(coefs, "b").groupBy("e").agg(F.sum("coef").alias("value"))
    return edges.select("e").join(total, "e", "left").select("e", F.coalesce("value", F.lit(0.0)).alias("value"))


def residual(field: DataFrame, basis: DataFrame, coefs: DataFrame) -> DataFrame:
    """Field minus what the weighted basis explains."""
    explained = basis.join(coefs, "b").groupBy("e").agg(F.sum("coef").alias("explained"))
    return field.join(explained, "e", "left").select("e", (F.col("value") - F.coalesce("explained", F.lit(0.0))).alias("value"))


def square_length(field: DataFrame) -> DataFrame:
    """One row: the sum of squares (0 for an empty field); of a residual, the objective."""
    return field.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("objective"))


def field_stats(field: DataFrame) -> DataFrame:
    v = F.col("value")
    zero = F.lit(0.0)
    return field.agg(
        F.coalesce(F.min(v), zero).alias("min_value"),
        F.coalesce(F.max(v), zero).alias("max_value"),
        F.coalesce(F.avg(v), zero).alias("avg_value"),
        F.count("*").alias("n_edges"),
    )


def terminals(paths: DataFrame) -> DataFrame:
    """(kind, v): distinct first sources and last sinks of the paths."""
    ends = paths.groupBy("path_id").agg(F.min_by("src", "pos").alias("source"), F.max_by("dst", "pos").alias("sink"))
    kinds = F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("v")), F.struct(F.lit("sink").alias("kind"), F.col("sink").alias("v")))
    return ends.select(F.explode(kinds).alias("k")).select("k.kind", "k.v").distinct()


def net_flow(edges: DataFrame, flow: DataFrame) -> DataFrame:
    """(v, net): out minus in for every vertex of an edge."""
    d = edges.join(flow, "e")
    both = F.array(F.struct(F.col("src").alias("v"), F.col("value").alias("f")), F.struct(F.col("dst").alias("v"), (-F.col("value")).alias("f")))
    return d.select(F.explode(both).alias("k")).groupBy("k.v").agg(F.sum("k.f").alias("net"))


def flow_violations(edges: DataFrame, flow: DataFrame, sources: DataFrame, sinks: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Vertices that break conservation: sources may only send, sinks only take, others neither."""
    s = sources.select("v").distinct().withColumn("is_source", F.lit(True))
    t = sinks.select("v").distinct().withColumn("is_sink", F.lit(True))
    d = net_flow(edges, flow).join(s, "v", "left").join(t, "v", "left")
    src, snk = F.coalesce("is_source", F.lit(False)), F.coalesce("is_sink", F.lit(False))
    bad = ((F.col("net") > tolerance) & ~src) | ((F.col("net") < -tolerance) & ~snk)
    return d.where(bad).select("v", "net")


def demand_supply(edges: DataFrame, flow: DataFrame, terminal: DataFrame) -> DataFrame:
    """(v, supply, demand) of the terminal vertices."""
    d = net_flow(edges, flow).join(terminal.select("v").distinct(), "v", "left_semi")
    return d.select("v", F.greatest("net", F.lit(0.0)).alias("supply"), F.greatest(-F.col("net"), F.lit(0.0)).alias("demand"))


def degeneracy(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: distinct (path, edge) pairs in total, a mean edge, and the least and most of an edge."""
    cover = paths.select("path_id", "e").distinct().groupBy("e").agg(F.count("*").alias("n"))
    d = edges.select("e").join(cover, "e", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return d.agg(F.sum("n").alias("total"), F.avg("n").alias("average"), F.min("n").alias("least"), F.max("n").alias("most"))


def prune(coefs: DataFrame, least: float = 1e-5) -> DataFrame:
    return coefs.where(F.col("coef") >= least)


def prune_sorted(coefs: DataFrame, least: float = 1e-5) -> DataFrame:
    """Legacy form: order by coefficient, cut at the first below ``least``."""
    return by_coefficient(prune(coefs, least))


def by_coefficient(coefs: DataFrame) -> DataFrame:
    return coefs.orderBy(F.desc("coef"), "b")


def top_weighted(coefs: DataFrame, n: int) -> DataFrame:
    """The n largest coefficients, smallest first.

    Coefficients enter in the order of b; a larger one replaces the lowest b among the
    smallest, an equal one does not enter when n are held.  So of those that equal the
    n-th largest, the ones among the first n rows that are as large come into question, and
    each larger coefficient takes the place of the lowest b.  TakeOrdered keeps n rows a task.
    """
    got = by_coefficient(coefs).limit(n).agg(F.count("*").alias("n"), F.min("coef").alias("least"))
    above = coefs.join(F.broadcast(got), F.col("coef") >= F.col("least"))  # one row
    entered = above.orderBy("b").limit(n).where("coef = least")
    larger = above.where("coef > least")
    room = larger.agg(F.count("*").alias("taken"))  # fewer than n
    ranked = entered.withColumn("place", F.row_number().over(Window.orderBy(F.desc("b"))))  # n rows at most
    kept = ranked.join(F.broadcast(room), F.col("place") <= F.lit(n) - F.col("taken"))
    return larger.select(*coefs.columns).unionByName(kept.select(*coefs.columns)).orderBy("coef", "b")


def extend_basis(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def residual_order(field: DataFrame) -> DataFrame:
    """Edges to hit, the largest residual first; negative ones are left out."""
    return field.where("value >= 0").orderBy(F.desc("value"), "e")


def histogram(rows: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of equal widths; values outside fall into the first or last bin."""
    b = F.least(F.greatest(F.floor((value - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def mean(rows: DataFrame, value: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def weighted_distortion(rows: DataFrame) -> DataFrame:
    """(distortion, weight) of (value, weight) rows."""
    return rows.agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("distortion"), F.sum("weight").alias("weight"))


def representatives(paths: DataFrame, ids: DataFrame) -> DataFrame:
    return paths.join(ids.select("path_id"), "path_id", "left_semi")


def is_same_path(a: Column, b: Column) -> Column:
    """Ordered equality of edge lists."""
    return a == b


def trivial_basis(edges: DataFrame, size: int = 1) -> DataFrame:
    """(b, edges array): every walk of ``size`` edges."""
    walk = edges.select(F.array("e").alias("edges"), F.col("dst").alias("at"))
    for _ in range(size - 1):
        nxt = edges.select(F.col("src").alias("at"), F.col("e").alias("next"), F.col("dst").alias("to"))
        walk = walk.join(nxt, "at").select(F.concat("edges", F.array("next")).alias("edges"), F.col("to").alias("at"))
    return walk.select((F.get("edges", F.lit(0)) if size == 1 else F.xxhash64("edges")).alias("b"), "edges")


def gram(basis: DataFrame, field: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normal equations of the basis: (b1, b2, dot) and (b, dot) with the field."""
    m = multiplicity(basis)
    other = m.select(F.col("b").alias("b2"), "e", F.col("mult").alias("mult2"))
    a = m.withColumnRenamed("b", "b1").join(other, "e").where("b1 <= b2")
    a = a.groupBy("b1", "b2").agg(F.sum(F.col("mult") * F.col("mult2")).alias("dot"))
    rhs = m.join(field, "e").groupBy("b").agg(F.sum(F.col("mult") * F.col("value")).alias("dot"))
    return a, rhs


def same_basis(basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(b, rep): the least row of the basis that takes the same edges as often; and (rep, es) of these rows with their edges.

    Both are tables: the basis is computed once, and rows that agree combine before their shuffle.
    """
    d = cut(basis.groupBy("b").agg(F.array_sort(F.collect_list("e")).alias("es")))
    classes = cut(d.groupBy("es").agg(F.min("b").alias("rep")))
    return d.join(_small(classes, MOST_CLASSES), "es").select("b", "rep"), classes


def _small(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def gram_by_class(basis: DataFrame, field: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(b1, b2, dot) of the representatives of ``same_basis``, and (b, rep): the product of two rows is that of their representatives.

    The rows b1 are dealt out with all their edges, so that the products are summed where they
    arise; they are many more than the rows, and would be shuffled by both ends otherwise.
    """
    same, classes = same_basis(basis)
    m = cut(multiplicity(classes.select(F.col("rep").alias("b"), F.explode("es").alias("e"))))
    parts = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(m.count() / DEALT))
    other = m.select(F.col("b").alias("b2"), "e", F.col("mult").alias("mult2"))
    a = m.withColumnRenamed("b", "b1").repartition(parts, "b1").join(_small(other, MOST_SHARED), "e").where("b1 <= b2")
    return a.groupBy("b1", "b2").agg(F.sum(F.col("mult") * F.col("mult2")).alias("dot")), same
