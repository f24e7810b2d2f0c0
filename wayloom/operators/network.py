"""Road networks as tables: degrees, subgraphs, path checks and reachability.

``vertices`` is (v, x, y), ``edges`` (e, src, dst, length), ``paths`` (path_id, pos, e).
Searches advance frontier by frontier as joins; the number of rounds is bounded and only
counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..store import cut

#: Hops beyond which a vertex counts as out of reach.
FAR = 2**31 - 4


def by_path() -> Window:
    return Window.partitionBy("path_id").orderBy("pos")


def with_lengths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with end points and Euclidean length."""
    a = vertices.select(F.col("v").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select(F.col("v").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = edges.drop("length", "x1", "y1", "x2", "y2").join(a, "src").join(b, "dst")
    return d.withColumn("length", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def is_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The (src, dst) pairs that are edges."""
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    v = nodes.select("v")
    return edges.join(v.withColumnRenamed("v", "src"), "src", "left_semi").join(v.withColumnRenamed("v", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("k")).groupBy("k.v").agg(F.sum("k.o").alias("out_degree"), F.sum("k.i").alias("in_degree"))


def remove_dead_ends(vertices: DataFrame, edges: DataFrame, source: int, sink: int) -> tuple[DataFrame, DataFrame]:
    """One pass: vertices without a way in (but the source) or out (but the sink) go; ids become dense."""
    d = vertices.join(degrees(edges), "v", "left").na.fill(0, ["out_degree", "in_degree"])
    kept = d.where(((F.col("in_degree") > 0) | (F.col("v") == source)) & ((F.col("out_degree") > 0) | (F.col("v") == sink)))
    number = (F.row_number().over(Window.orderBy("v")) - 1).cast("long")  # dense ids need one order of all vertices
    kept = kept.select("v", "x", "y", number.alias("new_v"))
    left = kept.select(F.col("v").alias("src"), F.col("new_v").alias("new_src"))
    right = kept.select(F.col("v").alias("dst"), F.col("new_v").alias("new_dst"))
    return kept, edges.join(left, "src").join(right, "dst").select("e", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def broken_links(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, pos): places where an edge does not end where the next begins."""
    d = paths.select("path_id", "pos", "e").join(edges.select("e", "src", "dst"), "e")
    d = d.withColumn("next", F.lead("src").over(by_path()))
    return d.where("next IS NOT NULL AND next <> dst").select("path_id", "pos")


def path_vertices(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, pos, v): the first edge's source, then every sink."""
    d = paths.select("path_id", "pos", "e").join(edges.select("e", "src", "dst"), "e")
    head = d.groupBy("path_id").agg(F.min_by("src", "pos").alias("v")).select("path_id", F.lit(0).cast("long").alias("pos"), "v")
    return head.unionByName(d.select("path_id", (F.col("pos") + 1).alias("pos"), F.col("dst").alias("v")))


def path_polyline(paths: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(traj_id, pos, x, y): the line that a path of edges draws."""
    return path_vertices(paths, edges).join(vertices, "v").select(F.col("path_id").cast("string").alias("traj_id"), "pos", "x", "y")


def vertex_path_edges(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, pos, e) of a path of vertices (path_id, pos, v); of parallel edges the lowest id."""
    step = walks.withColumn("dst", F.lead("v").over(by_path())).where("dst IS NOT NULL").withColumnRenamed("v", "src")
    one = edges.groupBy("src", "dst").agg(F.min("e").alias("e"))
    return step.join(one, ["src", "dst"]).select("path_id", "pos", "e")


def path_shape(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, simple, edge_disjoint): no vertex, or no edge, twice."""
    v = path_vertices(paths, edges).groupBy("path_id").agg((F.count("v") == F.count_distinct("v")).alias("simple"))
    e = paths.groupBy("path_id").agg((F.count("e") == F.count_distinct("e")).alias("edge_disjoint"))
    return v.join(e, "path_id")


def hops(edges: DataFrame, starts: DataFrame, most: int = 10_000, reverse: bool = False) -> DataFrame:
    """(v, hops): least number of edges from any start (to any, if ``reverse``).

    Every round joins the frontier to the edges and drops what is known; the tables are
    written each round, so a lost executor costs one round at most.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("v"), F.col(b).alias("to")).distinct()
    known = cut(starts.select("v").distinct().withColumn("hops", F.lit(0)))
    frontier = known
    for k in range(1, most + 1):
        new = frontier.join(step, "v").select(F.col("to").alias("v")).distinct().join(known, "v", "left_anti")
        frontier = cut(new.withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if k % 8 == 0:
            known = cut(known)
    return known


def reachability_labels(vertices: DataFrame, edges: DataFrame, sink: DataFrame) -> DataFrame:
    """(v, label): hops to the sink along the edges, FAR if there is no way."""
    return vertices.select("v").join(hops(edges, sink, reverse=True), "v", "left").select("v", F.coalesce("hops", F.lit(FAR)).alias("label"))


def least_edges(edges: DataFrame, source: int, sink: int) -> DataFrame:
    """One row: the number of edges of the shortest path by edges, null if there is none."""
    spark = edges.sparkSession
    found = hops(edges, spark.createDataFrame([(source,)], "v long")).where(F.col("v") == sink)
    return found.agg(F.min("hops").alias("n_edges"))


def weak_components(vertices: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(v, component): the smallest vertex that is reachable against or along edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    label = cut(vertices.select("v", F.col("v").alias("component")))
    for _ in range(most):
        near = label.withColumnRenamed("v", "src").join(both, "src").groupBy(F.col("dst").alias("v")).agg(F.min("component").alias("near"))
        step = label.join(near, "v", "left").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = label.select(F.col("v").alias("component"), F.col("component").alias("far"))
        step = cut(step.join(far, "component", "left").select("v", "old", F.least("component", "far").alias("component")))
        label = step.select("v", "component")
        if step.where("old <> component").isEmpty():
            break
    return label


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): forward and backward colouring.

    Every vertex takes the smallest vertex that reaches it; within one colour, what reaches
    the colour's own vertex is its component; the rest goes on.
    """
    left, found = cut(vertices.select("v")), None
    live = cut(edges.select("src", "dst"))
    while not left.isEmpty():
        colour = cut(left.withColumn("c", F.col("v")))
        while True:
            near = colour.withColumnRenamed("v", "src").join(live, "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("near"))
            step = cut(colour.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c")))
            colour = step.select("v", "c")
            if step.where("old <> c").isEmpty():
                break
        a = colour.select(F.col("v").alias("src"), F.col("c").alias("c1"))
        b = colour.select(F.col("v").alias("dst"), F.col("c").alias("c2"))
        within = cut(live.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst"))
        back = hops(within, colour.where("v = c").select("v"), reverse=True).select("v")
        done = cut(colour.join(back, "v", "left_semi").select("v", F.col("c").alias("component")))
        found = done if found is None else found.unionByName(done)
        left = cut(left.join(done, "v", "left_anti"))
        keep = left.select("v")
        live = cut(within.join(keep.withColumnRenamed("v", "src"), "src", "left_semi").join(keep.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    return found if found is not None else vertices.select("v", F.col("v").alias("component"))


def dag_edges(edges: DataFrame, order: Column | None = None, seed: int = 0) -> DataFrame:
    """Edges that ascend in an order of the vertices (a seeded hash if none is given)."""
    if order is not None:
        return edges.where(order)
    return edges.where(F.xxhash64("src", F.lit(seed)) < F.xxhash64("dst", F.lit(seed)))


def with_terminals(edges: DataFrame, sources: DataFrame, sinks: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """An overlay with a super source and a super sink; their edges have negative ids."""
    a = sources.select((-F.col("v") * 2 - 1).alias("e"), F.lit(source).cast("long").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("length"))
    b = sinks.select((-F.col("v") * 2 - 2).alias("e"), F.col("v").alias("src"), F.lit(sink).cast("long").alias("dst"), F.lit(0.0).alias("length"))
    return edges.select("e", "src", "dst", "length").unionByName(a).unionByName(b)
