"""Queries by kernels and iteration: routes, map matching, Frechet distances, decompositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as dc
from ..operators import field as fl
from ..operators import frechet as fz
from ..operators import matching as mt
from ..operators import network as nw
from ..operators import nets
from ..operators import routes as rt
from ..operators import trajectory as tr
from . import fixtures as fx
from .experiment import sample_rows
from .fixtures import with_tables as using
from .registry import query


def corner_pairs(spark: SparkSession) -> DataFrame:
    return fx.vertices(spark).where("v % 20 = 0 AND v > 0").select(F.lit(0).cast("long").alias("source"), F.col("v").alias("sink"))


def _routes(kind: str, dag: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = fx.edges(spark)
        e = e.where("src < dst") if dag else e
        found = rt.routes(corner_pairs(spark), e, fx.vertices(spark), kind)
        return found.select("source", "sink", "cost", F.size("edges").cast("long").alias("n_edges"))

    return run


HOPS = f"""{using("vert", "edg", recursive=True)},
bfs AS (SELECT 0::BIGINT AS v, 0 AS hops UNION SELECT dst, hops + 1 FROM bfs JOIN edg ON src = v WHERE hops < 60),
one AS (SELECT v, min(hops)::BIGINT AS hops FROM bfs GROUP BY v)"""
BY_HOPS = f"{HOPS} SELECT 0::BIGINT AS source, v AS sink, hops * {{cost}}::DOUBLE AS cost, hops AS n_edges FROM one WHERE v % 20 = 0 AND v > 0"
DAG = f"""{using("vert", "edg", recursive=True)}, dag AS (SELECT src, dst FROM edg WHERE src < dst),
bfs AS (SELECT 0::BIGINT AS v, 0 AS hops UNION SELECT dst, hops + 1 FROM bfs JOIN dag ON src = v)
SELECT 0::BIGINT AS source, v AS sink, max(hops) * 100.0::DOUBLE AS cost, max(hops)::BIGINT AS n_edges FROM bfs WHERE v % 20 = 0 AND v > 0 GROUP BY v"""

query("shortest_path", BY_HOPS.format(cost="100.0"))(_routes("dijkstra"))
query("astar_path", BY_HOPS.format(cost="100.0"))(_routes("astar"))
query("fewest_edges_path", BY_HOPS.format(cost="1.0"))(_routes("fewest"))
query("bellman_ford_path", BY_HOPS.format(cost="100.0"))(_routes("bellman_ford"))
query("dag_longest_path", DAG)(_routes("dag_longest", dag=True))
query("widest_path")(_routes("widest"))
query("long_path")(_routes("long"))


@query("distance_table", f"{HOPS} SELECT 0::BIGINT AS source, v, hops * 100.0::DOUBLE AS dist FROM one WHERE hops < 12")
def distance_table(spark: SparkSession, d: str) -> DataFrame:
    """Bounded distances by joins, for networks that are too large to broadcast."""
    return nets.distances(fx.edges(spark), fx.vertices(spark).where("v = 0"), bound=1200.0)


@query(
    "max_flow",
    f"""{using("vert", "edg")} SELECT v.v AS source, 220::BIGINT AS sink, least((SELECT sum(length) FROM edg WHERE src = v.v), (SELECT sum(length) FROM edg WHERE dst = 220))::DOUBLE AS value
FROM vert v WHERE v.v IN (0, 20, 50, 100)""",
)
def max_flow(spark: SparkSession, d: str) -> DataFrame:
    """In this grid the smallest cut is around one of the two ends."""
    pairs = fx.vertices(spark).where("v IN (0, 20, 50, 100)").select(F.col("v").alias("source"), F.lit(220).cast("long").alias("sink"))
    return rt.max_flow(fx.edges(spark), fx.vertices(spark), pairs)


def short_lines(spark: SparkSession, d: str) -> DataFrame:
    """All walks, smoothed, going to and fro by six steps so that the network can follow them."""
    p = fx.points(spark, d)
    step = F.abs((F.col("pos") + 6) % 12 - 6)
    return p.select("traj_id", "pos", (F.col("x") * 0.1 + step * 120 + 200).alias("x"), (F.col("y") * 0.1 + step * 80 + 200).alias("y"), (F.col("pos") * 60.0).alias("t"))


@query("map_match")
def map_match(spark: SparkSession, d: str) -> DataFrame:
    return mt.match(short_lines(spark, d), fx.edges(spark), fx.vertices(spark), fx.edge_lines(spark), k=6, radius=150.0, gps_error=50.0, speed_bound=140 / 3.6)


@query("map_match_frechet")
def map_match_frechet(spark: SparkSession, d: str) -> DataFrame:
    return mt.match_frechet(short_lines(spark, d), fx.edges(spark), fx.vertices(spark), lower=5.0, precision=1.0)


@query("map_match_fixed_radius")
def map_match_fixed_radius(spark: SparkSession, d: str) -> DataFrame:
    return mt.match_frechet(short_lines(spark, d), fx.edges(spark), fx.vertices(spark), radius=150.0)


@query("frechet_table")
def frechet_table(spark: SparkSession, d: str) -> DataFrame:
    lines = short_lines(spark, d)
    return fz.table(lines, lines, 0.1, 100.0).withColumn("distance", F.round("distance", 3))


@query("frechet_nearest")
def frechet_nearest(spark: SparkSession, d: str) -> DataFrame:
    lines = short_lines(spark, d)
    return fz.nearest(lines.where("cast(traj_id AS long) % 2 = 0"), lines.where("cast(traj_id AS long) % 2 = 1"))


@query("frechet_distortion")
def frechet_distortion(spark: SparkSession, d: str) -> DataFrame:
    lines = short_lines(spark, d)
    return fz.distortion(lines.where("cast(traj_id AS long) % 2 = 0"), lines.where("cast(traj_id AS long) % 2 = 1"))


@query("coverage")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = short_lines(spark, d)
    return fz.coverage(lines, lines, 80.0)


def problem(spark: SparkSession, d: str) -> dc.Problem:
    """The field of all paths; the representatives are a seeded selection of paths of three edges and more."""
    paths = fx.paths(spark, d)
    longer = paths.groupBy("path_id").count().where("count >= 3").select("path_id")
    chosen = fl.representatives(paths, sample_rows(longer, 8, 7))
    lines = nw.path_polyline(chosen, fx.edges(spark), fx.vertices(spark))
    flow = fl.field_from_paths(fx.edges(spark), paths)
    return dc.Problem(fx.edges(spark), fx.vertices(spark), flow, lines, 110.0)


def _decomposition(name: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = problem(spark, d)
        r = dc.decompose(p, dc.DECOMPOSERS[name](**options))
        coefs = r.coefs if r.coefs is not None else spark.createDataFrame([], "b long, coef double")
        start = fl.square_length(p.field).first().objective
        return coefs.agg(F.count("*").alias("basis_size"), F.round(F.coalesce(F.sum("coef"), F.lit(0.0)), 4).alias("weight")).select(
            "basis_size", "weight", F.lit(round(r.objective, 3)).alias("objective"), F.lit(round(start, 3)).alias("at_start")
        )

    return run


TRIVIAL = f"""{using("vert", "edg", "pth")}, f AS (SELECT e, sum(value) AS v FROM pth GROUP BY e)
SELECT count(*) AS basis_size, sum(v)::DOUBLE AS weight, 0.0::DOUBLE AS objective, sum(v * v)::DOUBLE AS at_start FROM f"""
query("decompose_trivial", TRIVIAL)(_decomposition("trivial"))
query("decompose_widest")(_decomposition("widest_path", iterations=2))
query("decompose_band")(_decomposition("frechet_band"))
query("decompose_frechet")(_decomposition("frechet", precision=1.0))
query("decompose_hitting")(_decomposition("frechet_hitting", iterations=2))
query("decompose_weighted")(_decomposition("weighted_frechet", most=500))
query("decompose_min_cost")(_decomposition("global_min_cost"))
query("decompose_multi_commodity")(_decomposition("multi_commodity"))
