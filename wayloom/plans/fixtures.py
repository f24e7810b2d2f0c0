"""Trajectories, a road network and paths derived from the star-schema tables.

``SQL`` has the same tables as DuckDB common table expressions, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


GRID, SPACING = 21, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, pos, x, y, t): a bounded walk for each user of the event stream."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def walk(factor: int):
        s = F.sum((F.col("event_id") * factor) % 201 - 100).over(run)
        return ((s % 2000 + 2000) % 2000).cast("double")

    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("traj_id"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        walk(7919).alias("x"),
        walk(104729).alias("y"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("t"),
    )


def vertices(spark: SparkSession) -> DataFrame:
    """(v, x, y) of a square grid."""
    v = F.col("id")
    return spark.range(GRID * GRID).select(
        v.alias("v"), ((v % GRID) * SPACING).alias("x"), (F.floor(v / GRID) * SPACING).alias("y")
    )


def edges(spark: SparkSession) -> DataFrame:
    """(e, src, dst, length): neighbours in the grid, some streets one-way."""
    v = F.col("id")
    near = F.array(
        F.when(v % GRID > 0, v - 1), F.when(v % GRID < GRID - 1, v + 1), F.when(v >= GRID, v - GRID), F.when(v < GRID * (GRID - 1), v + GRID)
    )
    d = spark.range(GRID * GRID).select(v.alias("src"), F.explode(F.filter(near, lambda x: x.isNotNull())).alias("dst"))
    d = d.where(~((F.col("dst") < F.col("src")) & ((F.col("src") * 31 + F.col("dst") * 17) % 11 == 0)))
    number = F.row_number().over(Window.orderBy("src", "dst"))  # a fixed, small network
    return d.select((number - 1).cast("long").alias("e"), "src", "dst", F.lit(SPACING).alias("length"))


def edge_lines(spark: SparkSession) -> DataFrame:
    """(e, src, dst, length, x1, y1, x2, y2)."""
    v = vertices(spark)
    a = v.select(F.col("v").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = v.select(F.col("v").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges(spark).join(a, "src").join(b, "dst").select("e", "src", "dst", "length", "x1", "y1", "x2", "y2")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, pos, e, src, dst, value): a staircase for each order, ten edges at most."""
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path_id"),
        (F.row_number().over(o) - 1).alias("pos"),
        (F.col("l_partkey") % 2).alias("right"),
        F.sum(F.col("l_partkey") % 2).over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("rights"),
    )
    before = F.col("rights") - F.col("right")
    x = F.col("path_id") % 10 + before
    y = F.floor(F.col("path_id") / 10) % 10 + F.col("pos") - before
    src = y * GRID + x
    d = d.where("pos < 10").select(
        "path_id", F.col("pos").cast("long"), src.cast("long").alias("src"), (src + F.when(F.col("right") == 1, 1).otherwise(GRID)).cast("long").alias("dst")
    )
    value = (1.0 + F.col("path_id") % 3).cast("double")
    return d.join(edges(spark).drop("length"), ["src", "dst"]).select("path_id", "pos", "e", "src", "dst", value.alias("value"))


SQL = {
    "pts": """pts AS (
  SELECT user_id::VARCHAR AS traj_id, row_number() OVER w - 1 AS pos,
         (((sum((event_id * 7919) % 201 - 100) OVER w) % 2000 + 2000) % 2000)::DOUBLE AS x,
         (((sum((event_id * 104729) % 201 - 100) OVER w) % 2000 + 2000) % 2000)::DOUBLE AS y,
         epoch_us(ts) / 1e6 AS t
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
    "vert": """vert AS (SELECT v, (v % 21) * 100.0::DOUBLE AS x, (v // 21) * 100.0::DOUBLE AS y FROM range(441) r(v))""",
    "edg": """edg AS (
  SELECT row_number() OVER (ORDER BY a.v, b.v) - 1 AS e, a.v AS src, b.v AS dst, 100.0::DOUBLE AS length,
         a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM vert a JOIN vert b ON abs(a.x - b.x) + abs(a.y - b.y) = 100
  WHERE NOT (b.v < a.v AND (a.v * 31 + b.v * 17) % 11 = 0))""",
    "pth": """pth AS (
  SELECT path_id, pos, e, s.src, s.dst, (1.0 + path_id % 3)::DOUBLE AS value
  FROM (SELECT path_id, pos, y * 21 + x AS src, y * 21 + x + CASE WHEN d = 1 THEN 1 ELSE 21 END AS dst
        FROM (SELECT path_id, pos, d, path_id % 10 + r - d AS x, (path_id // 10) % 10 + pos - (r - d) AS y
              FROM (SELECT l_orderkey AS path_id, row_number() OVER o - 1 AS pos, l_partkey % 2 AS d, sum(l_partkey % 2) OVER o AS r
                    FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
              WHERE pos < 10)) s
  JOIN edg ON edg.src = s.src AND edg.dst = s.dst)""",
}
NEEDS = {"pts": [], "vert": [], "edg": ["vert"], "pth": ["vert", "edg"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the derived tables ``names`` and what they need."""
    order = [n for n in SQL if n in names or any(n in NEEDS[m] for m in names)]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in order)


__all__ = ["edge_lines", "edges", "paths", "points", "table", "vertices", "with_tables"]
