"""Trajectory segmentation, clipping and checks as window plans.

Trajectories are long tables (traj_id, pos, x, y[, t]); all windows are partitioned by
trajectory, so one shuffle by traj_id serves a whole chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance


def by_trajectory() -> Window:
    return Window.partitionBy("traj_id").orderBy("pos")



def _numbered(pieces: DataFrame, name: Column) -> DataFrame:
    """Piece rows under their new id, positions from 0."""
    return pieces.withColumn("pos", (F.col("pos") - F.col("first")).cast("long")).withColumn("traj_id", name)


def split_on_time(points: DataFrame, gap: float) -> DataFrame:
    """Cut where the time step is greater than ``gap`` seconds; keep pieces of two points or more.

    A piece is named ``<id>_part_<first>_<last>`` by the places of its ends.
    """
    cut = F.when(F.col("t") - F.lag("t").over(by_trajectory()) > gap, 1).otherwise(0)
    d = points.withColumn("cut", cut)
    d = d.withColumn("piece", F.sum("cut").over(by_trajectory().rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("traj_id", "piece")
    d = d.withColumns({"first": F.min("pos").over(whole), "last": F.max("pos").over(whole)}).where("last > first")
    name = F.concat_ws("_", "traj_id", F.lit("part"), F.col("first").cast("string"), F.col("last").cast("string"))
    return _numbered(d, name).select(*points.columns)


def split_summary(points: DataFrame, gap: float) -> DataFrame:
    """(traj_id, n, duration) of the pieces, aggregated without carrying their points."""
    d = split_on_time(points, gap)
    return d.groupBy("traj_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"))


def filter_min_points(points: DataFrame, least: int) -> DataFrame:
    """Trajectories of ``least`` points or more (points, not metres)."""
    enough = points.groupBy("traj_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("traj_id")
    return points.join(enough, "traj_id", "left_semi")


def _islands(d: DataFrame, columns: list[str]) -> DataFrame:
    """Maximal runs of rows that are ``inside``: three points or more, two if the run ends the trajectory."""
    whole = Window.partitionBy("traj_id")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("traj_id", "inside").orderBy("pos"))
    d = d.withColumns({"run": run, "end": F.max("pos").over(whole)}).where("inside")
    piece = Window.partitionBy("traj_id", "run")
    d = d.withColumns({"first": F.min("pos").over(piece), "last": F.max("pos").over(piece)})
    size = F.col("last") - F.col("first") + 1
    d = d.where(size >= F.when(F.col("last") == F.col("end"), 2).otherwise(3))
    name = F.concat(F.col("traj_id"), F.lit("_bboxsub"), F.col("first").cast("string"), F.lit("_"), (F.col("last") + 1).cast("string"))
    return _numbered(d, name).select(*columns)


def filter_box(points: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """Runs of points inside the closed box, named ``<id>_bboxsub<start>_<end>`` (end excluded)."""
    inside = F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max)
    return _islands(points.withColumn("inside", inside), points.columns)


def bounding_box(rows: DataFrame) -> DataFrame:
    """One row: x_min, x_max, y_min, y_max."""
    return rows.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def filter_graph_box(points: DataFrame, vertices: DataFrame, box_scale: float = 1.0) -> DataFrame:
    """Runs inside the network's bounding box scaled about its centre.

    ``points`` may carry (gx, gy), its coordinates in the network's system; the test uses
    those, the rows keep their own.
    """
    box = bounding_box(vertices)
    half = F.lit(box_scale / 2)
    box = box.select(
        ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"),
        ((F.col("y_min") + F.col("y_max")) / 2).alias("cy"),
        ((F.col("x_max") - F.col("x_min")) * half).alias("hx"),
        ((F.col("y_max") - F.col("y_min")) * half).alias("hy"),
    )
    x, y = (F.col("gx"), F.col("gy")) if "gx" in points.columns else (F.col("x"), F.col("y"))
    d = points.join(F.broadcast(box))  # one row of an aggregate
    inside = x.between(F.col("cx") - F.col("hx"), F.col("cx") + F.col("hx")) & y.between(F.col("cy") - F.col("hy"), F.col("cy") + F.col("hy"))
    return _islands(d.withColumn("inside", inside), points.columns)


def drop_time(points: DataFrame) -> DataFrame:
    return points.drop("t")


def to_arrays(points: DataFrame) -> DataFrame:
    """Nested form: (traj_id, pts array<struct<x, y[, t]>>) in order of position."""
    fields = [c for c in ("x", "y", "t") if c in points.columns]
    rows = points.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("rows"))
    return rows.select("traj_id", F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in fields))).alias("pts"))


def from_arrays(nested: DataFrame) -> DataFrame:
    """Long form of the nested one."""
    return nested.select("traj_id", F.posexplode("pts").alias("pos", "p")).select("traj_id", F.col("pos").cast("long"), "p.*")


def columns_form(points: DataFrame) -> DataFrame:
    """(traj_id, lat, lon, time) as three arrays a trajectory, and how often time decreases."""
    nested = to_arrays(points)

    def column(field: str) -> Column:
        return F.transform("pts", lambda p: p[field])

    one = [column("y").alias("lat"), column("x").alias("lon"), column("t").alias("time")]
    back = F.size(F.filter("pts", lambda p, i: F.coalesce(F.get(F.col("pts"), i - 1)["t"] > p["t"], F.lit(False))))
    return nested.select("traj_id", *one, back.cast("long").alias("n_back"))


def backward_steps(points: DataFrame) -> DataFrame:
    """Points whose time is before their predecessor's."""
    return points.withColumn("before", F.lag("t").over(by_trajectory())).where("t < before").drop("before")


def steps(points: DataFrame) -> DataFrame:
    """(traj_id, pos, dt, dist): the step from each point's predecessor."""
    last = {f"{c}0": F.lag(c).over(by_trajectory()) for c in ("x", "y", "t")}
    d = points.withColumns(last).where("x0 IS NOT NULL")
    return d.select("traj_id", "pos", (F.col("t") - F.col("t0")).alias("dt"), distance(F.col("x0"), F.col("y0"), F.col("x"), F.col("y")).alias("dist"))


def first_trajectories(points: DataFrame, count: int) -> DataFrame:
    """The first ``count`` trajectories by id; all if negative."""
    if count < 0:
        return points
    ids = points.select("traj_id").distinct().orderBy("traj_id").limit(count)
    return points.join(ids, "traj_id", "left_semi")


def match_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids that both sets have, with the nested points of either."""
    a = to_arrays(left).withColumnRenamed("pts", "left_pts")
    return a.join(to_arrays(right).withColumnRenamed("pts", "right_pts"), "traj_id")
