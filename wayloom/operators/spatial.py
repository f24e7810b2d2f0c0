"""Spatial lookups as grid-binned equi-joins with an exact residual test.

Both sides are dealt to square cells; the side with extent is exploded over the cells its
box covers, the other has one cell a row.  A join by cell is an ordinary equi-join, which
Catalyst plans and which skew handling can split; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, segment_distance

CELL = 100.0


def cell(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")]


def over_cells(rows: DataFrame, x1: Column, x2: Column, y1: Column, y2: Column, size: float) -> DataFrame:
    """Rows repeated for every cell of their box."""
    d = rows.withColumn("cx", F.explode(F.sequence(F.floor(x1 / size), F.floor(x2 / size))))
    return d.withColumn("cy", F.explode(F.sequence(F.floor(y1 / size), F.floor(y2 / size))))


def _edge_cells(edges: DataFrame, size: float) -> DataFrame:
    c = {n: F.col(n) for n in ("x1", "x2", "y1", "y2")}
    d = edges.select("e", "x1", "y1", "x2", "y2")
    return over_cells(d, F.least(c["x1"], c["x2"]), F.greatest(c["x1"], c["x2"]), F.least(c["y1"], c["y2"]), F.greatest(c["y1"], c["y2"]), size)


def edges_in_boxes(boxes: DataFrame, edges: DataFrame, size: float = CELL) -> DataFrame:
    """(box_id, e): edges whose own box meets the box (box_id, x_min, x_max, y_min, y_max)."""
    b = over_cells(boxes, F.col("x_min"), F.col("x_max"), F.col("y_min"), F.col("y_max"), size)
    d = b.join(_edge_cells(edges, size), ["cx", "cy"])
    meets = (
        (F.least("x1", "x2") <= F.col("x_max")) & (F.greatest("x1", "x2") >= F.col("x_min"))
        & (F.least("y1", "y2") <= F.col("y_max")) & (F.greatest("y1", "y2") >= F.col("y_min"))
    )
    return d.where(meets).select("box_id", "e").distinct()


def edges_near_points(points: DataFrame, edges: DataFrame, keys: list[str], radius: float, size: float | None = None) -> DataFrame:
    """Candidates (keys, px, py, e, x1, y1, x2, y2) of the square of ``radius`` around (px, py).

    The point has one cell; an edge is dealt to the cells of its box grown by the radius,
    so a pair meets exactly once.
    """
    size = size or max(radius, CELL)
    p = points.select(*keys, "px", "py", *cell(F.col("px"), F.col("py"), size))
    r = F.lit(radius)
    e = edges.select("e", "x1", "y1", "x2", "y2")
    e = over_cells(e, F.least("x1", "x2") - r, F.greatest("x1", "x2") + r, F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, size)
    d = p.join(e, ["cx", "cy"])
    x, y = F.col("px"), F.col("py")
    near = (F.least("x1", "x2") <= x + r) & (F.greatest("x1", "x2") >= x - r) & (F.least("y1", "y2") <= y + r) & (F.greatest("y1", "y2") >= y - r)
    return d.where(near).drop("cx", "cy")


def nearest_edges(points: DataFrame, edges: DataFrame, keys: list[str], k: int = 8, radius: float = 300.0) -> DataFrame:
    """(keys, e, dist, rank): the k edges nearest to each point.

    Candidates are the edges whose box meets the square of ``radius``; if there are k or
    fewer, all of them count, however far; ties go to the lower edge id.
    """
    d = edges_near_points(points, edges, keys, radius)
    dist = segment_distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    d = d.withColumn("dist", dist)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "e"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k)


def vertices_in_boxes(boxes: DataFrame, vertices: DataFrame, size: float = CELL) -> DataFrame:
    """(box_id, v) for closed boxes."""
    b = over_cells(boxes, F.col("x_min"), F.col("x_max"), F.col("y_min"), F.col("y_max"), size)
    v = vertices.select("v", "x", "y", *cell(F.col("x"), F.col("y"), size))
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    return b.join(v, ["cx", "cy"]).where(inside).select("box_id", "v")


def vertices_in_disks(disks: DataFrame, vertices: DataFrame, size: float | None = None) -> DataFrame:
    """(disk_id, v, dist) within the radius of (disk_id, px, py, r)."""
    size = size or CELL
    x, y, r = F.col("px"), F.col("py"), F.col("r")
    d = over_cells(disks, x - r, x + r, y - r, y + r, size)
    v = vertices.select("v", "x", "y", *cell(F.col("x"), F.col("y"), size))
    d = d.join(v, ["cx", "cy"]).withColumn("dist", distance(x, y, F.col("x"), F.col("y")))
    return d.where(F.col("dist") <= r).select("disk_id", "v", "dist")


def segments(lines: DataFrame) -> DataFrame:
    """(traj_id, seg, x1, y1, x2, y2) of the polylines (traj_id, pos, x, y)."""
    w = Window.partitionBy("traj_id").orderBy("pos")
    d = lines.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 IS NOT NULL")
    return d.select("traj_id", F.col("pos").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def vertices_near_lines(lines: DataFrame, vertices: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """(traj_id, seg, v, x, y, ..., dist): vertices within ``radius`` of a segment.

    Lines of one point or none have no buffer; a segment of no length counts as a disk.
    """
    size = size or max(radius, CELL)
    s, r = segments(lines), F.lit(radius)
    s = over_cells(s, F.least("x1", "x2") - r, F.greatest("x1", "x2") + r, F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, size)
    v = vertices.select("v", "x", "y", *cell(F.col("x"), F.col("y"), size))
    d = s.join(v, ["cx", "cy"]).drop("cx", "cy")
    dist = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return d.withColumn("dist", dist).where(F.col("dist") <= r)


def buffers(lines: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """(traj_id, v): the vertices in the buffer of each line."""
    return vertices_near_lines(lines, vertices, radius).select("traj_id", "v").distinct()


def outside_buffers(lines: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """Vertices outside every buffer."""
    return vertices.join(buffers(lines, vertices, radius).select("v").distinct(), "v", "left_anti")


def uncapturable(field: DataFrame, edges: DataFrame, vertices: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """One row: the field on edges with both ends outside all buffers."""
    near = buffers(lines, vertices, radius).select("v").distinct()
    d = field.join(edges.select("e", "src", "dst"), "e")
    d = d.join(near.withColumnRenamed("v", "src"), "src", "left_anti").join(near.withColumnRenamed("v", "dst"), "dst", "left_anti")
    return d.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("uncapturable"))


def in_convex_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Closed half-plane tests; the corners run counter-clockwise."""
    test = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        test = test & (((bx - ax) * (y - ay) - (by - ay) * (x - ax)) >= -1e-9)
    return test


def closest_vertices(points: DataFrame, vertices: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """(keys, v): the nearest vertex, the lowest id of equal ones; -1 if there is none.

    Rings of cells grow until every point has a vertex that no unseen cell can beat: a
    vertex found within ring k is nearest for sure if it is no farther than k cells.
    """
    left = points.select(*keys, "px", "py")
    v = vertices.select("v", "x", "y", *cell(F.col("x"), F.col("y"), size))
    box = vertices.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    reach = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if box[0] is None or reach[0] is None:
        return left.select(*keys, F.lit(-1).cast("long").alias("v"))
    span = max(abs(a - b) for a in reach for b in box)
    done, ring = None, 1
    while True:
        r = F.lit(float(ring * size))
        x, y = F.col("px"), F.col("py")
        d = over_cells(left, x - r, x + r, y - r, y + r, size).join(v, ["cx", "cy"])
        d = d.withColumn("dist", distance(x, y, F.col("x"), F.col("y"))).where(F.col("dist") <= r)
        near = d.groupBy(*keys).agg(F.min(F.struct("dist", "v")).alias("best")).select(*keys, F.col("best.v").alias("v"))
        done = near if done is None else done.unionByName(near)
        left = left.join(near, keys, "left_anti")
        if ring * size > 2 * span + size or left.isEmpty():
            return done.unionByName(left.select(*keys, F.lit(-1).cast("long").alias("v")))
        ring *= 4


def endpoint_cells(lines: DataFrame, size: float = 500.0) -> DataFrame:
    """(traj_id, start cell, end cell): the grid hash of both ends."""
    ends = lines.groupBy("traj_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    names = [("sx", "a.x"), ("sy", "a.y"), ("ex", "b.x"), ("ey", "b.y")]
    return ends.select("traj_id", *(F.floor(F.col(c) / size).alias(n) for n, c in names))


def same_end_cells(lines: DataFrame, size: float = 500.0) -> DataFrame:
    """(a, b): pairs of lines, a < b, that begin and end in equal cells (candidates for similarity)."""
    c = endpoint_cells(lines, size)
    keys = ["sx", "sy", "ex", "ey"]
    a, b = c.withColumnRenamed("traj_id", "a"), c.withColumnRenamed("traj_id", "b")
    return a.join(b, keys).where("a < b").select("a", "b")
