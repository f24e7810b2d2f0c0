"""Networks for the search kernels: broadcast behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import Net
from ..store import Shipped, cut, ship

#: Edges of a network that is sent to every task (a large city has a few hundred thousand).
MOST_EDGES = 2_000_000


def collected(edges: DataFrame, vertices: DataFrame) -> Net:
    """The network as arrays; an error if it has more than MOST_EDGES edges (use ``distances``)."""
    n = edges.count()
    if n > MOST_EDGES:
        raise ValueError(f"{n} edges: too many to send to every task; clip the network or use distances()")
    rows = edges.select("e", "src", "dst", F.col("length").cast("double")).collect()
    places = vertices.select("v", F.col("x").cast("double"), F.col("y").cast("double")).collect()
    return Net([tuple(r) for r in rows], [tuple(r) for r in places])


def broadcast_net(edges: DataFrame, vertices: DataFrame) -> Shipped:
    return ship(edges.sparkSession, collected(edges, vertices))


def distances(edges: DataFrame, sources: DataFrame, bound: float | None = None, most: int = 10_000) -> DataFrame:
    """(source, v, dist) for networks of any size: relaxation by joins, round by round.

    Every round extends only the labels that improved; ``bound`` is strict, as in the kernel.
    """
    best = cut(sources.select(F.col("v").alias("source"), "v", F.lit(0.0).alias("dist")))
    front = best
    step = edges.select(F.col("src").alias("v"), F.col("dst").alias("to"), "length")
    for _ in range(most):
        new = front.join(step, "v").select("source", F.col("to").alias("v"), (F.col("dist") + F.col("length")).alias("new"))
        new = new.groupBy("source", "v").agg(F.min("new").alias("new"))
        if bound is not None:
            new = new.where(F.col("new") < bound)
        front = new.join(best, ["source", "v"], "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        front = cut(front.select("source", "v", F.col("new").alias("dist")))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("source", "v"), ["source", "v"], "left_anti").unionByName(front))
    return best
