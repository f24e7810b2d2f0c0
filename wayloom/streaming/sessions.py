"""Splitting a stream of positions at time gaps, with event-time sessions.

A session window closes when no point came for ``gap``; points exactly ``gap`` apart stay
together, as in the batch operator.  Late points within the watermark still count; state
is dropped as the watermark passes, so it follows the open sessions, not the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(points: DataFrame, gap: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """(traj_id, start, stop, n, x and y bounds) of pieces of two points or more.

    ``points`` is (traj_id, ts timestamp, x, y), batch or streaming (append mode).
    """
    d = points.withWatermark("ts", watermark)
    d = d.groupBy("traj_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    return d.where("n >= 2").drop("w")


def edge_counts(passages: DataFrame, width: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(e, start, n, value): traffic a window and edge from a stream of passages (e, ts, value)."""
    d = passages.withWatermark("ts", watermark).groupBy("e", F.window("ts", width).alias("w"))
    d = d.agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return d.select("e", F.col("w.start").alias("start"), "n", "value")
