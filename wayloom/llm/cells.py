"""Fixed-size arrays of counts or flags, gathered from all rows through the shuffle."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITING, settings

#: Pieces of an array, and pieces that one merge takes.
BLOCKS, FAN_IN = 64, 32

SCHEMA = "block int, part int, cells binary"


def packed(cells: np.ndarray, part: int, dtype: type):
    """The array as rows of ``dtype``, one for each block that is not all zero."""
    step = len(cells) // BLOCKS
    rows = [(k, part, zlib.compress(c.astype(dtype).tobytes(), 1)) for k in range(BLOCKS) if (c := cells[k * step : (k + 1) * step]).any()]
    if rows:
        block, group, data = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(group, pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "cells"]
        )


def gathered(rows: DataFrame, size: int, dtype: type, how: str) -> np.ndarray:
    """Merge ``packed`` rows (``how``: sum or or) in a tree of FAN_IN pieces a node; the array has a fixed size."""
    step = size // BLOCKS

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(step, dtype)
        for c in table.column("cells"):
            piece = np.frombuffer(zlib.decompress(c.as_py()), dtype)
            total = total + piece if how == "sum" else total | piece
        first = table.slice(0, 1)
        return pa.table({"block": first.column("block"), "part": first.column("part"), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(merge, SCHEMA)
        if parts <= 1:
            break
    out = np.zeros(size, dtype)
    with settings(rows.sparkSession, WRITING):
        got = rows.collect()  # BLOCKS rows
    for r in got:
        out[r.block * step : (r.block + 1) * step] = np.frombuffer(zlib.decompress(r.cells), dtype)
    return out


def partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


__all__ = ["SCHEMA", "gathered", "packed", "partition_number"]
