"""Trajectory files: CSV of WKT or hex WKB lines, and Parquet of edge paths.

The CSV has a header and ``;`` between columns.  Lines are decoded in the scan: only the
two columns that are named reach the parser.  Rows that are not line strings are left out.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import from_wkt, to_wkt

#: WKB geometry codes of a line string: plain, with Z, with M, with both (ISO).
LINE, LINE_Z, LINE_M, LINE_ZM = 2, 1002, 2002, 3002


def _points_type(timed: bool) -> ArrayType:
    names = ["x", "y", "t"] if timed else ["x", "y"]
    return ArrayType(StructType([StructField(n, DoubleType()) for n in names]))


def decode_wkb(data: bytes | None) -> np.ndarray | None:
    """Ordinates (n, 2..4) of a line string in either byte order; None for anything else."""
    if data is None or len(data) < 9:
        return None
    order = "<" if data[0] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", data, 1)
    width = {LINE: 2, LINE_Z: 3, LINE_M: 3, LINE_ZM: 4, LINE | 0x80000000: 3, LINE | 0x40000000: 3}.get(kind)
    if width is None or len(data) < 9 + 8 * width * n:
        return None
    return np.frombuffer(data, f"{order}f8", n * width, 9).reshape(n, width).astype(float)


def encode_wkb(points, timed: bool) -> bytes:
    """Little-endian ISO line string, with M if timed."""
    flat = [p[k] for p in points for k in (("x", "y", "t") if timed else ("x", "y"))]
    return struct.pack("<BII", 1, LINE_M if timed else LINE, len(points)) + struct.pack(f"<{len(flat)}d", *flat)


def read_csv(spark: SparkSession, path: str, id_col: int = 0, trajectory_col: int = 1, most: int | None = None) -> DataFrame:
    """(traj_id, geometry) as text; columns are counted from 0."""
    raw = spark.read.csv(path, sep=";", header=True, quote="")
    out = raw.select(F.col(f"`{raw.columns[id_col]}`").alias("traj_id"), F.col(f"`{raw.columns[trajectory_col]}`").alias("geometry"))
    return out if most is None else out.limit(most)


def read_wkt(spark: SparkSession, path: str, timed: bool = False, id_col: int = 0, trajectory_col: int = 1, most: int | None = None) -> DataFrame:
    """(traj_id, pts)."""
    raw = read_csv(spark, path, id_col, trajectory_col, most)
    return raw.select("traj_id", from_wkt(F.col("geometry"), timed).alias("pts")).where("pts IS NOT NULL")


def read_wkb(spark: SparkSession, path: str, timed: bool = False, id_col: int = 0, trajectory_col: int = 1, most: int | None = None) -> DataFrame:
    """(traj_id, pts); bytes become numbers in Arrow batches."""
    names = ["x", "y", "t"] if timed else ["x", "y"]

    @F.pandas_udf(_points_type(timed))
    def points(data: pd.Series) -> pd.Series:
        def one(d):
            rows = decode_wkb(d)
            if rows is None or (timed and rows.shape[1] < 3):
                return None
            use = rows[:, [0, 1, rows.shape[1] - 1][: len(names)]]
            return [dict(zip(names, r, strict=True)) for r in use.tolist()]

        return data.map(one)

    raw = read_csv(spark, path, id_col, trajectory_col, most)
    return raw.select("traj_id", points(F.unhex("geometry")).alias("pts")).where("pts IS NOT NULL")


def write_wkt(nested: DataFrame, path: str, timed: bool = False) -> None:
    out = nested.select(F.col("traj_id").alias("ID"), to_wkt(F.col("pts"), timed).alias("TRAJECTORY"))
    out.write.csv(path, sep=";", header=True, quote="")


def write_wkb(nested: DataFrame, path: str, timed: bool = False) -> None:
    @F.pandas_udf("binary")
    def wkb(points: pd.Series) -> pd.Series:
        return points.map(lambda p: encode_wkb(p, timed))

    out = nested.select(F.col("traj_id").alias("ID"), F.hex(wkb("pts")).alias("TRAJECTORY"))
    out.write.csv(path, sep=";", header=True, quote="")


def read_edge_paths(spark: SparkSession, path: str) -> DataFrame:
    """(traj_id string, edges array<long>)."""
    return spark.read.schema("traj_id string, edges array<long>").parquet(path)


def write_edge_paths(paths: DataFrame, path: str) -> None:
    paths.select("traj_id", "edges").write.parquet(path)
