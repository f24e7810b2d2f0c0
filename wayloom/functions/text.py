"""WKT lines, URIs and descriptions as column expressions."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(c: Column) -> Column:
    """A double as text; whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def to_wkt(points: Column, timed: bool = False) -> Column:
    """LINESTRING text of array<struct<x, y[, t]>>."""

    def one(p: Column) -> Column:
        parts = [number_text(p.x), number_text(p.y)] + ([number_text(p.t)] if timed else [])
        return F.concat_ws(" ", *parts)

    head = "LINESTRING M (" if timed else "LINESTRING ("
    return F.concat(F.lit(head), F.array_join(F.transform(points, one), ","), F.lit(")"))


def from_wkt(wkt: Column, timed: bool = False) -> Column:
    """array<struct<x, y[, t]>> of a LINESTRING [Z] [M] text; null for any other geometry."""
    body = F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*(?:ZM|Z|M)?\s*\(([^()]*)\)\s*$", 1)

    def one(p: Column) -> Column:
        parts = F.split(F.btrim(p), r"\s+")
        x, y = F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double")
        if not timed:
            return F.struct(x.alias("x"), y.alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.element_at(parts, -1).cast("double").alias("t"))

    return F.when(body != "", F.transform(F.split(body, ","), one))


def describe_source(path: Column, traj_id: Column) -> Column:
    """What a representative comes from: a path of the field, or a trajectory."""
    return F.when(path >= 0, F.concat(F.lit("Path: "), path.cast("string"))).otherwise(traj_id)


def split_uri(uri: str) -> tuple[str, dict[str, str]]:
    """Path and arguments of ``path?k=v&k2=v2``."""
    path, _, query = uri.partition("?")
    return path, dict(parse_qsl(query, keep_blank_values=True))


def join_uri(path: str, args: dict[str, str]) -> str:
    return f"{path}?{urlencode(sorted(args.items()), quote_via=quote)}" if args else path


def same_uri(a: str, b: str) -> bool:
    """Equal paths and equal arguments in any order."""
    return split_uri(a) == split_uri(b) and urlsplit(a).scheme == urlsplit(b).scheme
