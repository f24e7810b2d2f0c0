"""Formats by file extension; arguments ride in the URI: ``path.wktcsv?idCol=0``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.text import split_uri
from . import fields, networks, trajectories


@dataclass(frozen=True)
class Format:
    kind: str
    read: Callable | None
    write: Callable | None
    defaults: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def _lines(read):
    def run(spark: SparkSession, path: str, args: dict[str, str], timed: bool):
        return read(spark, path, timed, int(args["idCol"]), int(args["trajectoryCol"]))

    return run


def _plain(read):
    return lambda spark, path, args, timed: read(spark, path)


COLUMNS = {"idCol": "0", "trajectoryCol": "1"}
FORMATS = {
    "wktcsv": Format("trajectories", _lines(trajectories.read_wkt), trajectories.write_wkt, COLUMNS),
    "wkbcsv": Format("trajectories", _lines(trajectories.read_wkb), trajectories.write_wkb, COLUMNS),
    "edgepaths": Format("edge paths", _plain(trajectories.read_edge_paths), trajectories.write_edge_paths),
    "maptxt": Format("network", _plain(networks.read_maptxt), networks.write_maptxt),
    "mapjson": Format("network", _plain(networks.read_mapjson), networks.write_mapjson),
    "osm": Format("network", _plain(networks.read_osm), None),
    "ipe": Format("network", _plain(networks.read_drawing), None),
    "net": Format("network", _plain(networks.read_parquet), networks.write_parquet),
    "fieldtxt": Format("field", _plain(fields.read_fieldtxt), fields.write_fieldtxt),
    "fieldjson": Format("field", _plain(fields.read_fieldjson), fields.write_fieldjson),
    "result": Format("result", _plain(fields.read_result), fields.write_result),
    "decomptxt": Format("result", None, fields.write_result_text),
    "problem": Format("problem", _plain(fields.read_problem), fields.write_problem),
}


def extensions(kind: str | None = None) -> list[str]:
    return sorted(e for e, f in FORMATS.items() if kind in (None, f.kind))


def format_of(uri: str) -> tuple[str, Format, dict[str, str]]:
    """Path, format and arguments with defaults; an unknown extension is an error."""
    path, args = split_uri(uri)
    name = path.rstrip("/").rpartition(".")[2].lower()
    if name not in FORMATS:
        raise ValueError(f"unknown extension {name!r}; known: {', '.join(extensions())}")
    f = FORMATS[name]
    lacking = [a for a in f.required if a not in args]
    if lacking:
        raise ValueError(f"missing arguments: {', '.join(lacking)}")
    return path, f, f.defaults | args


def required_args(uri: str) -> tuple[str, ...]:
    return format_of(uri)[1].required


def default_args(uri: str) -> dict[str, str]:
    return dict(format_of(uri)[1].defaults)


def read(spark: SparkSession, uri: str, timed: bool = False):
    """What the format holds: a DataFrame, (vertices, edges), (graph, paths), a Result or a Problem."""
    path, f, args = format_of(uri)
    if f.read is None:
        raise ValueError(f"{uri}: this format is write only")
    return f.read(spark, path, args, timed)


def write(uri: str, *what, **options) -> None:
    path, f, _ = format_of(uri)
    if f.write is None:
        raise ValueError(f"{uri}: this format is read only")
    f.write(*what, path, **options)
