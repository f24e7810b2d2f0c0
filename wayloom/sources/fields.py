"""Field, result and problem files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decompose import Problem, Result
from .networks import _words, numbered_lines, write_text


def read_fieldtxt(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Graph file and paths (path_id, pos, e, value) of ``[FieldTxt] / graph / P / [Paths] / n e.. / [PathValues] / v..``."""
    lines = _words(numbered_lines(spark, path))
    at = {r.line.strip(): r.n for r in lines.where("line LIKE '[%'").collect()}
    graph = lines.where(F.col("n") == at["[FieldTxt]"] + 1).first().line.strip()
    n = int(lines.where(F.col("n") == at["[FieldTxt]"] + 2).first().line)
    p0, v0 = at["[Paths]"] + 1, at["[PathValues]"] + 1
    paths = lines.where(F.col("n").between(p0, p0 + n - 1)).select((F.col("n") - p0).cast("long").alias("path_id"), F.posexplode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).alias("pos", "e"))
    values = lines.where(F.col("n").between(v0, v0 + n - 1)).select((F.col("n") - v0).cast("long").alias("path_id"), F.get("w", F.lit(0)).cast("double").alias("value"))
    return graph, paths.join(values, "path_id").select("path_id", F.col("pos").cast("long"), F.col("e").cast("long"), "value")


def write_fieldtxt(paths: DataFrame, graph: str, path: str) -> None:
    rows = paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("p"), F.max("value").alias("value")).orderBy("path_id").collect()
    lines = ["[FieldTxt]", graph, str(len(rows)), "[Paths]", *(" ".join(map(str, [len(r.p), *(s.e for s in r.p)])) for r in rows), "[PathValues]", *(repr(r.value) for r in rows)]
    write_text(paths.sparkSession, path, lines)


JSON_FIELD = "graphfile string, paths array<array<long>>, knownpaths array<array<long>>, pathvalues array<double>"


def read_fieldjson(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Like ``read_fieldtxt``; keys may be flat or below ``field``."""
    raw = spark.read.text(path, wholetext=True)
    f = raw.select(F.coalesce(F.get_json_object("value", "$.field"), F.col("value")).alias("v")).select(F.from_json("v", JSON_FIELD).alias("f"))
    graph = f.first().f.graphfile
    known = F.coalesce("f.paths", "f.knownpaths")
    d = f.select("f", F.posexplode(known).alias("path_id", "p"))
    d = d.select(F.col("path_id").cast("long"), F.get("f.pathvalues", F.col("path_id")).alias("value"), F.posexplode("p").alias("pos", "e"))
    return graph, d.select("path_id", F.col("pos").cast("long"), "e", "value")


def write_fieldjson(paths: DataFrame, graph: str, path: str) -> None:
    rows = paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("p"), F.max("value").alias("value")).orderBy("path_id").collect()
    field = {"graphfile": graph, "paths": [[s.e for s in r.p] for r in rows], "pathvalues": [r.value for r in rows]}
    write_text(paths.sparkSession, path, [json.dumps({"field": field})])


def write_result(result: Result, path: str) -> None:
    """Basis and coefficients as Parquet, scalars and log as a JSON line beside them."""
    result.basis.write.parquet(f"{path}/basis")
    result.coefs.write.parquet(f"{path}/coefs")
    write_text(result.basis.sparkSession, f"{path}/meta", [json.dumps({"objective": result.objective, "log": result.log})])


def read_result(spark: SparkSession, path: str) -> Result:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return Result(spark.read.parquet(f"{path}/basis"), spark.read.parquet(f"{path}/coefs"), meta["objective"], meta["log"])


def write_result_text(result: Result, path: str) -> None:
    """One line a basis path: coefficient, then its edges."""
    d = result.basis.join(result.coefs, "b").groupBy("b", "coef").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("p"))
    line = F.concat_ws(" ", F.col("coef").cast("string"), F.array_join(F.transform("p", lambda s: s.e.cast("string")), " "))
    d.orderBy("b").select(line.alias("value")).write.text(path)


def write_problem(problem: Problem, path: str) -> None:
    for name in ("edges", "vertices", "field", "representatives"):
        getattr(problem, name).write.parquet(f"{path}/{name}")
    write_text(problem.edges.sparkSession, f"{path}/meta", [json.dumps({"epsilon": problem.epsilon})])


def read_problem(spark: SparkSession, path: str) -> Problem:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return Problem(*(spark.read.parquet(f"{path}/{n}") for n in ("edges", "vertices", "field", "representatives")), meta["epsilon"])
