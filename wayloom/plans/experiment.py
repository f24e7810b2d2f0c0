"""Experiment grids, settings, and the logs of runs.

Settings are small JSON documents and stay on the driver; logs of many runs are tables.
"""

from __future__ import annotations

import copy
import itertools
import json
import random
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as dc
from ..store import cut

# --- settings -------------------------------------------------------------------------


def get_path(settings: dict, path: str):
    for key in path.split("."):
        settings = settings[key]
    return settings


def set_path(settings: dict, path: str, value) -> dict:
    """A copy with ``path`` (dotted) set; missing levels are made."""
    out = copy.deepcopy(settings)
    at, (*inner, last) = out, path.split(".")
    for key in inner:
        at = at.setdefault(key, {})
    at[last] = value
    return out


def delete_path(settings: dict, path: str) -> dict:
    out = copy.deepcopy(settings)
    at, (*inner, last) = out, path.split(".")
    for key in inner:
        at = at.get(key, {})
    at.pop(last, None)
    return out


def runs(settings: dict) -> list[dict]:
    """One settings document a run.

    ``runMode``: allPairs takes the product of all ``runParameters``, combinations the
    first values, the second values and so on (as many as the shortest list has), single
    the document as it is.
    """
    base = {k: v for k, v in settings.items() if k not in ("runMode", "runParameters")}
    params = settings.get("runParameters", {})
    mode = settings.get("runMode", "single")
    if mode == "single" or not params:
        return [copy.deepcopy(base)]
    if mode not in ("allPairs", "combinations"):
        raise ValueError(f"unknown run mode {mode!r}")
    rows = itertools.product(*params.values()) if mode == "allPairs" else zip(*params.values(), strict=False)
    out = []
    for values in rows:
        one = base
        for path, value in zip(params, values, strict=True):
            one = set_path(one, path, value)
        out.append(one)
    return out


def selected(n: int, seed: int, mode: str, value: float) -> array:
    """Places in 0..n-1 by a seeded shuffle of all; ``percentage`` (or ``fraction``) takes that share, ``count`` (or ``fixed``) that number."""
    if mode not in ("percentage", "fraction", "count", "fixed"):
        raise ValueError(f"unknown selection mode {mode!r}")
    order = array("I" if n < 1 << 32 else "Q", range(n))
    random.Random(seed).shuffle(order)
    return order[: int(value * n) if mode in ("percentage", "fraction") else int(value)]


def select_ids(ids: list, seed: int, mode: str, value: float) -> list:
    """The ids at the ``selected`` places."""
    return [ids[k] for k in selected(len(ids), seed, mode, value)]


def select_rows(rows: DataFrame, key: str, seed: int, mode: str, value: float) -> DataFrame:
    """(place, columns of ``rows``): ``select_ids`` of a table in the order of its unique ``key``.

    Nothing is collected but a count for each part of the sorted table.  The shuffle is one
    sequence by contract: one task draws it and holds four bytes a row (eight from 2^32 rows on).
    """
    if mode not in ("percentage", "fraction", "count", "fixed"):
        raise ValueError(f"unknown selection mode {mode!r}")
    spark = rows.sparkSession
    d = cut(rows.orderBy(key).withColumns({"part_": F.spark_partition_id(), "number_": F.monotonically_increasing_id()}))
    starts, total = [], 0
    for r in d.groupBy("part_").agg(F.min("number_").alias("least"), F.count("*").alias("n")).orderBy("part_").collect():
        starts.append((r.part_, total - r.least))
        total += r.n
    starts = spark.createDataFrame(starts, "part_ int, shift_ long")  # one row a part

    def draw(batches):
        for b in batches:
            if b.num_rows:
                order = np.frombuffer(selected(total, seed, mode, value), np.uint32 if total < 1 << 32 else np.uint64)
                for k in range(0, len(order), 1 << 16):
                    at = order[k : k + (1 << 16)].astype(np.int64)
                    yield pa.record_batch({"place": np.arange(k, k + len(at)), "at_": at})

    chosen = spark.range(1, numPartitions=1).mapInArrow(draw, "place long, at_ long")
    d = d.join(F.broadcast(starts), "part_").withColumn("at_", F.col("number_") + F.col("shift_"))
    return d.join(chosen, "at_").select("place", *rows.columns)


def sample_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of all columns (a sampling operator: the limit is the feature); the same ones however the rows are dealt."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns).limit(n)


def run_one(problem: dc.Problem, settings: dict) -> dc.Result:
    """The first algorithm of a settings document on a problem."""
    name, options = sorted(settings["algs"].items())[0]
    p = settings.get("problemInstance", {})
    algorithm = dc.DECOMPOSERS[name](iterations=p.get("iterations", 1), prune=p.get("pruneValue", 1e-5), **options)
    mode = "greedy" if p.get("greedyRefine") else "incremental" if "incremental" in p else "batched" if "batchSize" in p else "full"
    result = dc.decompose(problem, algorithm, mode)
    return result.top(p["subselectHighest"]) if p.get("subselectHighest") else result


# --- logs -----------------------------------------------------------------------------

LINE = r"^\[([^\]]+)\]: (\{.*\})$"
LOG = "msg string, type string, logTime string, it int, step string, basisSize long, timeSpent double, objectiveValue double, norm double"
#: Result files: iteration, step, what and by which algorithm.
RESULT_FILE = re.compile(r"it=(\d+)-(\d+)_(\w+?)(?:-([\w.]+?))?\.\w+$")


def read_log(lines: DataFrame) -> DataFrame:
    """Rows of ``[time]: {json}`` lines (run, line); other lines are left out."""
    d = lines.withColumn("at", F.to_timestamp(F.regexp_extract("line", LINE, 1), "yyyy-MM-dd HH:mm:ss"))
    d = d.withColumn("m", F.from_json(F.regexp_extract("line", LINE, 2), LOG)).where("m IS NOT NULL AND at IS NOT NULL")
    return d.select("run", "at", "m.*")


def format_log(at: Column, body: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("]: "), F.to_json(body))


def latest_times(log: DataFrame) -> DataFrame:
    """(run, it, step, timeSpent): the last row of each wins."""
    return log.groupBy("run", "it", "step").agg(F.max_by("timeSpent", "at").alias("timeSpent"))


def times_by_iteration(log: DataFrame) -> DataFrame:
    """(run, it, timeSpent), and for each run a total row with a null iteration."""
    return latest_times(log).rollup("run", "it").agg(F.sum("timeSpent").alias("timeSpent")).where("run IS NOT NULL")


def last_results(log: DataFrame) -> DataFrame:
    """(run, it, objective, basis): the state after the last step of each iteration."""
    return log.groupBy("run", "it").agg(F.max_by("objectiveValue", "at").alias("objective"), F.max_by("basisSize", "at").alias("basis"))


def status_counts(status: DataFrame, kinds: list[str]) -> DataFrame:
    """(name, one column a kind) of (name, status) rows, and a row of totals named ``total``."""
    per = status.groupBy("name").pivot("status", kinds).count().na.fill(0)
    total = per.agg(*(F.sum(k).alias(k) for k in kinds)).select(F.lit("total").alias("name"), *kinds)
    return per.unionByName(total)


def parse_result_name(name: str) -> dict | None:
    m = RESULT_FILE.search(name)
    return None if m is None else {"it": int(m[1]), "step": int(m[2]), "what": m[3], "alg": m[4]}


def write_progress(spark: SparkSession, result: dc.Result, path: str) -> None:
    rows = [(json.dumps(r | {"type": "newbasis", "msg": "new basis"}),) for r in result.log]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
