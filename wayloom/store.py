"""Tables in the folder that all executors share, and objects that are sent to every task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir if it is set; else, on one machine only, a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"wayloom-{sc.applicationId}")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it again: iterations stay short and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/wayloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shipped:
    """A broadcast object of any class; unlike a plain broadcast, workers need not import its module."""

    def __init__(self, data: Broadcast):
        self.data, self.held = data, None

    def __reduce__(self):
        return Shipped, (self.data,)

    @property
    def value(self):
        if self.held is None:
            self.held = cloudpickle.loads(self.data.value)
        return self.held

    def unship(self) -> None:
        """Give the memory back once every job that uses the object has ended."""
        self.data.unpersist(blocking=False)
        self.held = None


def ship(spark: SparkSession, value) -> Shipped:
    """Broadcast ``value``; its size must be bounded, as that of any broadcast."""
    return Shipped(spark.sparkContext.broadcast(cloudpickle.dumps(value)))
