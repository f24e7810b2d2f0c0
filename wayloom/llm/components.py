"""Connected components of links by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table_files, materialise

PLAIN = 3


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable.  ``links`` has columns a and b.

    Each round every node takes the smallest label among its own and its neighbours';
    rounds end when nothing changes.  Stars and cliques, the usual shapes, end at once;
    from round PLAIN on, each node also takes its label's label, so that chains end after
    a logarithm of their length.  Labels and links stay in tables.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
    labels, turn = materialise(labels, "labels"), 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        if turn >= PLAIN:
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            step = step.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp"))
        step = materialise(step, "labels")
        drop_table_files(labels)
        changed = step.where("old <> comp").limit(1).count()
        labels = step.select("node", "comp")
        if not changed:
            drop_table_files(both)
            return labels
