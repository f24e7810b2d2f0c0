"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; every
stage but the last returns the columns of ``documents``.  ``run`` writes each stage's rows
as Parquet in the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.bpe import encode
from wayloom.llm.common import drop_table_files, marked, materialise, table
from wayloom.llm.decontaminate import find_contamination, is_contaminated
from wayloom.llm.lines import dedup_lines
from wayloom.llm.neardup import near_duplicates
from wayloom.llm.quality import classify, held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = classify(docs, labels, keep=tuple(c for c in docs.columns if c != "doc_id"), score_col="_pipeline_score")
    return scored.where("_pipeline_score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in two places or more, of any length, stay in their first place only; ``n_chars`` follows, if there is one."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of smallest id (one row, if it is repeated).

    Only rows whose id may be one to drop, or may be repeated, are moved.
    """
    classes = near_duplicates(docs).where("doc_id IS NOT NULL AND component IS NOT NULL")
    held = classes.groupBy("doc_id").agg(F.count("*").alias("_pipeline_rows"), F.min("component").alias("_pipeline_class"))
    held = materialise(held.where("_pipeline_rows > 1 OR _pipeline_class <> doc_id"), "pipeline-classes")
    alone = marked(docs, held, ["doc_id"], others=True)
    some = marked(docs, held, ["doc_id"]).join(held, "doc_id", "left")
    some = some.where("_pipeline_class IS NULL OR _pipeline_class = doc_id")
    repeated = some.where("_pipeline_rows > 1").dropDuplicates(["doc_id", "text"])
    some = some.where("_pipeline_rows IS NULL OR _pipeline_rows = 1").unionByName(repeated)
    return alone.unionByName(some.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), whole=True)
    return found.where(~is_contaminated()).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and the digest of the bytes they decode to."""
    coded = encode(docs, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("tokens", tokens),
]

#: The quality and token stages cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if k:
            drop_table_files(before)
    return STAGES[-1][1](spark, docs, sf_dir)
