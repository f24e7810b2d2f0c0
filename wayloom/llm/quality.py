"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

Fitting takes a bounded sample of labelled documents (SAMPLE rows of each label at most,
by smallest hash of the id; a documented bound of the model), builds weighted hashed
features of their whole texts, and reduces them by a truncated singular value decomposition
to latent-semantic vectors.  The vectors, their labels and the projection are broadcast:
their size is fixed by the parameters.  Scoring projects every document and computes its
exact cosines with all labelled vectors block by block; the NEIGHBOURS nearest vote with
the weight of their similarity.

Features of a text: hashed byte trigrams (case kept), hashed pairs of character classes a
word shows, and a few shares (repeated words, repeated lines, capitals, symbols) in bands.
Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has the zero vector, whose score is the share of
label 1 in the sample; labels that are null or not 0 or 1 are left out; documents that
appear repeatedly are each scored; other columns are not carried; without labelled
documents of both kinds every score is the share of label 1, or 1.0 if there is no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, give_back, mix, ship, space_separated, string_chunks, table, words_of

#: Labelled documents of each label that are fitted, at most.
SAMPLE = 1024
#: Hashed features, latent dimensions, voting neighbours, sharpness of the weights.
FEATURES, DIMENSIONS, NEIGHBOURS, SHARPNESS = 1 << 13, 64, 15, 4.0
#: Weight of the share of label 1 beside the neighbours' (15 at most): thin texts lean on it.
PRIOR = 1.0
#: Documents scored at once.
BLOCK = 256


def shares(data: np.ndarray, off: np.ndarray, s, e, first, h) -> np.ndarray:
    """Per text: shares of repeated words, of words in repeated lines, capitals, symbols, digits, long words."""
    n = len(off) - 1
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    size = np.maximum(np.diff(off), 1)
    text = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, 6))
    kinds = np.zeros(256, np.int64)
    kinds[65:91] = 1
    kinds[list(b"#*$%&|<>!")] = 2
    kinds[48:58] = 3
    for k in (1, 2, 3):
        out[:, k] = np.bincount(text, kinds[data] == k, minlength=n) / size
    if len(h):
        order = np.lexsort((h, doc))
        dup = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])])
        out[:, 0] = np.bincount(doc[order], dup, minlength=n) / np.maximum(words, 1)
        tri = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
        tdoc = doc[: len(tri)]
        order = np.lexsort((tri, tdoc))
        dup = np.concatenate([[False], (tri[order][1:] == tri[order][:-1]) & (tdoc[order][1:] == tdoc[order][:-1])])[: len(tri)]
        out[:, 4] = np.bincount(tdoc[order], dup, minlength=n) / np.maximum(words, 1)
        out[:, 5] = np.bincount(doc, (e - s) > 20, minlength=n) / np.maximum(words, 1)
    return out


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unweighted feature rows (float32) of several texts."""
    n = len(off) - 1
    s, e, first, h = words_of(data, off, space_separated())
    rows = np.zeros((n, FEATURES), np.float32)
    if len(data) > 2:
        d = data.astype(np.uint32)
        gram = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
        gram = (gram >> np.uint32(32 - 12)).astype(np.int64)
        text = np.repeat(np.arange(n), np.diff(off))
        ok = text[:-2] == text[2:]
        count = np.bincount(text[:-2][ok] * 4096 + gram[ok], minlength=n * 4096)
        rows[:, :4096] = np.log1p(count.reshape(n, 4096))
    if len(s):
        # class of the first and the last two bytes of a word: lower, upper, digit, accented, mark
        cls = np.full(256, 4, np.int64)
        cls[97:123], cls[65:91], cls[48:58], cls[128:] = 0, 1, 2, 3
        a, b, c = cls[data[s]], cls[data[e - 1]], cls[data[np.maximum(e - 2, s)]]
        shape = ((a * 5 + b) * 5 + c) * 8 + np.minimum((e - s) // 4, 7)
        doc = np.repeat(np.arange(n), np.diff(first))
        count = np.bincount(doc * 1024 + shape, minlength=n * 1024).reshape(n, 1024)
        rows[:, 4096 : 4096 + 1024] = 4 * np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1))
    part = shares(data, off, s, e, first, h)
    rows[:, 5120:5126] = 4 * np.sqrt(part)
    return rows


class Model:
    """Projection, labelled latent vectors and their labels; the feature rows are overwritten."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 1.0
        self.labels = labels.astype(np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.project = None
            return
        seen = (rows[:, :4096] > 0).sum(0)
        self.weight = np.ones(FEATURES, np.float32)
        self.weight[:4096] = np.log((1 + len(rows)) / (1 + seen))
        x = self.weighted(rows, rows)
        value, vector = np.linalg.eigh((x @ x.T).astype(np.float64))
        top = np.argsort(-value)[:DIMENSIONS]
        top = top[value[top] > 1e-9]
        # right singular vectors: X' U / s
        vector = vector[:, top] / np.sqrt(value[top])
        self.project = np.zeros((FEATURES, len(top)), np.float32)
        for k in range(0, FEATURES, 512):  # in columns: the whole product would copy x in double precision
            self.project[k : k + 512] = x[:, k : k + 512].T @ vector
        self.vectors = self.unit(x @ self.project)

    def weighted(self, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        x = np.multiply(rows, self.weight, out=out)
        grams = x[:, :4096]
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        x[:, 4096:] *= 0.5
        return x

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.project is None:
            return np.full(len(rows), self.prior)
        v = self.unit(self.weighted(rows) @ self.project)
        cosine = v @ self.vectors.T
        k = min(NEIGHBOURS, int(np.bincount(self.labels.astype(int), minlength=2).min()))  # the rarer label can win
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        vote = ((sim * self.labels[near]).sum(1) + PRIOR * self.prior) / (sim.sum(1) + PRIOR)
        return np.where(rows.any(1), vote, self.prior)


def fit(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` documents of each label, whole texts."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("label = 0").orderBy(*order).limit(sample).unionByName(known.where("label = 1").orderBy(*order).limit(sample))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "id")  # 2 * sample ids at most

    def run(batches):
        for b in batches:
            for i, data, off in string_chunks(b.column(1)):
                rows = features(data, off)
                at = [np.flatnonzero(r).astype(np.int16) for r in rows]
                part = b.slice(i, len(off) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.string()),
                        part.column(2),
                        pa.array([a.tobytes() for a in at], pa.binary()),
                        pa.array([r[a].tobytes() for r, a in zip(rows, at, strict=True)], pa.binary()),
                    ],
                    names=["id", "label", "at", "value"],
                )

    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))  # repeated rows count once
    got = texts.select("id", "text", "label").mapInArrow(frugal(run), "id string, label int, at binary, value binary").collect()
    got = sorted(got, key=lambda r: (r.label, r.id))
    rows = np.zeros((len(got), FEATURES), np.float32)
    for k, r in enumerate(got):
        rows[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float32)
    known, got = np.array([r.label for r in got], np.int64), None
    model = Model(rows, known)
    del rows
    give_back()
    return model


def classify(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    keep: tuple[str, ...] = (),
    fitted_on: DataFrame | None = None,
    score_col: str = "score",
) -> DataFrame:
    """(id, ``keep`` columns, ``score_col``): the voted share of label 1 for every whole text.

    The model is fitted on the labelled rows of ``fitted_on`` (``documents`` if none).
    """
    model = ship(
        documents.sparkSession, fit(documents if fitted_on is None else fitted_on, labels, id_col, text_col, label_col, sample)
    )  # fixed size: FEATURES * DIMENSIONS weights and 2 * sample vectors
    d = documents.select(F.col(text_col).cast("string").alias("text_"), F.col(id_col).alias("id_"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    schema = d.select("id_", *(f"keep_{c}" for c in keep)).schema.add("score", "double")

    def run(batches):
        for b in batches:
            for i, data, off in string_chunks(b.column(0)):
                rest = b.slice(i, len(off) - 1)
                scores = [model.value.score(features(data[off[j] : off[k]], off[j : k + 1] - off[j])) for j in range(0, len(off) - 1, BLOCK) for k in [min(j + BLOCK, len(off) - 1)]]
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(np.concatenate(scores))], names=schema.names)

    out = d.mapInArrow(frugal(run), schema)
    return out.select(F.col("id_").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), F.col("score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    d = classify(table(spark, sf_dir, "documents"), labels)
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
