"""License scans with a positional index of rare licence words.

The index maps every licence word to the templates and offsets where it stands.  A first
pass counts, over all documents, in how many each licence word occurs; the inverse of that
weighs the words.  In the second pass the words of a file that are among the highest-IDF
words of some template are looked up, each posting proposes a start (place minus offset),
and a start that all of a template's rarest words agree on is a candidate.  The candidate
is then compared word by word: its mandatory key phrases must stand in full, and the
IDF-weighted share of agreeing words must reach the template's threshold.  Templates that
are a single phrase are mandatory as a whole, so their places are exact and complete.

Defined results: a null or empty text has no words, no places (null first and last word),
no labels and score 0; repeated rows give repeated rows; other columns are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alphanumeric, string_chunks, table, words_of


@dataclass(frozen=True)
class Template:
    """``keys`` are (first, end) word places of the phrases that must stand in full."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(self.text.split()))

    def mandatory(self) -> np.ndarray:
        must = np.zeros(len(self.words), bool)
        for key in self.keys or (self.text,):
            k = key.split()
            for i in range(len(self.words) - len(k) + 1):
                if list(self.words[i : i + len(k)]) == k:
                    must[i : i + len(k)] = True
        return must


#: The three base phrases, then well-known sentences of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 0.8),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge"), 0.8),
    Template("mit-named", "released under the mit license", ("the mit license",), 0.6),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",), 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",), 0.8),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.6),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 0.8),
    Template("creative-commons", "this work is licensed under a creative commons attribution", ("creative commons",), 0.6),
    Template("spdx", "spdx license identifier", ()),
)
#: Rare words of a template that must agree on a start.
ANCHORS = 2


def word_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), alphanumeric())[-1]


class Vocabulary:
    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.words})
        h = word_hash(self.words)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word number, or -1 for a word of no template."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


class Index:
    """Postings of the anchors and the weights for verification."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, idf: np.ndarray):
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.templates, self.vocabulary = templates, vocabulary
        self.words = [np.array([number[w] for w in t.words]) for t in templates]
        self.must = [t.mandatory() for t in templates]
        self.weight = [idf[w] for w in self.words]
        # the rarest places of each template; mandatory ones, so that a candidate cannot lack them
        self.anchors = []
        for must, weight in zip(self.must, self.weight, strict=True):
            places = np.flatnonzero(must)
            self.anchors.append(places[np.lexsort((places, -weight[places]))][:ANCHORS])

    def scan(self, ids: np.ndarray, first: np.ndarray):
        """(template, document, start, score) of every match; ``ids`` are word numbers."""
        doc_of = np.searchsorted(first, np.arange(len(ids)), side="right") - 1 if len(ids) else np.zeros(0, np.int64)
        places = np.flatnonzero(ids >= 0)
        by_word = places[np.argsort(ids[places], kind="stable")]
        bound = np.searchsorted(ids[by_word], np.arange(len(self.vocabulary.words) + 1))
        for t, words in enumerate(self.words):
            start = None
            for a in self.anchors[t]:
                proposed = by_word[bound[words[a]] : bound[words[a] + 1]] - a
                start = proposed if start is None else np.intersect1d(start, proposed, assume_unique=True)
            if start is None or not len(start):
                continue
            # words that are not mandatory may lie beyond either end of the text
            at = start[:, None] + np.arange(len(words))[None, :]
            inside = (at >= 0) & (at < len(ids))
            at = np.clip(at, 0, len(ids) - 1)
            anchor_doc = doc_of[start + self.anchors[t][0]]
            same = inside & (doc_of[at] == anchor_doc[:, None]) & (ids[at] == words[None, :])
            score = (same * self.weight[t]).sum(1) / self.weight[t].sum()
            ok = same[:, self.must[t]].all(1) & (score >= self.templates[t].share - 1e-9)
            if ok.any():
                yield t, anchor_doc[ok], start[ok], score[ok]


def licence_idf(documents: DataFrame, text_col: str, vocabulary: Vocabulary) -> np.ndarray:
    """IDF of every licence word over all documents (one row a word reaches the driver)."""
    size = len(vocabulary.words)

    def run(batches):
        total, docs = np.zeros(size, np.int64), 0
        for b in batches:
            for _, data, off in string_chunks(b.column(0)):
                _, _, first, h = words_of(data, off, alphanumeric())
                ids = vocabulary.ids(h)
                at = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(first, at, side="right") - 1
                total += np.bincount(np.unique(doc * size + ids[at]) % size, minlength=size)
                docs += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(total, docs))], names=["word", "n"])

    rows = documents.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(size + 1)
    for r in rows:
        count[r.word] = r.n
    return np.log((1 + count[-1]) / (1 + count[:-1])) + 1


def scan_licenses(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """(id, n_words, matches array<struct<label, base, start, score>>) for every document."""
    vocabulary = Vocabulary(templates)
    index = Index(templates, vocabulary, licence_idf(documents, text_col, vocabulary))
    kind = documents.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            for i, data, off in string_chunks(b.column(1)):
                _, _, first, h = words_of(data, off, alphanumeric())
                found: list = [[] for _ in range(len(off) - 1)]
                for t, docs, starts, scores in index.scan(vocabulary.ids(h), first):
                    label, base = templates[t].label, templates[t].base
                    for d, s, x in zip(docs.tolist(), (starts - first[docs]).tolist(), scores.tolist(), strict=True):
                        found[d].append({"label": label, "base": base, "start": s, "score": min(1.0, x)})
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(off) - 1), pa.array(np.diff(first), pa.int64()), pa.array(found, match)],
                    names=["id", "n_words", "matches"],
                )

    d = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_words long, matches array<struct<label:string,base:boolean,start:long,score:double>>"
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.base)
    starts = F.transform(base, lambda m: m.start)

    def labels(c):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda m: m.label))), ",")

    return d.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0)).alias("score"),
    )
