"""Benchmark decontamination with an FM-index for every training shard.

A task reads its documents shard by shard.  The words of a shard become symbols of the
phrases' alphabet; a word that no phrase has separates, and runs shorter than the
shortest phrase cannot hold one, so neither enters the index.  Over the remaining symbols
the task builds a suffix array by prefix doubling (each separator ranks by its place, so
comparisons end there), the Burrows-Wheeler transform in a wavelet matrix of packed bits
with popcount ranks, and suffix positions sampled at every STEP-th symbol and at the start
of each run.  All phrases are searched backward at once; their rows are located by walking
back to a sampled position; the occurrences are merged into removal spans.

The phrases are broadcast in blocks of at most BLOCK_CHARS characters; several blocks are
several passes whose spans are merged by document row.

Defined results: a null or empty text has no words, no hits and is not contaminated; items
without words or id are no phrases; a repeated item id counts once; repeated documents give
repeated rows; other columns are not carried; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alphanumeric, frugal, materialise, ship, string_chunks, table, words_of

WINDOW = 13
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 32 << 20
#: Symbols of an index; texts (bytes) of a shard; distance of sampled positions.
SHARD_SYMBOLS, SHARD_BYTES, STEP = 1 << 20, 32 << 20, 16

OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Bits:
    """Packed bits with ranks by popcount."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet matrix: ranks and access for whole arrays of places."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for d in range(self.depth - 1, -1, -1):
            bit = (seq >> d) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(seq) - self.levels[-1].ones)
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            r = level.rank1(i)
            i = np.where(one, self.zeros[k] + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.descend(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``i`` and their ranks before ``i``."""
        symbol = np.zeros(len(i), np.int64)
        for k, level in enumerate(self.levels):
            one, r = level.get(i), level.rank1(i)
            symbol = symbol << 1 | one
            i = np.where(one, self.zeros[k] + r, i - r)
        return symbol, i - self.start[symbol]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order; every 0 is a separator of its own that ranks by its place."""
    n = len(seq)
    cut = np.cumsum(seq == 0)
    rank = np.where(seq == 0, cut - 1, seq.astype(np.int64) + cut[-1])
    order = np.argsort(rank, kind="stable")
    first = rank[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while True:
        # groups of equal rank that are still to be ordered by the next h symbols
        alone = np.concatenate([new, [True]])
        todo = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(todo):
            return order
        at = order[todo]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        by = np.lexsort((nxt, rank[at]))
        at, nxt = at[by], nxt[by]
        order[todo] = at
        own = rank[at]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        new[todo] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, todo, 0))
        h *= 2


class FMIndex:
    """Backward search and location over symbols; seq begins and ends with the separator 0."""

    def __init__(self, seq: np.ndarray, symbols: int):
        order = suffix_array(seq)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.bwt = Wavelet(np.where(order > 0, seq[order - 1], 0), symbols)
        begins = np.concatenate([[False], seq[:-1] == 0])
        kept = (order % STEP == 0) | begins[order]
        self.marked, self.sample, self.size = Bits(kept), order[kept], len(seq)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi of the suffixes that begin with each (left-padded) phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((k < length) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - k]
            lo[live] = self.below[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.below[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            hit = self.marked.get(at)
            out[todo[hit]] = self.sample[self.marked.rank1(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.bwt.access(at)
            at = self.below[symbol] + before
            steps += 1
        return out


class Phrases:
    """Distinct windows of the items over an alphabet of word hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple, set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            data = np.frombuffer(text.encode(), np.uint8)
            *_, h = words_of(data, np.array([0, len(data)]), alphanumeric())
            w = tuple(h.tolist())
            for j in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(w[j : j + window], set()).add(k)
        self.vocabulary = np.array(sorted({x for w in owners for x in w}), np.uint64)
        self.length = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.length.min()) if len(owners) else 0
        self.rows = np.zeros((len(owners), window), np.int64)
        for r, w in enumerate(owners):
            self.rows[r, window - len(w) :] = np.searchsorted(self.vocabulary, np.array(w, np.uint64)) + 1
        self.owner_start = np.cumsum([0, *(len(o) for o in owners.values())])
        self.owner = np.array([k for o in owners.values() for k in sorted(o)], np.int64)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == h, at + 1, 0) if len(self.vocabulary) else np.zeros(len(h), np.int64)


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.n_words, self.parts = phrases, [], [], []
        self.held = self.bytes = self.words = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> None:
        _, _, first, h = words_of(data, off, alphanumeric())
        self.rows.append(rows)
        self.n_words.append(np.diff(first))
        self.bytes += len(data)
        if len(self.phrases.vocabulary) and len(h):
            sym = self.phrases.symbols(h)
            inside = sym > 0
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            edge = first[(first > 0) & (first < len(h))]
            begin[edge] = inside[edge]
            end = inside.copy()
            end[:-1] &= ~inside[1:]
            end[edge - 1] = inside[edge - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            long = e - s >= self.phrases.shortest
            s, e = s[long], e[long]
            if len(s):
                n = e - s
                skip = np.repeat(s - np.concatenate([[0], np.cumsum(n + 1)[:-1]]) - 1, n + 1)
                place = np.arange(len(skip)) + skip  # one before each run is its separator
                head = np.cumsum(n + 1) - (n + 1)
                cut = np.zeros(len(place), bool)
                cut[head] = True
                part = np.where(cut, 0, sym[np.maximum(place, 0)])
                self.parts.append((part, place + self.words))
                self.held += len(part)
        self.words += len(h)

    def full(self) -> bool:
        return self.held >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def results(self) -> pa.RecordBatch:
        n_words = np.concatenate(self.n_words)
        bound = np.concatenate([[0], np.cumsum(n_words)])
        n_hit = np.zeros(len(n_words), np.int64)
        items: list = [[]] * len(n_words)
        spans: list = [[]] * len(n_words)
        if self.parts:
            seq = np.concatenate([*(p for p, _ in self.parts), [0]])  # ends with a separator, too
            place = np.concatenate([p for _, p in self.parts])
            p = self.phrases
            index = FMIndex(seq, len(p.vocabulary) + 1)
            lo, hi = index.search(p.rows, p.length)
            found = np.flatnonzero(hi > lo)
            which = np.repeat(found, (hi - lo)[found])
            if len(which):
                rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[found], hi[found], strict=True)])
                start = place[index.locate(rows)]
                doc = np.searchsorted(bound, start, side="right") - 1
                by = np.argsort(start, kind="stable")
                s, e, d = start[by], (start + p.length[which])[by], doc[by]
                reach = np.maximum.accumulate(e)
                apart = np.concatenate([[True], s[1:] > reach[:-1]]) | np.concatenate([[True], d[1:] != d[:-1]])
                heads = np.flatnonzero(apart)
                s, d = s[heads], d[heads]
                e = reach[np.concatenate([heads[1:], [len(reach)]]) - 1]
                np.add.at(n_hit, d, e - s)
                for k in np.unique(d):
                    spans[k] = []
                for k, a, b in zip(d.tolist(), (s - bound[d]).tolist(), (e - bound[d]).tolist(), strict=True):
                    spans[k].append({"start": a, "end": b})
                pair = np.unique(doc * len(p.rows) + which)
                for k, w in zip((pair // len(p.rows)).tolist(), (pair % len(p.rows)).tolist(), strict=True):
                    if not items[k]:
                        items[k] = set()
                    items[k].update(p.owner[p.owner_start[w] : p.owner_start[w + 1]].tolist())
                for k in np.unique(doc):
                    items[k] = sorted({p.items[i] for i in items[k]})
        return pa.RecordBatch.from_arrays(
            [
                *(pa.concat_arrays(c) for c in zip(*(r.columns for r in self.rows), strict=True)),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            names=[*self.rows[0].schema.names, "n_words", "n_hit", "items", "spans"],
        )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).dropna()
    size = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_CHARS))
    return [b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)] if n > 1 else [b]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    whole: bool = False,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans): removal spans in words, ends excluded.

    ``whole`` gives the documents' columns as a struct ``row`` in place of the id.
    """
    spark = documents.sparkSession
    carried = F.struct(*(F.col(c) for c in documents.columns)) if whole else F.col(id_col)
    d = documents.select(carried.alias("id"), F.col(text_col).cast("string").alias("text"))
    name = "row" if whole else id_col

    def passed(block: DataFrame) -> DataFrame:
        phrases = ship(spark, Phrases([(r.i, r.t) for r in block.collect()], window))

        def run(batches):
            shard = Shard(phrases.value)
            for b in batches:
                for i, data, off in string_chunks(b.column(1)):
                    shard.add(b.select([0]).slice(i, len(off) - 1), data, off)
                    if shard.full():
                        yield shard.results()
                        shard = Shard(phrases.value)
            if shard.rows:
                yield shard.results()

        return d.mapInArrow(frugal(run), f"id {d.schema['id'].dataType.simpleString()}, {OUT}")

    blocks = _blocks(benchmark, item_col, item_text_col)
    if len(blocks) == 1:
        return passed(blocks[0]).withColumnRenamed("id", name)
    kept = materialise(d.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    d = kept.select(F.col("row").alias("id"), "text")
    parts = [passed(b) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform("spans", lambda s: F.sequence(s.start, s.end - 1))))))).alias("w"),
    )
    heads = F.filter("w", lambda x, i: F.coalesce(F.get(F.col("w"), i - 1) != x - 1, F.lit(True)))
    tails = F.filter("w", lambda x, i: F.coalesce(F.get(F.col("w"), i + 1) != x + 1, F.lit(True)))
    spans = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    got = got.withColumnRenamed("id", "row").join(kept.select("row", "id"), "row")
    return got.select(F.col("id").alias(name), "n_words", F.size("w").cast("long").alias("n_hit"), "items", spans.alias("spans"))


def is_contaminated():
    """The contamination rule: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "spans",
    )
