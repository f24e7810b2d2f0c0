"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Every distinct pre-token of a batch becomes a row of ids, padded to its length bucket.
Each round every row merges its leftmost pair of minimum rank: pair ranks come from an
open-addressing hash table probed for whole arrays, the merged id is written, the row is
compacted by one column, and only the two ranks beside the merge are looked up again.
Rows without a mergeable pair leave the matrix.  A worker keeps encoded pre-tokens in a
bounded table that is emptied when full, so memory does not follow the corpus.

Defined results: a null text is empty and gives no ids; repeated rows each give their own
row; other columns of the input, whatever their names, are not carried; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, ragged, table

#: Rows times columns of one matrix.
MATRIX_CELLS = 1 << 16
#: Above this many columns the compaction moves row by row.
WIDE = 64
#: Encoded pre-tokens kept by a worker, and texts (in characters) encoded together.
CACHE_ROWS = 400_000
CHUNK_CHARS = 1 << 20
#: Rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Merges:
    """Pair ranks in an open-addressing table, and the bytes of every id."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        known = dict(ranks)
        self.whole = known
        pairs = [
            (known[t[:i]] << 32 | known[t[i:]], r)
            for t, r in ranks
            for i in range(1, len(t))
            if t[:i] in known and t[i:] in known
        ]
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        key = np.array([p[0] for p in pairs], np.int64)
        rank = np.array([p[1] for p in pairs], np.int32)
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several keys for a slot the last stays
            mine = self.keys[slot] == key
            self.ranks[slot[mine]] = rank[mine]
            key, rank, slot = key[~mine], rank[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)
        self.byte_id = np.array([known[bytes([b])] for b in range(256)], np.int32)
        by_id = {r: t for t, r in ranks}
        size = max(by_id) + 1
        self.length = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a negative id never merges."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, NEVER, np.int32)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self.slot(key.ravel()[ask])
        flat, key = out.ravel(), key.ravel()
        while len(ask):
            found = self.keys[slot]
            hit = found == key[ask]
            flat[ask[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            ask, slot = ask[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def merge_rows(self, ids: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All merges of padded rows (one column of ``ids`` each); (rows, ids, lengths) as rows finish."""
        done, row = [], np.arange(ids.shape[1])
        width = len(ids)
        place = np.arange(width, dtype=np.int64)[:, None]
        rank = np.full(ids.shape, NEVER, np.int64)
        rank[:-1] = self.lookup(ids[:-1].ravel(), ids[1:].ravel()).reshape(width - 1, -1)
        rank = rank << 32 | place  # rank first, then place: the minimum is the leftmost best pair
        never = np.int64(NEVER) << 32
        if width > WIDE:
            ids, rank = np.asfortranarray(ids), np.asfortranarray(rank)
        while len(row):
            best = rank.min(0)
            ended = best >= never
            if ended.any():
                done.append((row[ended], ids[:, ended], length[ended]))
                keep = ~ended
                row, length, best = row[keep], length[keep], best[keep]
                if not len(row):
                    break
                width = int(length.max())
                ids, rank = ids[:width, keep], rank[:width, keep]
                if width > WIDE:
                    ids, rank = np.asfortranarray(ids), np.asfortranarray(rank)
            every, at = np.arange(len(row)), best & 0xFFFFFFFF
            ids[at, every] = best >> 32
            if width > WIDE:
                for r, k in enumerate(at.tolist()):
                    ids[k + 1 : -1, r] = ids[k + 2 :, r]
                    rank[k:-1, r] = rank[k + 1 :, r] - 1
            else:
                low = int(at.min())
                for j in range(low, width - 1):
                    if j > low:
                        np.copyto(ids[j], ids[j + 1], where=at < j)
                    np.copyto(rank[j], rank[j + 1] - 1, where=at <= j)
            np.copyto(ids[width - 1], np.int32(-1), where=at < width - 1)
            rank[width - 1] = never | (width - 1)
            length = length - 1
            here = ids[at, every]
            right = np.where(at + 1 < width, ids[np.minimum(at + 1, width - 1), every], -1)
            left = np.where(at > 0, ids[np.maximum(at - 1, 0), every], -1)
            rank[at, every] = self.lookup(here, right).astype(np.int64) << 32 | at
            some = np.flatnonzero(at > 0)
            rank[at[some] - 1, some] = self.lookup(left[some], here[some]).astype(np.int64) << 32 | (at[some] - 1)
        return done

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of the ids of each text."""
        ids = ids.astype(np.int64)
        raw = ragged(self.flat, self.start[ids], self.length[ids])
        off = np.concatenate([[0], np.cumsum(self.length[ids])])[bounds].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one piece after the other, and the number for each."""
        count = np.zeros(len(pieces), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.array([self.whole.get(p, -1) for p in pieces], np.int64)
        easy = np.flatnonzero(whole >= 0)
        out.append((easy, whole[None, easy].astype(np.int32), np.ones(len(easy), np.int64)))
        size = np.array([len(p) for p in pieces], np.int64)
        hard = np.flatnonzero((whole < 0) & (size > 0))
        bucket = np.where(size[hard] <= 32, size[hard], 1 << np.ceil(np.log2(np.maximum(size[hard], 1))).astype(np.int64))
        for width in np.unique(bucket).tolist():
            rows = hard[bucket == width]
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in part), np.uint8)
                ids = np.ascontiguousarray(self.byte_id[raw].reshape(-1, width).T)
                ids[np.arange(width)[:, None] >= size[part][None, :]] = -1
                out += [(part[r], m, n) for r, m, n in self.merge_rows(ids, size[part])]
        for r, _, n in out:
            count[r] = n
        start = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for r, m, n in out:
            if len(r):
                place = np.arange(len(m))[:, None]
                inside = place < n[None, :]
                flat[(start[r][None, :] + place)[inside]] = m[inside]
        return flat, count


def aligned(pattern: str) -> tuple[str, str]:
    """The pattern with \\p{L} and \\p{N} as the tiktoken library knows them.

    The two regex engines may follow different Unicode versions; characters that only
    the Python engine counts as letters or numbers are taken out of its classes.  Second
    comes a class of these characters; texts without any are split by the pattern as it is.
    """
    found = ""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for cls in (r"\p{L}", r"\p{N}"):
        coder = tiktoken.Encoding(f"class {cls}", pat_str=cls, mergeable_ranks=single, special_tokens={})
        theirs = set(coder.decode_bytes(coder.encode_ordinary(every)).decode())
        extra = sorted(ord(c) for c in set(regex.findall(cls, every)) - theirs)
        runs: list[list[int]] = []
        for c in extra:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        if runs:
            if runs[0][0] < 256:
                raise ValueError("the pattern engines differ within Latin-1")
            out = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
            pattern = pattern.replace(cls, f"[{cls}--[{out}]]")
            found += out
    return pattern, f"[{found}]" if found else "(?!)"


class Places(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Texts to ids, with a bounded table of the pre-tokens met so far."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        own, odd = aligned(pattern)
        self.merges, self.find = Merges(ranks), regex.compile(pattern).findall
        self.odd, self.find_odd = re.compile(odd).search, regex.compile(own, regex.V1).findall
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # the odd characters are all beyond
        except UnicodeEncodeError:
            if self.odd(text):
                return self.find_odd(text)
        return self.find(text)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and their bounds."""
        if len(self.place) > CACHE_ROWS:
            self.forget()
        known, found = len(self.place), [self.split(t) for t in texts]
        bounds = np.cumsum([0, *map(len, found)])
        at = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(found)), np.int64, bounds[-1])
        if len(self.place) > known:
            new = itertools.islice(self.place, known, None)
            flat, count = self.merges.encode([p.encode() for p in new])
            self.flat = np.concatenate([self.flat, flat])
            self.count = np.concatenate([self.count, count])
        start = np.cumsum(self.count) - self.count
        count = self.count[at]
        ids = ragged(self.flat, start[at], count)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[bounds]


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    decoded: bool = False,
) -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, without special tokens.

    With ``decoded`` also the bytes that the ids decode to, from the same pass.
    """
    ranks = df.sparkSession.sparkContext.broadcast(
        read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    )  # a vocabulary file: its size does not depend on the data
    kind = df.schema[id_col].dataType

    def run(batches):
        coder = Encoder(ranks.value, pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            i = 0
            while i < len(keys):
                j, chars, part = i, 0, []
                while j < len(keys) and (j == i or chars < CHUNK_CHARS):
                    part.append(texts[j].as_py() or "")
                    chars += len(part[-1])
                    j += 1
                ids, bounds = coder.texts(part)
                out = [keys.slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    out.append(coder.merges.decode(ids, bounds))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])
                i = j

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind.simpleString()}, ids array<int>" + ", decoded binary" * decoded
    return out.mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(id, decoded binary): the bytes of every id, one after the other; null ids give none."""
    ranks = df.sparkSession.sparkContext.broadcast(
        read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    )
    kind = df.schema[id_col].dataType

    def run(batches):
        merges = Merges(ranks.value)
        for b in batches:
            lists = b.column(1)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            off = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), merges.decode(ids, off - off[0])], names=["id", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(run, f"id {kind.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    coded = encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
