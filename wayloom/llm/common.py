"""Shared helpers: table access, shared-folder materialisation, vectorised words."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_folder, ship  # noqa: F401  (operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wayloom-{name}-{uuid.uuid4().hex}"


#: Held while a table is written: shuffle files go when their job has ended, and a batch
#: that Python gets is bounded by bytes, however long the texts are.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table_files(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return what this process has freed to the system; a worker would hold it until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def frugal(run):
    """``run`` over a task's batches; what it has freed goes back when the task ends."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Bits of the map that says which rows may be wanted, a power of two (a word of 64 bits a broadcast row, 1 M rows at most).
MARKS = 1 << 26


def marked(rows: DataFrame, wanted: DataFrame, columns: list[str], others: bool = False) -> DataFrame:
    """Rows whose ``columns`` may be among ``wanted``; ``others``: the rest, which surely are not.

    A map of at most MARKS bits goes to every task.  Rows of equal hash pass as well, and with
    very many wanted keys all rows do, so a join with ``wanted`` decides.
    """

    def place(d: DataFrame) -> DataFrame:
        # no division: its result may be null for Spark, which then hashes every row once more to look
        h = F.xxhash64(*columns).bitwiseAND(F.lit(MARKS - 1))
        return d.withColumns({"mark_word": F.shiftright(h, 6), "mark_bit": F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))})

    bits = place(wanted.select(*columns)).groupBy("mark_word").agg(F.bit_or("mark_bit").alias("mark_bits"))
    d = place(rows).join(F.broadcast(bits), "mark_word", "left" if others else "inner")  # MARKS bits
    hit = F.col("mark_bits").bitwiseAND(F.col("mark_bit")) != 0
    return d.where(~F.coalesce(hit, F.lit(False)) if others else hit).select(*rows.columns)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vectorised words -------------------------------------------------------------

#: Odd 64-bit constants of the word hash.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Words of more bytes are hashed in another way.
LONG = 256
#: Texts are handled in groups of whole texts of about this many bytes.
CHUNK_BYTES = 1 << 19


def space_separated() -> np.ndarray:
    """Byte table of `[^\\x20\\x09-\\x0D]`."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def alphanumeric() -> np.ndarray:
    """Byte table of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, for lower-cased text."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX2)
    return h ^ (h >> np.uint64(31))


_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def string_chunks(column: pa.Array):
    """(first row, bytes, offsets) for groups of whole texts; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES)))
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray, kind: np.ndarray, hashed: bool = True):
    """Words of several texts: starts, ends (bytes), first word of each text, hashes.

    ``data`` holds the texts one after the other, ``off`` their bounds; A-Z are
    lower-cased first.  The returned word bounds array has one more entry than texts.
    """
    n = len(data)
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    m = kind[low]
    start, end = m.copy(), m.copy()
    if n:
        start[1:] &= ~m[:-1]
        end[:-1] &= ~m[1:]
        inner = off[(off > 0) & (off < n)]
        start[inner] = m[inner]
        end[inner - 1] = m[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(s, off)
    if not hashed:
        return s, e, first, low
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[e] - total[s]) * down[s]
    for k in np.flatnonzero(e - s > LONG):  # a polynomial modulo 2**64 is no good hash of very long words
        h[k] = int.from_bytes(hashlib.blake2b(low[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return s, e, first, mix(h ^ ((e - s).astype(np.uint64) * np.uint64(MIX2)))


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start+length], one after the other."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    return flat[np.arange(total) + shift]
