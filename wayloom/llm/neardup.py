"""Jaccard join of word n-gram sets by adaptive multi-match prefixes, and its classes.

1. A fixed-size array of counts, gathered over all documents, estimates in how many texts
   an n-gram occurs.  Its level (a power of two above the usual load) followed by the hash
   is the global order of n-grams: rare ones first.
2. Equal sets fold into one (by a 128-bit digest); classes give copies back at the end.
3. Every set takes a prefix in that order.  With threshold t, two similar sets share at
   least l n-grams within their first n - ceil(t n) + l ones.  Each document takes the l of
   least estimated cost (postings read, and candidates left after l matches); a pair needs
   the smaller l of the two.
4. Documents meet by prefix n-gram.  Matches are counted for each pair; a pair goes on if
   the count reaches l and, with all that may lie beyond the prefixes, the needed overlap.
5. An n-gram that many documents have in their prefix does not emit all pairs.  Its
   documents are compared to a pivot; what then is in another class than most of the
   n-gram's documents meets the others, but only where a run of shared crowded n-grams
   begins or ends, which suffices to count them.  Pairs pass two exact bounds (by their
   intersections with the pivot, and by the overlap that all prefix matches still allow)
   and are verified in full.  So no link between different classes is lost.
6. Candidates are verified by exact intersection of the whole n-gram sets of their texts;
   only texts of candidates move.  The links become classes by label propagation.

Defined results: a null or empty text has no set and is linked with nothing; a text of
fewer words than n has its whole sequence as one n-gram; equal texts are always linked;
ids are integers (others raise); rows with a null id are classed by themselves (null); rows that repeat an id are returned
as often; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import SCHEMA as CELL_ROWS
from .cells import gathered, packed, partition_number
from .common import drop_table_files, frugal, give_back, marked, materialise, mix, ship, space_separated, string_chunks, table, words_of
from .components import components

WORDS, PERCENT = 5, 75
#: Cells of the count array: an n-gram that makes up more than about one in CELLS of all counts as common.
CELLS = 1 << 24
#: Longest prefix extension; cost of a verification in postings.
MOST_MATCHES, VERIFY_COST = 4, 16.0
#: Documents of an n-gram that are paired at once; more are compared to a pivot.
PAIRED = 8
#: Words of 64 bits in a set's parity map.
SIGNS = 4
#: Pairs that a task gathers before it counts them; sets that it keeps while verifying.
HELD_PAIRS, HELD_SETS = 1 << 20, 64


def ngram_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    _, _, first, h = words_of(data, off, space_separated())
    size = np.diff(first)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(n + 1)]
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        grams += h[j : j + len(grams)] * factor[j]
    grams = mix(grams)
    out = []
    for a, w in zip(first[:-1].tolist(), size.tolist(), strict=True):
        if w >= n:
            out.append(np.unique(grams[a : a + w - n + 1]))
        elif w:
            short = sum(int(x) * int(f) for x, f in zip(h[a : a + w], factor, strict=False)) + w * int(factor[n])
            out.append(mix(np.array([short % (1 << 64)], np.uint64)))
        else:
            out.append(h[:0])
    return out


class Order:
    """Global order of n-grams: level of the estimated count, then hash."""

    def __init__(self, count: np.ndarray):
        self.usual = max(4.0, 2 * float(count.mean()))
        self.level = np.zeros(len(count), np.uint8)
        while (above := count > self.usual * 2.0 ** int(self.level.max())).any():
            self.level[above] += np.uint8(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Sorted keys of a set; the top byte is the level."""
        level = self.level[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
        return np.sort(level << np.uint64(56) | grams >> np.uint64(8))

    def excess(self, keys: np.ndarray) -> np.ndarray:
        """Estimated postings, beyond the usual ones, of each key."""
        return self.usual * (2.0 ** (keys >> np.uint64(56)).astype(np.float64) - 1)


def prefix(n: int, percent: int, matches: int) -> int:
    return min(n, n - -(-percent * n // 100) + matches)


def choose_matches(excess: np.ndarray, n: int, percent: int) -> int:
    """The number of matches whose prefix costs least; ``excess`` are counts in order."""
    total = np.concatenate([[0.0], np.cumsum(excess)])
    ends = [prefix(n, percent, m) for m in range(1, MOST_MATCHES + 1)]
    cost = [total[e] + VERIFY_COST * total[e] / (m * m) for m, e in enumerate(ends, 1)]
    best = int(np.argmin(cost)) + 1
    return min(best, n)


def parity(grams: np.ndarray) -> np.ndarray:
    """How often each of 64 * SIGNS bits is hit, modulo 2: sets differ in as many n-grams as their maps in bits, or more."""
    odd = np.bincount((mix(grams) & np.uint64(64 * SIGNS - 1)).astype(np.int64), minlength=64 * SIGNS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prepare(d: DataFrame, n: int, percent: int, order) -> DataFrame:
    """(id, n, digest, prefix keys, matches, words of the parity map)."""
    signs = [f"s{k}" for k in range(SIGNS)]

    def run(batches):
        o = order.value
        for b in batches:
            for i, data, off in string_chunks(b.column(1)):
                size, digest, prefixes, most, odd = [], [], [], [], []
                for grams in ngram_sets(data, off, n):
                    size.append(len(grams))
                    digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    odd.append(parity(grams))
                    if not len(grams):
                        prefixes.append(b"")
                        most.append(0)
                        continue
                    key = o.keys(grams)
                    matches = choose_matches(o.excess(key), len(key), percent)
                    key = key[: prefix(len(key), percent, matches)]
                    prefixes.append(key.tobytes())
                    most.append(matches)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, len(off) - 1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(most, pa.int32()),
                        *(pa.array(c) for c in np.stack(odd, axis=1)),
                    ],
                    names=["id", "n", "digest", "prefix", "matches", *signs],
                )

    return d.mapInArrow(frugal(run), "id long, n long, digest binary, prefix binary, matches int, " + ", ".join(f"{c} long" for c in signs))


def _postings(sets: DataFrame, crowded: bool) -> DataFrame:
    """(gram, id, n, matches): the prefixes, one n-gram a row; of crowded n-grams, or of the others."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            keys = [k[(k >> 56 > 0) == crowded] for k in keys]
            size = np.array([len(k) for k in keys])
            rest = [np.repeat(c.to_numpy(), size) for c in (b.column(0), b.column(1), b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(rest[0]), pa.array(rest[1].astype(np.int32)), pa.array(rest[2])],
                names=["gram", "id", "n", "matches"],
            )

    return sets.select("id", "n", "prefix", "matches").mapInArrow(run, "gram long, id long, n int, matches int")


def _counted(found: list) -> tuple:
    """Pairs with the number of their common n-grams, from (a, b, p, q) columns."""
    a, b, p, q = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b, p, q = a[order], b[order], p[order], q[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.diff(np.append(first, len(a))), p[first], q[first]


def _meet(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (kind 0: ids, common n-grams, sizes with matches) and crowded postings (kind 1: gram, id, n, matches).

    The postings come sorted by n-gram, so a task holds one n-gram that is still open,
    of at most PAIRED rows, and a bounded number of pairs.
    """

    def rows(kind, *columns):
        for i in range(0, len(columns[0]), 50_000):
            part = [pa.array(v[i : i + 50_000]) for v in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=["kind", "x", "y", "c", "p", "q"])

    def run(batches):
        held, found, many, crowded = [np.zeros(0, np.int64)] * 4, [], 0, None
        for b in _then_none(batches):
            gram, doc, n, matches = held if b is None else (np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True))
            if not len(gram):
                continue
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(starts, len(gram)))
            crowd = np.repeat(size > PAIRED, size) | (gram == crowded if crowded is not None else False)
            whole = len(gram) if b is None or crowd[-1] else starts[-1]  # the last n-gram may go on
            crowded = gram[-1] if crowd[-1] else None
            held = [v[whole:] for v in (gram, doc, n, matches)]
            crowd, gram, doc, n, matches = (v[:whole] for v in (crowd, gram, doc, n, matches))
            if crowd.any():
                yield from rows(1, gram[crowd], doc[crowd], n[crowd], matches[crowd], np.zeros(crowd.sum(), np.int64))
            gram, doc, n, matches = (v[~crowd] for v in (gram, doc, n, matches))
            at = np.arange(len(gram))
            for step in range(1, PAIRED):
                at = at[at + step < len(gram)]
                at = at[gram[at] == gram[at + step]]
                if not len(at):
                    break
                x, y = at, at + step
                swap = doc[x] > doc[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (doc[x] != doc[y])
                x, y = x[ok], y[ok]
                found.append(np.stack([doc[x], doc[y], n[x] << 8 | matches[x], n[y] << 8 | matches[y]]))
                many += len(x)
            if many > HELD_PAIRS:
                yield from rows(0, *_counted(found))
                found, many = [], 0
        if many:
            yield from rows(0, *_counted(found))

    return postings.mapInArrow(frugal(run), "kind int, x long, y long, c long, p long, q long")


def _then_none(batches):
    yield from batches
    yield None


def _counts(met: DataFrame) -> DataFrame:
    """(a, b, c, p, q): the common uncrowded prefix n-grams of each pair that has any."""
    d = met.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b"))
    return d.agg(F.sum("c").alias("c"), F.max("p").alias("p"), F.max("q").alias("q"))


def _candidates(counts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose matches reach both the multi-match count and the overlap still possible."""

    (n1, m1, r1), (n2, m2, r2) = _unpacked("p", percent), _unpacked("q", percent)
    # pairs that also share a crowded n-gram are decided there, so the count is complete here
    needed = F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent))
    return counts.where((F.col("c") >= F.least(m1, m2)) & (F.col("c") + F.greatest(r1, r2) >= needed)).select("a", "b")


def _unpacked(c: str, percent: int):
    """Size, matches, and n-grams beyond the prefix of a set."""
    n, matches = F.shiftright(c, 8), F.col(c).bitwiseAND(F.lit(255))
    return n, matches, n - F.least(n, n - F.ceil(F.lit(percent) * n / 100) + matches)


def _verified(pairs: DataFrame, d: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, link, same): whether the whole sets are similar, and the size of their intersection (null if an id has several texts)."""

    def packed_texts(batches):
        for b in batches:
            texts = [pa.compress(x, "zstd", asbytes=True) if len(x) else b"" for x in b.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()]
            size = pc.binary_length(b.column(1).cast(pa.large_binary())).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(texts, pa.binary())], names=["id", "size", "text"])

    def compare(batches):
        held: dict = {}

        def grams(key: int, size: int, text: bytes) -> np.ndarray:
            got = held.pop((key, size, text[-64:]), None)  # a checksum is among the last bytes
            if got is None:
                data = np.frombuffer(pa.decompress(text, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
                got = ngram_sets(data, np.array([0, size]), n)[0]
            held[key, size, text[-64:]] = got
            if len(held) > HELD_SETS:
                held.pop(next(iter(held)))
            return got

        for b in batches:
            link, both = [], []
            for i, j, p, q, u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = grams(i, p, u), grams(j, q, v)
                same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
                union = len(x) + len(y) - same
                link.append(100 * same >= percent * union and same > 0)
                both.append(same)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(link, pa.bool_()), pa.array(both, pa.int64())], names=["a", "b", "link", "same"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = marked(d.where("id IS NOT NULL"), ids, ["id"]).mapInArrow(frugal(packed_texts), "id long, size long, text binary")
    left = texts.select(F.col("id").alias("a"), F.col("size").alias("p"), F.col("text").alias("u"))
    right = texts.select(F.col("id").alias("b"), F.col("size").alias("q"), F.col("text").alias("v"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q", "u", "v")
    got = both.mapInArrow(frugal(compare), "a long, b long, link boolean, same long")
    # an id with several texts: the nearest counts
    return materialise(got.groupBy("a", "b").agg(F.max("link").alias("link"), F.when(F.count("*") == 1, F.max("same")).alias("same")), "verified")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _open_pairs(candidates: DataFrame, comp: DataFrame) -> DataFrame:
    """Candidates between different classes."""
    for c in ("a", "b"):
        candidates = candidates.join(comp.select(F.col("node").alias(c), F.col("comp").alias(f"class_{c}")), c, "left")
    return candidates.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")


def _mixed_pairs(counts: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs with common uncrowded n-grams that may be similar if they share crowded ones as well."""
    for c in ("a", "b"):
        counts = counts.join(size.select(F.col("id").alias(c), F.col("h").alias(f"h_{c}")), c, "left")
    (n1, _, r1), (n2, _, r2) = _unpacked("p", percent), _unpacked("q", percent)
    reach = F.col("c") + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0))) + F.greatest(r1, r2)
    return counts.where(reach >= F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent))).select("a", "b")


def _state(hot: DataFrame, comp: DataFrame) -> DataFrame:
    state = hot.join(comp.withColumnRenamed("node", "id"), "id", "left")
    return state.withColumn("comp", F.coalesce("comp", "id"))


def _pivots(hot: DataFrame) -> DataFrame:
    """(gram, id2, n2) for crowded n-grams.

    A pivot is a document with few uncrowded n-grams, as it lies in the middle of its copies.
    """
    lot = F.struct("cold", F.xxhash64("id").alias("lot"), F.col("id"), F.col("n"))
    return hot.groupBy("gram").agg(F.min(lot).alias("pivot")).select("gram", F.col("pivot.id").alias("id2"), F.col("pivot.n").alias("n2"))


def _fits(percent: int):
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent


def _undecided(state: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """All pairs of a crowded n-gram's documents that are in different classes and may be similar.

    One of the two is outside the class that most documents of the n-gram are in, so only
    those outside meet all.  The crowded n-grams that two documents share form runs in
    their lists; a pair has a row where a run begins or ends, and the places there add up
    to the number of shared ones.  A pair goes on if that number, its uncrowded matches and
    what lies beyond the prefixes allow the needed overlap, and so do the two intersections
    with a common pivot (what both have of it, and what both have beside it) and the parity
    maps of the whole sets (n-grams that only one of the two has).
    """
    state = materialise(state, "crowded-classes")
    usual = state.groupBy("gram", "comp").agg(F.count("*").alias("many")).groupBy("gram").agg(F.max_by("comp", F.struct("many", "comp")).alias("usual"))
    every = materialise(state.join(usual, "gram").withColumn("outside", F.col("comp") != F.col("usual")).drop("usual"), "crowded-outside")
    two = every.select("gram", *(F.col(c).alias(f"{c}2") for c in every.columns if c != "gram"))
    needed = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / (100 + percent))
    begins, ends = (~F.coalesce(F.col(c) == F.col(f"{c}2"), F.lit(False)) for c in ("before", "after"))
    met = every.where("outside").join(two, "gram").where((F.col("comp") != F.col("comp2")) & (~F.col("outside2") | (F.col("id") < F.col("id2"))))
    # a row that breaks a bound speaks against its pair, wherever the pair's other rows are
    most = F.least("place", "place2") + F.least(F.col("h") - F.col("place"), F.col("h2") - F.col("place2"))
    apart = F.coalesce(F.least("same", "same2") + F.least(F.col("n") - F.col("same"), F.col("n2") - F.col("same2")) < needed, F.lit(False))
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}2"))) for k in range(SIGNS)), F.lit(0))
    apart = apart | F.coalesce(differ > F.col("n") + F.col("n2") - 2 * needed, F.lit(False))
    met = met.where(_fits(percent) & (most + F.greatest("rest", "rest2") >= needed) & ~apart & (begins | ends))
    place = F.when(F.col("id") < F.col("id2"), F.col("place")).otherwise(F.col("place2"))  # the same document's in every row
    shared = F.when(ends, place + 1).otherwise(0) - F.when(begins, place).otherwise(0)
    both = met.groupBy(*_pair("id", "id2")).agg(
        F.sum(shared).alias("crowded"), F.greatest(F.max("rest"), F.max("rest2")).alias("beyond"), (F.max("n") + F.max("n2")).alias("sizes")
    )
    needed = F.ceil(F.lit(percent) * F.col("sizes") / (100 + percent))
    reach = F.col("crowded") + F.coalesce("c", F.lit(0)) + F.col("beyond")
    return both.join(counts.select("a", "b", "c"), ["a", "b"], "left").where(reach >= needed).select("a", "b")


def _chosen(every: DataFrame, first: DataFrame) -> DataFrame:
    """One row of each set: only rows whose digest may stand twice are moved."""
    repeated = materialise(first.where("rows > 1").select("digest", F.col("first").alias("id")), "repeated-sets")
    alone = marked(every, repeated, ["digest"], others=True).where("id IS NOT NULL")
    # a row whose digest only looks like a repeated one has no partner
    several = marked(every, repeated, ["digest"]).join(repeated.withColumnRenamed("id", "only"), "digest", "left")
    several = several.where("id IS NOT NULL AND (only IS NULL OR id = only)").drop("only").dropDuplicates(["digest", "id"])
    return alone.select(*every.columns).unionByName(several.select(*every.columns))


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component): component is the smallest id reachable by links."""
    spark = documents.sparkSession
    if not isinstance(documents.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        total = np.zeros(CELLS, np.uint8)  # a task counts to 255
        for b in batches:
            for _, data, off in string_chunks(b.column(0)):
                at, many = np.unique(np.concatenate(ngram_sets(data, off, n)) & np.uint64(CELLS - 1), return_counts=True)
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + many, 255)
        yield from packed(total, partition_number(), np.uint32)

    counts = gathered(d.select("text").mapInArrow(frugal(count), CELL_ROWS), CELLS, np.uint32, "sum")
    order = ship(spark, Order(counts))  # CELLS cells, whatever the input
    del counts
    give_back()
    every = materialise(_prepare(d, n, percent, order), "prefixes")
    order.unship()
    first = materialise(every.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "sets")
    chosen = materialise(_chosen(every.where("n > 0"), first), "chosen")
    met = _meet(_postings(chosen, False).repartition(tasks, "gram").sortWithinPartitions("gram"), percent)
    met = materialise(met, "met")
    hot = met.where("kind = 1").select(F.col("x").alias("gram"), F.col("y").alias("id"), F.col("c").cast("int").alias("n"), F.col("p").cast("int").alias("matches"))
    hot = hot.unionByName(_postings(chosen, True))
    counts = materialise(_counts(met), "counts")
    # the place of a crowded n-gram in its document's list, and its neighbours there
    row, whole = Window.partitionBy("id", "n").orderBy("gram"), Window.partitionBy("id", "n")
    length = F.least("n", F.col("n") - F.ceil(F.col("n") * percent / 100) + F.max("matches").over(whole)).cast("long")
    hot = hot.distinct().select(
        "gram", "id", "n", F.row_number().over(row).cast("long").alias("place"), F.lag("gram").over(row).alias("before"), F.lead("gram").over(row).alias("after"),
        F.count("*").over(whole).alias("h"), (length - F.count("*").over(whole)).alias("cold"), (F.col("n") - length).alias("rest"),
    )
    hot = materialise(hot.withColumn("place", F.col("place") - 1), "crowded")
    # the parity maps of crowded documents; none where an id has several texts
    signs = chosen.select("id", "n", *(f"s{k}" for k in range(SIGNS))).join(hot.select("id", "n").distinct(), ["id", "n"])
    signs = signs.groupBy("id", "n").agg(*(F.when(F.count("*") == 1, F.max(f"s{k}")).alias(f"s{k}") for k in range(SIGNS)))
    signs = materialise(signs, "parity")
    drop_table_files(met)
    drop_table_files(chosen)
    size = materialise(hot.groupBy("id").agg(F.max("h").alias("h")), "crowded-sizes")
    pivots = materialise(_pivots(hot), "pivots")
    compared = hot.join(pivots, "gram").where(_fits(percent) & (F.col("id") != F.col("id2"))).select(*_pair("id", "id2"))
    pairs = materialise(_candidates(counts, percent).unionByName(compared).distinct(), "pairs")
    seen = _verified(pairs, d, n, percent)
    links = seen.where("link").select("a", "b")
    comp = components(links)
    same = F.when(F.col("id") == F.col("id2"), F.when(F.col("n") == F.col("n2"), F.col("n"))).otherwise(F.col("same")).cast("long").alias("same")
    near = hot.join(pivots, "gram").withColumns({"a": F.least("id", "id2"), "b": F.greatest("id", "id2")})
    near = near.join(seen.select("a", "b", "same"), ["a", "b"], "left").select(*hot.columns, same)
    more = _open_pairs(_mixed_pairs(counts, size, percent), comp).unionByName(_undecided(_state(near, comp).join(signs, ["id", "n"]), counts, percent)).distinct()
    more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        again = _verified(more, d, n, percent)
        comp = components(links.unionByName(again.where("link").select("a", "b")))
        drop_table_files(again)
    for t in (seen, pairs, more, pivots, size, hot, counts, signs):
        drop_table_files(t)
    classes = first.join(comp.select(F.col("node").alias("first"), "comp"), "first", "left")
    classes = classes.select("digest", F.coalesce("comp", "first").alias("component"))
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    out = every.select("id", "n", "digest").join(classes, "digest", "left")
    out = materialise(out.select(F.col("id").cast(documents.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), own.alias("component")), "classes")
    for t in (every, first, comp):
        drop_table_files(t)
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.withColumnRenamed("component", "component_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
