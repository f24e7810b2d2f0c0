"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines (white space trimmed) are linked if they are equal, or if their words differ by as
many edits (insertion, deletion, substitution of a word) as EDITS allows the shorter one:
none below 8 words, one from 8 and two from 40 words on.  Classes are what links connect.

1. A line of n words with a threshold of t is cut into t + 1 segments by places that depend
   on n only.  t edits leave a segment intact.  The index has a key for each segment and
   length; a longer line probes the lengths that it may be linked with, at the shifts that t
   allows (a segment's edits on its left bound the shift from the start, those on its right
   the shift from the end).
2. Keys that few lines share give candidate pairs.  The lines of a crowded key are keyed
   anew by the bags of their words, dealt by hash into 2 t + 1 parts: t edits touch 2 t of
   them at most.  Of a crowded bag, every line is compared to a pivot, the line of most
   crowded bags; what then is in another class than most lines of the bag meets the others
   that may be close by a parity map of their words.  So no key emits all its pairs, and no
   link between different classes is lost.
3. Candidates are verified by banded bit-parallel edit distance: a band of 2 t + 1 diagonals
   in one word, advanced by one addition and a few logical operations a word.
4. Links become classes by label propagation; classes are counted over all documents.

Equality of lines rests on 128 bits of hash, candidates on 64, links on the words.  Defined
results: null texts have no lines, blank lines are none; rows with a null id keep their lines
and count as one document; repeated rows are documents of their own only if their ids
differ; extra columns pass through ``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table_files, marked, materialise, table
from .components import components

#: (words, edits): lines of so many words or more may differ in so many words.
EDITS = ((8, 1), (40, 2))
#: Lines that a key may pair at once.
PAIRED = 8
BLANK = " \t\x0b\x0c\r"


def words_of_line(line) -> Column:
    line = F.col(line)
    other = line.contains(BLANK[1]) | line.contains(BLANK[2]) | line.contains(BLANK[3]) | line.contains(BLANK[4])
    return F.array_remove(F.split(F.when(other, F.translate(line, BLANK, " " * len(BLANK))).otherwise(line), " "), "")


def edits(n: Column) -> Column:
    """The threshold of a line of ``n`` words."""
    out = F.lit(0)
    for least, most in EDITS:
        out = F.when(n >= least, F.lit(most)).otherwise(out)
    return out


def lines_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, line, id, id2) of the lines that are not blank."""
    d = documents.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line"))
    d = d.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return d.withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit(2), "line")})


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def probes(n: int) -> list[tuple[int, int, int, int, bool]]:
    """(length less, threshold, segment, shift, own segment) of all that a line of ``n`` words looks up."""

    def most(words: int) -> int:
        return max((t for least, t in EDITS if words >= least), default=0)

    out = []
    for less in range(EDITS[-1][1] + 1):
        t = most(n - less)
        if t >= max(less, 1):
            out += [(less, t, i, shift, less == shift == 0) for i in range(t + 1) for shift in range(max(-i, less - t + i), min(i, less + t - i) + 1)]
    return out


def keys(lines: DataFrame) -> DataFrame:
    """(key, id, index): the segments of each line, and what it probes in shorter lines."""
    words, n = F.col("words"), F.size("words")
    names = ["less", "t", "i", "shift", "own"]
    looked = F.lit(None)
    for least in sorted({least + k for least, _ in EDITS for k in range(EDITS[-1][1] + 1)}):
        these = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, names, strict=True))) for p in probes(least)))
        looked = F.when(n >= least, these).otherwise(looked)

    # an outer explode: of an inner one Spark derives a filter that splits all lines twice; keys
    # are made of its rows, as functions of a column are compiled and those within an array are not
    d = lines.select("id", F.transform(words_of_line("line"), lambda w: F.xxhash64(w)).alias("words"))
    d = d.select("id", "words", F.explode_outer(looked).alias("p")).where("p.t IS NOT NULL")
    i, parts, length = F.col("p.i"), F.col("p.t") + 1, n - F.col("p.less")
    left, right = F.floor(length * i / parts).cast("int"), F.floor(length * (i + 1) / parts).cast("int")
    key = F.xxhash64(length, i, F.slice(words, left + 1 + F.col("p.shift"), right - left))
    return d.select(key.alias("key"), "id", F.col("p.own").alias("index"))


def shared(rows: DataFrame) -> DataFrame:
    """Rows of keys that several lines have, one of them indexed, with their number ``n``.

    One aggregation, combined before its shuffle, finds the keys; only rows that a map of
    these keys lets through are moved for the rest.
    """
    rows = materialise(rows, "line-index")
    few = rows.groupBy("key").agg(F.max("index").alias("any"), F.min("id").alias("low"), F.max("id").alias("high"))
    few = materialise(few.where("any AND low < high").select("key"), "line-keys")
    found = marked(rows, few, ["key"]).groupBy("key", "id").agg(F.max("index").alias("index")).join(few, "key")
    found = materialise(found, "line-rows")
    out = materialise(found.join(found.groupBy("key").agg(F.count("*").alias("n")), "key"), "line-shared")
    for t in (rows, few, found):
        drop_table_files(t)
    return out


def paired(rows: DataFrame, indexed: Column) -> DataFrame:
    """Pairs of the keys that few lines share."""
    group = rows.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list(F.struct("id", indexed.alias("index"))).alias("m"))
    one = group.select("m", F.explode("m").alias("x"))
    two = one.select("x", F.explode("m").alias("y")).where("x.id < y.id AND (x.index OR y.index)")
    return two.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def sign(words: Column) -> Column:
    """Parity map of a line's words: an edit changes two bits at most."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(w, F.lit(3)), F.lit(64)).cast("int"))))


def apart(one: Column, two: Column, size: Column, size2: Column) -> Column:
    """Whether two parity maps differ in more bits than the allowed edits change."""
    return F.bit_count(one.bitwiseXOR(two)) > 2 * edits(F.least(size, size2))


def bags(texts: DataFrame) -> DataFrame:
    """(key, id, size, sign): the words of a line dealt by hash into 2 t + 1 parts, for each threshold t that applies."""

    def dealt(j: int, n: int):
        return lambda w: F.pmod(F.xxhash64(w), F.lit(n)) == j

    words, n = F.col("words"), F.size("words")
    parts = []
    for k, (least, t) in enumerate(EDITS):
        above = EDITS[k + 1][0] if k + 1 < len(EDITS) else 1 << 30
        # a longer line meets shorter ones by their threshold, too
        own = (n >= least) & (n - t < above)
        part = [F.xxhash64(F.lit(t), F.lit(j), F.sort_array(F.filter(words, dealt(j, 2 * t + 1)))) for j in range(2 * t + 1)]
        parts.append(F.when(own, F.array(*part)).otherwise(F.array().cast("array<bigint>")))
    d = texts.select("id", words_of_line("line").alias("words")).select("id", n.alias("size"), sign(words).alias("sign"), F.concat(*parts).alias("bags"))
    return d.select("id", "size", "sign", F.explode("bags").alias("key"))


def within(left: Column, right: Column, threshold: int) -> Column:
    """Banded bit-parallel edit distance of two character arrays is at most ``threshold``.

    Bit k of the word is the diagonal k - threshold; ``left`` is the shorter array and has
    more than ``threshold`` characters.
    """
    top, mask = 2 * threshold, (1 << (2 * threshold + 1)) - 1
    n, m = F.size(left), F.size(right)

    def inverse(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def bit(x: Column, k) -> Column:
        return F.call_function("shiftright", x, k if isinstance(k, Column) else F.lit(k)).bitwiseAND(F.lit(1))

    def step(a: Column, i: Column) -> Column:
        match = F.lit(0)
        for k in range(2 * threshold + 1):
            place = i + (k - threshold)
            same = F.when(F.when(place >= 0, F.get(left, place)) == F.get(right, i), F.lit(1 << k)).otherwise(F.lit(0))
            match = match.bitwiseOR(same)

        def after_match(x: Column) -> Column:
            d0 = ((x.bitwiseAND(a.vp) + a.vp).bitwiseXOR(a.vp)).bitwiseOR(x).bitwiseOR(a.vn).bitwiseAND(F.lit(mask))
            return let(d0, after_d0)

        def after_d0(d: Column) -> Column:
            hp = a.vn.bitwiseOR(inverse(d.bitwiseOR(a.vp)))
            return let(hp, lambda h: after_hp(d, h))

        def after_hp(d: Column, hp: Column) -> Column:
            hn, slope = d.bitwiseAND(a.vp), F.call_function("shiftright", d, F.lit(1))
            below = top - 1 - (i - (n - threshold))
            change = F.when(i < n - threshold, 1 - bit(d, top)).otherwise(bit(hp, below) - bit(hn, below))
            return F.struct(
                hn.bitwiseOR(inverse(slope.bitwiseOR(hp))).alias("vp"),
                slope.bitwiseAND(hp).alias("vn"),
                (a.dist + change).alias("dist"),
            )

        return let(match, after_match)

    start = F.struct(F.lit(mask ^ ((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda a: a.dist) <= threshold


def near(size: Column, size2: Column) -> Column:
    """Whether lines of so many words may be linked."""
    return F.abs(size - size2) <= edits(F.least(size, size2))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    words = texts.select("id", words_of_line("line").alias("words")).withColumn("sign", sign(F.col("words")))
    one = words.select(F.col("id").alias("a"), F.col("words").alias("x"), F.col("sign").alias("p"))
    two = words.select(F.col("id").alias("b"), F.col("words").alias("y"), F.col("sign").alias("q"))
    both = pairs.join(one, "a").join(two, "b").where(near(F.size("x"), F.size("y")) & ~apart(F.col("p"), F.col("q"), F.size("x"), F.size("y")))
    swap = F.size("x") <= F.size("y")
    short, long = F.when(swap, F.col("x")).otherwise(F.col("y")), F.when(swap, F.col("y")).otherwise(F.col("x"))
    both = both.select("a", "b", short.alias("s"), long.alias("l"))

    def close(s: Column, l: Column) -> Column:
        out = F.lit(False)
        for least, t in EDITS:
            out = F.when(F.size(s) >= least, within(s, l, t)).otherwise(out)
        return out

    # bound as variables of a function, the arrays are taken once for a pair
    return both.where(let(F.col("s"), lambda s: let(F.col("l"), lambda l: close(s, l)))).select("a", "b")


def crowded_pairs(rows: DataFrame) -> DataFrame:
    """Every line of a crowded bag with the bag's pivot: the line of most crowded bags."""
    rows = rows.where(F.col("n") > PAIRED)
    often = rows.groupBy("id").agg(F.count("*").alias("often"))
    rows = rows.join(often, "id")
    pivot = rows.groupBy("key").agg(F.max(F.struct("often", "id", "size")).alias("pivot")).select("key", F.col("pivot.id").alias("other"), F.col("pivot.size").alias("size2"))
    met = rows.join(pivot, "key").where((F.col("id") != F.col("other")) & near(F.col("size"), F.col("size2")))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def left_pairs(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of a crowded bag that are in different classes and may be close; one is outside the bag's usual class."""
    rows = rows.where(F.col("n") > PAIRED).join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    usual = rows.groupBy("key", "comp").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("comp", F.struct("many", "comp")).alias("usual"))
    every = materialise(rows.join(usual, "key").withColumn("outside", F.col("comp") != F.col("usual")).drop("usual", "n"), "line-outside")
    two = every.select("key", *(F.col(c).alias(f"{c}2") for c in every.columns if c != "key"))
    met = every.where("outside").join(two, "key").where((F.col("comp") != F.col("comp2")) & (~F.col("outside2") | (F.col("id") < F.col("id2"))))
    met = met.where(near(F.col("size"), F.col("size2")) & ~apart(F.col("sign"), F.col("sign2"), F.col("size"), F.col("size2")))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def line_classes(lines: DataFrame) -> DataFrame:
    """(id, id2, class): for every line that another text is linked with; class is the smallest id."""
    first = shared(keys(lines))
    ids = materialise(first.select("id").distinct(), "line-ids")
    texts = marked(lines.select("id", "id2", "line"), ids, ["id"]).join(ids, "id").dropDuplicates(["id", "id2"])
    texts = materialise(texts, "line-texts")
    crowd = first.where(F.col("n") > PAIRED).select("id").distinct()
    second = bags(texts.join(crowd, "id")).distinct()
    second = materialise(second, "line-bags")
    second = materialise(second.join(second.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "line-crowd")
    pairs = paired(first, F.col("index")).unionByName(paired(second, F.lit(True))).unionByName(crowded_pairs(second))
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    links = materialise(verified(pairs, texts), "line-links")
    comp = components(links)
    more = materialise(left_pairs(second, comp).join(pairs, ["a", "b"], "left_anti"), "line-left")
    if not more.isEmpty():
        again = materialise(verified(more, texts), "line-links")
        if not again.isEmpty():
            comp = components(links.unionByName(again))
    out = texts.select("id", "id2").join(comp.select(F.col("node").alias("id"), F.col("comp").alias("class")), "id")
    out = materialise(out, "line-classes")
    for t in (first, ids, texts, second, pairs, links, more, comp):
        drop_table_files(t)
    return out


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, id, n_docs, first_doc, first_pos): places of classes that have two places or more."""
    lines = lines_of(documents, id_col, text_col)
    classes = line_classes(lines)
    places = lines.select("doc", "pos", "id", "id2").join(classes, ["id", "id2"], "left")
    # a class of linked lines is named by its smallest id, another by both hashes of its line
    places = places.withColumns({"class": F.coalesce("class", "id"), "class2": F.when(F.col("class").isNull(), F.col("id2")).otherwise(F.lit(0))})
    places = materialise(places.drop("id2"), "line-places")
    drop_table_files(classes)
    name = ["class", "class2"]
    by_doc = places.groupBy(*name, "doc").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    # a null id comes first; numbers of fixed size only, so that no class is sorted
    none = F.min(F.when(F.col("doc").isNull(), F.col("pos")))
    spread = by_doc.groupBy(*name).agg(
        F.count("*").alias("n_docs"), F.max(F.col("pos") < F.col("last")).alias("again"), none.alias("none"), F.min("doc").alias("low"), F.min_by("pos", "doc").alias("at")
    )
    first_doc = F.when(F.col("none").isNull(), F.col("low")).alias("first_doc")
    spread = spread.where("n_docs > 1 OR again").select(*name, "n_docs", first_doc, F.coalesce("none", "at").alias("first_pos"))
    spread = materialise(spread, "line-spread")
    out = materialise(marked(places, spread, name).join(spread, name).drop(*name), "line-repeats")
    drop_table_files(places)
    drop_table_files(spread)
    return out


def later() -> Column:
    """Whether a place of a repeated line is another than the class's first."""
    return ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos")))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the later places of each class of lines; a document that loses all its words goes."""
    repeats = repeated_lines(documents, id_col, text_col)
    gone = repeats.where(later()).groupBy("doc").agg(F.collect_set(F.struct("pos", "id")).alias("gone"))
    gone = materialise(gone, "line-gone")
    drop_table_files(repeats)
    d = documents.select(F.struct(*documents.columns).alias("row"))  # no name of the input can clash
    d = d.join(gone, F.col(f"row.{id_col}").eqNullSafe(F.col("doc")), "left")
    old = F.col(f"row.{text_col}")
    kept = F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains(F.col("gone"), F.struct(i.alias("pos"), F.xxhash64(F.btrim(x, F.lit(BLANK))).alias("id"))))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(kept, "\n"))
    d = d.withColumn("text", text).where(F.col("gone").isNull() | (F.btrim("text", F.lit(BLANK + "\n")) != ""))
    return d.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in documents.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many are repeated from an earlier place, the most documents a class is in, and its repeated lines.

    ``repeats`` lists place:first document:first place:documents of every line whose class has two places or more.
    """
    documents = table(spark, sf_dir, "documents")
    member = F.struct("pos", F.concat_ws(":", "pos", "first_doc", "first_pos", "n_docs").alias("text"))
    by_doc = repeated_lines(documents).groupBy("doc").agg(
        F.count_if(later()).alias("n_repeats"),
        F.max("n_docs").alias("most_docs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m.text), ",").alias("repeats"),
    )
    d = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    d = d.join(by_doc, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    return d.select(
        "doc_id",
        "n_lines",
        F.coalesce("n_repeats", F.lit(0)).cast("long").alias("n_repeats"),
        F.coalesce("most_docs", F.lit(1)).cast("long").alias("most_docs"),
        F.coalesce("repeats", F.lit("")).alias("repeats"),
    )


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
o AS (
  SELECT doc_id, pos::INT AS pos, trim(ls[pos + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM t)),
p AS (SELECT * FROM o WHERE line <> ''),
u AS (
  SELECT line, w, len(w)::INT AS n, CASE WHEN len(w) >= 40 THEN 2 WHEN len(w) >= 8 THEN 1 ELSE 0 END AS t, row_number() OVER (ORDER BY line) AS id
  FROM (SELECT line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT line FROM p))),
s AS (SELECT id, n, i, list_slice(w, i * n // (t + 1) + 1, (i + 1) * n // (t + 1)) AS g FROM (SELECT *, unnest(range(t + 1))::INT AS i FROM u WHERE t > 0)),
l AS (
  SELECT id, w, n, m, i, k, i * m // (t + 1) + k + 1 AS b, (i + 1) * m // (t + 1) + k AS e
  FROM (SELECT *, unnest(range(-2, 3))::INT AS k FROM (SELECT *, unnest(range(t + 1))::INT AS i FROM (
    SELECT id, w, n, m, CASE WHEN m >= 40 THEN 2 WHEN m >= 8 THEN 1 ELSE 0 END AS t FROM (SELECT id, w, n, n - unnest(range(3))::INT AS m FROM u) WHERE m >= 8)))),
c AS (
  SELECT DISTINCT s.id AS a, l.id AS b FROM s JOIN l ON s.n = l.m AND s.i = l.i AND s.g = list_slice(l.w, l.b, l.e)
  WHERE l.b >= 1 AND l.e <= l.n AND s.id <> l.id),
v(a, b, i, j, e) AS (
  SELECT a, b, f, f, 0 FROM (
    SELECT a, b, coalesce(list_position(list_transform(range(1, least(x.n, y.n) + 1), lambda k: x.w[k] = y.w[k]), false) - 1, least(x.n, y.n))::INT AS f
    FROM c JOIN u x ON x.id = a JOIN u y ON y.id = b)
  UNION
  SELECT a, b, i + f, j + f, e FROM (
    SELECT a, b, i, j, e, coalesce(list_position(list_transform(range(1, least(x.n - i, y.n - j) + 1), lambda k: x.w[k + i] = y.w[k + j]), false) - 1, least(x.n - i, y.n - j))::INT AS f
    FROM (SELECT a, b, v.i + d.i AS i, v.j + d.j AS j, v.e + 1 AS e FROM v, (VALUES (1, 1), (1, 0), (0, 1)) d(i, j) WHERE v.e < 2) JOIN u x ON x.id = a JOIN u y ON y.id = b
    WHERE i <= x.n AND j <= y.n AND e <= x.t)),
k AS (SELECT DISTINCT a, b FROM v JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE i = x.n AND j = y.n),
g AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
z AS (SELECT u.line, least(u.id, coalesce(min(r.b), u.id)) AS class FROM u LEFT JOIN r ON r.a = u.id GROUP BY u.line, u.id),
q AS (SELECT p.doc_id, p.pos, z.class FROM p JOIN z USING (line)),
y AS (SELECT class, count(DISTINCT doc_id) AS n_docs, min((doc_id, pos)) AS first FROM q GROUP BY class HAVING count(*) > 1),
h AS (
  SELECT doc_id, count(*) FILTER (WHERE (doc_id, pos) <> first) AS n_repeats, max(n_docs) AS most_docs,
         string_agg(concat_ws(':', pos, first[1], first[2], n_docs), ',' ORDER BY pos) AS repeats
  FROM q JOIN y USING (class) GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_repeats, 0)::BIGINT AS n_repeats,
       coalesce(most_docs, 1)::BIGINT AS most_docs, coalesce(repeats, '') AS repeats
FROM t LEFT JOIN h ON h.doc_id = t.doc_id
"""
