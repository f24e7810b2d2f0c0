"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for every document: its measurements become columns and its
failure one bit of ``failed_mask``.  Versioned policies are masks over those bits, so a
verdict is one bitwise test, and ablations (what a policy would keep without one of its
rules) are bitwise tests over the few distinct masks that a single aggregation leaves.

Defined results: a null text has no words and measures 0 everywhere; repeated rows give
repeated rows; only the id and the text are read, so other columns cannot clash; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]+"
#: Fixed by the contract of the ledger query.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its predicate over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits 0 and 1 are the base rules; the others follow published heuristics for web text
#: (symbols a word, repeated lines, mean word length, capitals), with slack.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 2"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(5, "capitals", "10 * n_capitals > 5 * word_chars AND n_capitals > 0"),
)
#: Version: the rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
}


def mask_of(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def repeat_words(words: Column, n: Column) -> Column:
    """Sorted hashes of the 3-word windows, each shifted to leave room for its place, and the bits of a place.

    One sort of plain longs brings equal windows together; their words are compared after it.
    """
    bits = F.ceil(F.log2(n + F.lit(2))).cast("int")
    keyed = F.transform(
        words,
        lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(
            i.cast("long")
        ),
    )
    return F.sort_array(F.slice(keyed, F.lit(1), F.greatest(n - 2, F.lit(0)))), bits


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements): one row for each row of ``df``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(F.col(id_col).alias("id"), text.alias("text"))
    d = d.select(
        "id",
        "text",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "").alias("lines"),
    )
    d = d.withColumn("n", F.size("words"))
    keyed, bits = repeat_words(F.col("words"), F.col("n"))
    d = d.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        keyed.alias("keyed"),
        bits.alias("bits"),
        "words",
    )

    def high(c: Column) -> Column:
        return F.call_function("shiftright", c, F.col("bits"))

    same = F.filter(
        "keyed",
        lambda k, i: (high(k) == high(F.get(F.col("keyed"), i + 1))) | ((i > 0) & (high(k) == high(F.get(F.col("keyed"), i - 1)))),
    )
    d = d.withColumn("same", same)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    # hashes of few bits may agree by chance, so the words decide (no word holds a blank)
    window = F.transform("same", lambda k: F.struct(F.array_join(F.slice("words", (k.bitwiseAND(low) + 1).cast("int"), F.lit(3)), " ").alias("w"), k.bitwiseAND(low).alias("p")))
    d = d.withColumn("window", F.sort_array(window))
    at = F.col("window")
    equal = F.filter(at, lambda x, i: F.coalesce(x.w == F.get(at, i + 1).w, F.lit(False)) | ((i > 0) & F.coalesce(x.w == F.get(at, i - 1).w, F.lit(False))))
    d = d.withColumn("place", F.sort_array(F.transform(equal, lambda x: x.p))).drop("keyed", "same", "bits", "window", "words")
    covered = F.aggregate(
        F.transform("place", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(p - F.get(F.col("place"), i - 1), F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return d.withColumn("n_repeat_words", F.when(F.size("place") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("place").withColumnRenamed("id", id_col)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed_mask``: bit k is set where rule k fails."""
    mask = F.lit(0).cast("long")
    for r in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(df, id_col, text_col).withColumn("failed_mask", mask)


def passes(mask: Column, policy: str) -> Column:
    return mask.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """(rule, n_docs, n_kept, n_kept_without, n_only): what each rule of a policy costs.

    One aggregation by mask (combined before the shuffle; at most 2**rules rows), then
    bitwise tests for each rule.
    """
    want = mask_of(POLICIES[policy])
    by_mask = kept_ledger.groupBy("failed_mask").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in RULES if r.name in POLICIES[policy]])
    d = by_mask.select("failed_mask", "n", F.explode(rules).alias("r")).select("failed_mask", "n", "r.rule", "r.flag")
    hit = F.col("failed_mask").bitwiseAND(F.lit(want).cast("long"))
    without = hit.bitwiseAND(F.bitwise_not("flag"))
    return d.groupBy("rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(hit == F.col("flag"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ledger(table(spark, sf_dir, "documents"))
    failed = ~passes(F.col("failed_mask"), "base")
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & passes(F.col("failed_mask"), "v1")).alias("kept"),
        "failed_mask",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT rid, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM d)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM w) WHERE n > 1),
rep AS (
  SELECT rid, sum(least(3, p - before)) AS n_repeat_words
  FROM (SELECT rid, p, coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), p - 3) AS before FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 2 THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 5 * word_chars AND n_capitals > 0 THEN 32 ELSE 0 END)::BIGINT AS failed_mask
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_mask % 4 > 0 AS base_failed, failed_mask = 0 AS kept, failed_mask
FROM f
"""
