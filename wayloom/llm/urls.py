"""URL filters: longest rule first, else host words and naive Bayes.

Rules are (host, path) pairs; one fits its host and all subdomains if the url's path starts
with its own, and the longest wins.  For all other urls, the host's labels are split into
words by a unigram Viterbi search, and a multinomial naive Bayes model scores those words
with the path's tokens.

The dictionary is counted over the paths, hyphenated host labels and titles of all pages.  Its VOCABULARY most
frequent words go to every task; rarer ones stay in a table and join the hosts that have them.  The TOKENS most
frequent tokens of the model go to every task, the rest joins by token.  So both numbers bound memory, not results.
Naive Bayes learns over all pages:
hosts whose words include a known spam word are examples of block, urls that an allow rule
or no rule fits are examples of allow (block rules state a policy about places, not about
words, and teach nothing).

Defined results: a null url, or one without "://", has empty host and path, fits no rule
and is judged by the prior; repeated rows are each judged; other columns are not carried;
without training rows the verdict is allow; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, ship, table

#: Words of the dictionary, and tokens of the model, that go to every task.
VOCABULARY, TOKENS = 50_000, 100_000
#: Letters of an unknown word.
LONGEST_WORD = 24
#: Fixed by the contract of the query: rule and verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words that mark a host as spam for training.
SPAM_WORDS = frozenset(
    "adult bet bets betting bonus casino cheap click deals discount drugs farm gambling loan loans lottery meds "
    "pills poker porn replica sex slots spam viagra warez winner xxx".split()
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


WORD = re.compile(r"[^\W\d_]+")


class Segmenter:
    """Unigram Viterbi: the most probable split; an unknown word costs tenfold a letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int = 0):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.longest = max([LONGEST_WORD, longest, *map(len, counts)])
        self.split = lru_cache(100_000)(self._split)

    def cost(self, word: str, rare: tuple[tuple[str, int], ...] = ()) -> float:
        known = self.log.get(word)
        if known is None and rare:
            known = next((math.log(n / self.total) for w, n in rare if w == word), None)
        if known is not None:
            return known
        return math.log(10 / self.total) - len(word) * math.log(10) if len(word) <= LONGEST_WORD else -math.inf

    def _split(self, text: str, rare: tuple[tuple[str, int], ...] = ()) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for i in range(1, len(text) + 1):
            score, j = max((best[j] + self.cost(text[j:i], rare), j) for j in range(max(0, i - self.longest), i))
            best.append(score)
            back.append(j)
        words, i = [], len(text)
        while i:
            words.append(text[back[i] : i])
            i = back[i]
        return tuple(reversed(words))


def tokens(host: str, path: str, segmenter: Segmenter, rare: tuple[tuple[str, int], ...] = ()) -> tuple[list[str], list[str]]:
    """Words of the host (its last label whole), and all tokens with their place."""
    *names, top = host.split(".")
    words = [w for name in names for part in WORD.findall(name) for w in segmenter.split(part, rare)]
    inner = [f"p:{t}" if not t.isdigit() else f"p:{'0' * min(len(t), 4)}" for t in re.findall(r"[^\W_]+", path.lower())]
    return words, [f"h:{w}" for w in words] + [f"t:{top}"] + inner


def count_words(pages: DataFrame, url_col: str, html_col: str | None) -> DataFrame:
    """(word, n): unigram counts over hyphenated host labels, paths and titles of all pages."""
    host, path = url_parts(F.col(url_col).cast("string"))
    parted = F.filter(F.split(host, r"\."), lambda x: x.contains("-"))  # other labels may be words run together
    text = F.concat_ws(" ", F.array_join(parted, " "), F.lower(path))
    if html_col is not None:
        text = F.concat_ws(" ", text, F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def head_and_tail(counts: DataFrame, name: str, most: int) -> tuple[list, DataFrame | None]:
    """The ``most`` most frequent rows of (name, n), and the table of all others, if there are any."""
    head = counts.orderBy(F.desc("n"), name).limit(most + 1).collect()
    if len(head) <= most:
        return head, None
    n, last = head[most - 1]["n"], F.lit(head[most - 1][name])
    return head[:most], counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col(name) > last)))


def rare_words(hosts: DataFrame, tail: DataFrame, longest: int) -> DataFrame:
    """(host, rare): the words of ``tail`` that parts of a host's labels contain, with their counts."""
    labels = F.split("host", r"\.")
    names = F.concat_ws(".", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    part = hosts.select("host").distinct().select("host", F.explode(F.split(names, r"[^\p{L}]+")).alias("part")).where("part <> ''").distinct()
    size = F.length("part")
    piece = part.select("part").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), size)))
    piece = piece.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(size - F.col("at") + 1, F.lit(longest)))))
    piece = piece.select("part", F.col("part").substr(F.col("at"), F.col("size")).alias("word")).distinct()
    found = part.join(piece.join(tail, "word"), "part").select("host", "word", "n").distinct()
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rare"))


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; log odds of block."""

    def __init__(self, counts: dict[str, tuple[int, int]], total: tuple[int, int], names: int, pages: tuple[int, int]):
        """Counts of tokens, of all tokens and of pages as (block, allow); ``names`` is the number of all tokens."""
        self.total, self.size = total, names + 1
        self.ready = all(pages)
        if self.ready:
            self.prior = math.log(pages[0] / pages[1])
            self.weights = {t: self.weight(*c) for t, c in counts.items()}

    def weight(self, block: int, allow: int) -> float:
        return math.log((block + 1) / (self.total[0] + self.size)) - math.log((allow + 1) / (self.total[1] + self.size))

    def score(self, found: list[str]) -> float:
        return self.prior + sum(self.weights.get(t, 0.0) for t in found) if self.ready else -1.0


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    rules: tuple[tuple[str, str], ...] = RULES,
    spam_words: frozenset[str] = SPAM_WORDS,
) -> DataFrame:
    """(id, host, path, rule, verdict, score, words): score is the log odds of block."""
    spark = pages.sparkSession
    dictionary = materialise(count_words(pages, url_col, html_col), "url-words")
    n_words, longest = dictionary.agg(F.sum("n"), F.max(F.length("word"))).first()
    head, tail = head_and_tail(dictionary, "word", VOCABULARY)
    segmenter = ship(spark, ({r.word: r.n for r in head}, n_words or 0, longest or 0))  # VOCABULARY words at most
    host, path = url_parts(F.col(url_col).cast("string"))
    d = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    d = d.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
    d = d.select("id", "host", "path", "fit.rule", "fit.verdict")
    none = F.array().cast("array<struct<word:string,n:bigint>>")
    d = d.withColumn("rare", none) if tail is None else d.join(rare_words(d, tail, longest), "host", "left").select("id", "host", "path", "rule", "verdict", F.coalesce("rare", none).alias("rare"))

    def rare(column):
        return [tuple((w["word"], w["n"]) for w in row) for row in column.to_pylist()]

    def learn(batches):
        split = Segmenter(*segmenter.value)
        counts: dict[tuple[str, str], int] = {}

        def out():
            flat = [(v, t, n) for (v, t), n in counts.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["verdict", "token", "n"])

        for b in batches:
            for h, p, v, r in zip(*(c.to_pylist() for c in b.columns[:3]), rare(b.column(3)), strict=True):
                words, found = tokens(h, p, split, r)
                v = "block" if spam_words.intersection(words) else None if v == "block" else "allow"
                if v is not None:
                    for t in ("", *found):  # the empty token counts pages
                        counts[v, t] = counts.get((v, t), 0) + 1
                if len(counts) >= TOKENS:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    learned = d.select("host", "path", "verdict", "rare").mapInArrow(learn, "verdict string, token string, n long")
    of = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")]
    learned = materialise(learned.groupBy("token").agg(*of, F.sum("n").alias("n")), "url-tokens")
    seen = {r.own: r for r in learned.groupBy((F.col("token") != "").alias("own")).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("names")).collect()}
    total, names = ((seen[True].block, seen[True].allow), seen[True].names) if True in seen else ((0, 0), 0)
    head, tail = head_and_tail(learned.where("token <> ''"), "token", TOKENS)
    bayes = Bayes({r.token: (r.block, r.allow) for r in head}, total, names, (seen[False].block, seen[False].allow) if False in seen else (0, 0))
    model = ship(spark, bayes)  # TOKENS weights at most
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, host string, path string, rule string, verdict string, score double, words string, others array<string>"

    def judge(batches):
        split = Segmenter(*segmenter.value)
        known = model.value.weights if tail_known else None
        for b in batches:
            found = [tokens(h, p, split, r) for h, p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), rare(b.column(5)), strict=True)]
            score = [model.value.score(t) for _, t in found]
            others = [[t for t in ts if t not in known] if known is not None else [] for _, ts in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(score, pa.float64()), pa.array([" ".join(w) for w, _ in found], pa.string()), pa.array(others, pa.list_(pa.string()))],
                names=["id", "host", "path", "rule", "verdict", "score", "words", "others"],
            )

    tail_known = tail is not None and bayes.ready
    judged = d.mapInArrow(judge, schema)
    if tail_known:
        judged = materialise(judged.withColumn("row", F.monotonically_increasing_id()), "url-judged")
        logs = [F.log((F.col(v) + 1) / F.lit(total[k] + names + 1)) for k, v in enumerate(("block", "allow"))]
        more = judged.select("row", F.explode("others").alias("token")).join(tail.select("token", (logs[0] - logs[1]).alias("w")), "token")
        more = more.groupBy("row").agg(F.aggregate(F.sort_array(F.collect_list("w")), F.lit(0.0), lambda a, w: a + w).alias("more"))
        judged = judged.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", "words")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filter_urls(table(spark, sf_dir, "pages"))
    return d.select("page_id", "host", "path", "rule", "verdict", "score", "words")
