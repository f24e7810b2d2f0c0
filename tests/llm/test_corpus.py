"""Corpus operators against brute force, public libraries and odd tables."""

import base64
import gzip
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wayloom.llm import common, bpe, chat, decontaminate, licenses, lines, neardup, quality, rules, urls, warc
from wayloom.llm.common import string_chunks, table
from wayloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


ODD = [None, "", " \n\t ", "one", "Été été ÉTÉ\x85x", "word " * 30_000, "x" * 40_000, "a b c d e f g", "a b c d e f g", "日本語 text\n\ntext\n"]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns with clashing names."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "one"), (None, "a b c d e f g"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["id", "text_", "score", "component", "gram", "spans", "words", "line", "class", "rule", "lang", "source"]
    return d.select("*", *(F.lit(None).cast("string").alias(c) for c in clash), F.lit(1).cast("long").alias("n_chars"))


# --- 10: byte-level BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), theirs


def test_bpe_equals_the_library(encoder, monkeypatch):
    ours, theirs = encoder
    rng = random.Random(5)
    texts = ["", "a" * 3000, "Hello  world\n\n 123 ß é日本語", "\u0558\u088f letters of some versions only", " \u00a0\u2003x", "don't we'll"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3100), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    texts += ["".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    monkeypatch.setattr(bpe, "CACHE_ROWS", 50)
    for part in (texts[i : i + 40] for i in range(0, len(texts), 40)):  # the worker's table is emptied between
        ids, bounds = ours.texts(part)
        for k, t in enumerate(part):
            assert theirs.encode_ordinary(t) == ids[bounds[k] : bounds[k + 1]].tolist()


def test_bpe_round_trip_and_odd_rows(spark, encoder):
    d = odd(spark)
    got = bpe.encode(d, decoded=True).collect()
    assert len(got) == d.count()
    for r in got:
        assert r.ids == encoder[1].encode_ordinary(bytes(r.decoded).decode())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(bytes(by_id[k].decoded).decode() == (t or "") for k, t in enumerate(ODD))
    again = bpe.decode(bpe.encode(d)).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in got)
    assert bpe.encode(d.limit(0)).count() == 0


# --- 3: decontamination ---------------------------------------------------------------


def brute_hits(text, items, window):
    w, hit, names = PLAIN_WORD.findall(low(text)), set(), set()
    for name, t in items:
        i = PLAIN_WORD.findall(low(t))
        for g in [i[k : k + window] for k in range(max(1, len(i) - window + 1))] if i else []:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(str(name))
    return len(w), hit, sorted(names)


def random_items(rng, voc, n=7):
    return [(k, " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 9)))) for k in range(rng.randrange(1, n))]


@pytest.mark.parametrize("seed", range(25))
def test_index_finds_every_window(seed):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(rng.choice([2, 5, 30]))]
    window = rng.choice([1, 2, 3, 5])
    items = random_items(rng, voc)
    phrases = decontaminate.Phrases([(str(a), b) for a, b in items], window)
    texts = [" ".join(rng.choice([*voc, "zz", "Q1"]) for _ in range(rng.randrange(0, 60))) for _ in range(20)] + ["a " * 50, ""]
    shard = decontaminate.Shard(phrases)
    for i, data, off in string_chunks(pa.array(texts)):
        shard.add(pa.record_batch({"id": range(len(texts))}).slice(i, len(off) - 1), data, off)
    for r, t in zip(shard.results().to_pylist(), texts, strict=True):
        n, hit, names = brute_hits(t, items, window)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), names)
        assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit


def test_decontamination_in_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    voc = ["a", "b", "c", "d"]
    items = random_items(rng, voc, 9) + [(50, None), (51, ""), (52, "one")]
    bench = spark.createDataFrame(items + [(None, "a b")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    texts = [" ".join(rng.choice([*voc, "zz"]) for _ in range(40)) for _ in range(12)] + ["one", None]
    d = docs(spark, texts)
    want = {k: brute_hits(t, [i for i in items if i[1]], 3) for k, t in enumerate(texts)}
    for chars in (32 << 20, 20):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = decontaminate.find_contamination(d, bench, window=3).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {k: (n, len(h), i) for k, (n, h, i) in want.items()}
        for r in got:
            assert {x for s in r.spans for x in range(s.start, s.end)} == want[r.doc_id][1]
    assert decontaminate.find_contamination(odd(spark), bench).count() == len(ODD) + 3
    assert {r.n_hit for r in decontaminate.find_contamination(odd(spark), bench.limit(0)).collect()} == {0}
    assert decontaminate.find_contamination(d.limit(0), bench).count() == 0


def test_repeated_item_ids_count_once_in_any_number_of_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (7, "c d e"), (8, "b c d")], "item_id long, text string")
    d = docs(spark, ["x a b c d e y", "a b c a b c", "nothing"])
    for chars in (32 << 20, 4):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(d, bench, window=3).collect()}
        assert got == {0: (5, ["7", "8"]), 1: (6, ["7"]), 2: (0, [])}


def test_decontamination_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries()["op3_decontaminate"](spark, SF).collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for r in table(spark, SF, "documents").collect():
        n, hit, names = brute_hits(r.text, items, 13)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items) == (n, len(hit), len(names))
        assert g.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert g.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


# --- 2: n-gram Jaccard join -----------------------------------------------------------


def brute_classes(texts, n=5, percent=75):
    sets = []
    for t in texts:
        w = SPACE_WORD.findall(low(t))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return [(len(sets[k]), root(k)) for k in range(len(texts))]


def family(rng, size, words, changes, voc):
    base = [rng.choice(voc) for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(0, changes)):
            w[rng.randrange(len(w))] = rng.choice(voc)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,paired", [(0, 24), (1, 3), (2, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, paired):
    """Small families, a large one whose n-grams are crowded, and a passage that many share."""
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "HELD_PAIRS", 50 + 10**6 * seed)
    monkeypatch.setattr(common, "MARKS", 1 << (8 + 10 * seed))  # nearly everything is marked, or little
    rng = random.Random(seed)
    voc = [f"v{k}" for k in range(400)]
    texts = family(rng, 60, 60, 8, voc)
    for _ in range(8):
        texts += family(rng, 4, rng.randrange(3, 90), 5, voc)
    passage = " ".join(rng.choice(voc) for _ in range(30))
    texts += [f"{passage} {' '.join(rng.choice(voc) for _ in range(rng.randrange(0, 14)))}" for _ in range(25)]
    texts += [texts[0].upper(), "", None, "one two", "one two", "One\ttwo", "one two three"]
    rng.shuffle(texts)
    want = brute_classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) + 3
    by_id = {r.doc_id: r.component for r in got}
    assert by_id[8] == 7 and by_id[0] == 0 and by_id[1] == 1 and by_id[3] == 3
    assert [r.component for r in got if r.doc_id is None] == [None, None]
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0
    assert {r.component for r in neardup.near_duplicates(odd(spark).where("text IS NULL")).collect()} == {0, None}


# --- 1: line dedup --------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = []
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randrange(threshold + 1, 12))]
        b = list(a)
        for _ in range(rng.randrange(0, threshold + 2)):
            k = rng.randrange(0, len(b) + 1)
            b[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "b"])
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if len(a) > threshold and len(b) - len(a) <= threshold:
            rows.append((a, b))
    d = spark.createDataFrame(rows, "s string, l string")
    close = lines.let(F.split("s", ""), lambda s: lines.let(F.split("l", ""), lambda l: lines.within(s, l, threshold)))
    for r in d.select("s", "l", close.alias("ok")).collect():
        assert r.ok == (edit(r.s, r.l) <= threshold), r


def brute_lines(rows):
    """Class of each line: (first document and place) of what is linked by the edits that its words allow."""
    found = {}
    for doc, text in rows:
        for pos, x in enumerate(text.split("\n") if text is not None else []):
            x = x.strip(" \t\x0b\x0c\r")
            if x:
                found.setdefault(x, []).append((doc, pos))
    names = sorted(found)
    comp = {x: x for x in names}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(names, 2):
        x, y = sorted((a.split(), b.split()), key=len)
        most = max((t for least, t in lines.EDITS if len(x) >= least), default=-1)
        if len(y) - len(x) <= most and edit(x, y) <= most:
            comp[root(b)] = root(a)
    out = {}
    for x in names:
        out.setdefault(root(x), []).extend(found[x])
    return {place: (min(g), len({d for d, _ in g})) for g in out.values() for place in g if len(g) > 1}


@pytest.mark.parametrize("seed,paired,marks", [(11, 8, 26), (12, 1, 8), (13, 2, 20)])
def test_line_classes_equal_brute_force(spark, monkeypatch, seed, paired, marks):
    """With ``paired`` 1 every shared key is crowded, so bags and pivots decide."""
    monkeypatch.setattr(lines, "PAIRED", paired)
    monkeypatch.setattr(lines, "EDITS", ((4, 1), (9, 2)))
    monkeypatch.setattr(common, "MARKS", 1 << marks)
    rng = random.Random(seed)
    voc = ["abcdefghéijk"[k] * 2 for k in range(12)]
    bases = [[rng.choice(voc) for _ in range(rng.randrange(3, 14))] for _ in range(6)]
    bases[1] = [*bases[0][: len(bases[0]) // 2 + 1], *bases[1]]
    rows = []
    for k in range(40):
        own = []
        for _ in range(4):
            x = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                p = rng.randrange(0, len(x))
                x[p : p + rng.randrange(0, 2)] = rng.choice([[], ["q"], ["z"], ["z q"]])
            own.append(rng.choice([" ", " ", "  "]).join(x) + rng.choice(["", " ", "\t"]))
        rows.append((k, "\n".join([*own, "", " \t", "short"])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.pos): ((r.first_doc, r.first_pos), r.n_docs) for r in lines.repeated_lines(d).collect()}
    assert got == brute_lines(rows)


def test_dedup_removes_later_places_of_lines(spark):
    common, rare = "This line stands in a great many of the documents.", "This one is found in two documents only."
    rows = [(k, f"own text {k}\n{common}\n{rare if k < 2 else ''}") for k in range(9)] + [(20, common.replace("stands", "is")), (21, None), (22, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("gone_pos", F.lit(1))
    out = lines.dedup_lines(d)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == rows[0][1] and got[1] == "own text 1" and got[5] == "own text 5\n"
    assert 20 not in got and got[21] is None and got[22] == ""
    assert lines.dedup_lines(odd(spark).limit(0)).count() == 0


def test_long_words_of_equal_polynomials_differ():
    word = "a"
    for _ in range(11):  # the Thue-Morse word and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    data = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}".encode()
    *_, h = common.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), common.alphanumeric())
    assert h[0] == h[2] != h[1]


def test_licenses_do_not_depend_on_the_partition(spark):
    part, full = "under the apache license version 2 0 only", "licensed under the apache license version 2 0"
    texts = [part, "x", part, "by " + full, part, "", full]
    found = [{r.doc_id: [m.label for m in r.matches] for r in licenses.scan_licenses(docs(spark, texts).repartition(n)).collect()} for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
    assert {k for k, v in found[0].items() if v == ["apache-2.0"]} == {0, 2, 3, 4, 6}


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    rows = np.abs(rng.normal(size=(40, quality.FEATURES))).astype(np.float32) * (rng.random((40, quality.FEATURES)) < 0.02)
    labels = np.array([0, 1] * 18 + [1] * 4)
    model = quality.Model(rows, labels)
    own = model.unit(model.weighted(rows[:7].copy()) @ model.project).astype(float)
    for got, v in zip(model.score(rows[:7].copy()), own, strict=True):
        near = sorted(((float(v @ u), int(y)) for u, y in zip(model.vectors.astype(float), labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        want = (sum(w * y for w, (_, y) in zip(weight, near, strict=True)) + quality.PRIOR * model.prior) / (sum(weight) + quality.PRIOR)
        assert got == pytest.approx(want, abs=1e-4)


def test_very_long_and_very_common_lines(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(k, f"{long.replace('w77 ', f'x{k} ')}\nthe same line of nine words in every document\n{k}") for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.pos): (r.first_doc, r.first_pos, r.n_docs) for r in lines.repeated_lines(d).collect()}
    assert got == {(k, p): (0, p, 12) for k in range(12) for p in (0, 1)}


def test_short_lines_take_part_in_the_pipeline(spark):
    rows = [(k, f"own text {k}\n All rights reserved.\t\n\nx{k}", "en", "web", 9) for k in range(9)]
    lined = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.createDataFrame(rows, DOCS), SF)
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {0: rows[0][1]} | {k: f"own text {k}\n\nx{k}" for k in range(1, 9)}


def test_lines_of_few_documents_are_deduplicated_in_the_pipeline(spark):
    passage = "a passage that only two of the documents have in common " * 6
    rows = [(k, f"own text {k}\n{passage if k in (3, 7) else f'nothing {k}'}", "en", "web", 9) for k in range(9)]
    lined = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.createDataFrame(rows, DOCS), SF)
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {r[0]: r[1] for r in rows} | {7: "own text 7"}


def test_lines_repeated_within_a_document_are_deduplicated_in_the_pipeline(spark):
    again = "This line stands three times in one document and in no other one."
    rows = [(1, f"{again}\nown\n{again}\nyes\n\n{again} \nyes\n", "en", "web", 9), (2, "other", "en", "web", 9), (2, "other\nyes", "en", "web", 9)]
    lined = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.createDataFrame(rows, DOCS), SF)
    got = sorted((r.doc_id, r.text) for r in lined.collect())
    assert got == [(1, f"{again}\nown\nyes\n\n"), (2, "other"), (2, "other")]


# --- 4: WARC --------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    html = [None, "", "é" * 50, "x" * 5000, "same", "same", "same", "\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(9 - k, f"http://h/{k}?é=%20&a b\n" if k else None, h) for k, h in enumerate(html)] + [(3, "http://again", "same"), (None, "http://null", "same")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("id", F.lit(2))
    raw = warc.write_archives(p, f"{tmp_path}/raw")
    done = warc.normalise(raw, f"{tmp_path}/rec")
    got = warc.read_archives(done, f"{tmp_path}/rec").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == b"same"
            continue
        url, h = next((u, x) for i, u, x in rows if str(i) == r.page_id and (u == r.url or (u or "").replace("\n", "%0A") == r.url or (u is None and r.url is None)))
        payload = (h or "").encode()
        first = min(i for i, _, x in rows if i is not None and (x or "") == (h or ""))
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if str(first) == r.page_id else ("revisit", str(first)))
        assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
    for r in done.collect():
        data = open(r.path, "rb").read()
        for line in open(r.index_path):
            e = json.loads(line)
            member = data[e["offset"] : e["offset"] + e["length"]]
            assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and zlib.decompressobj(31).decompress(member)
    small = warc.write_archives(p, f"{tmp_path}/big", min_bytes=100)
    kinds = {r.record_type for r in warc.read_archives(warc.normalise(small, f"{tmp_path}/b2"), f"{tmp_path}/b2").collect()}
    assert kinds == {"response"}
    none = warc.normalise(warc.write_archives(p.limit(0), f"{tmp_path}/n"), f"{tmp_path}/n2")
    assert warc.read_archives(none, f"{tmp_path}/n2").count() == 0


# --- 5: quality -----------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op5_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 60 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    assert all(r.predicted == 0 for r in got if r.quality == 0)


def test_quality_odd_rows_and_labels(spark):
    d = odd(spark)
    labels = spark.createDataFrame([(7, 1), (8, 1), (6, 0), (5, 0), (5, 1), (4, None), (99, 1), (None, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.classify(d, labels, keep=("score", "n_chars"))
    assert got.columns == ["doc_id", "score", "n_chars", "score"]
    s = quality.classify(d, labels).collect()
    assert len(s) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in s)
    assert {r.score for r in quality.classify(d, labels.limit(0)).collect()} == {1.0}
    assert quality.classify(d.limit(0), labels).count() == 0


def test_quality_scores_do_not_depend_on_partitions(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = {r.doc_id: r.score for r in quality.classify(d, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(d.repartition(7), labels).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-4) for k in a)


# --- 6 and 8: native --------------------------------------------------------------------


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "yo"), (2, 0, "system", "only"), (None, None, None, "n"), (1, 300, "bob", "late")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("c", F.lit(2))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(d).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "unknown", -1)}
    r = got[1, "ann", 0]
    assert r.text == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user name=bob|>\n<|end|>\n"
    assert [r.text[s.start : s.end] for s in r.spans] == ["hi<|end|>\n", "yo<|end|>\n"]
    assert got[1, "bob", 1].text == "<|assistant|>\nlate<|end|>\n"
    assert chat.rotate(d.limit(0)).count() == 0


def brute_rules(text):
    w = SPACE_WORD.findall(text or "")
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {t for t in tri if tri.count(t) > 1} if len(tri) < 3000 else {t for t in set(tri) if tri.count(t) > 1}
    hit = {k + j for k, t in enumerate(tri) if t in many for j in range(3)}
    ls = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text or ""), len(ls) - len(set(ls)), len(hit)


def test_rules_measure(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab#c") for _ in range(rng.randrange(0, 30))) + rng.choice(["", "\nx\nx\n \nx", "\t\x0b"]) for _ in range(60)]
    got = {r.doc_id: r for r in rules.ledger(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), repr(t)
    o = {r.doc_id: r for r in rules.ledger(odd(spark)).collect()}
    assert o[5].n_repeat_words == 30_000 and o[0].n_words == 0 and o[6].n_words == 1
    assert rules.ledger(odd(spark).limit(0)).count() == 0


def test_rule_ablation(spark):
    led = rules.ledger(table(spark, SF, "documents"))
    rows, want = led.collect(), rules.mask_of(rules.POLICIES["v1"])
    got = {r.rule: r for r in rules.ablation(led, "v1").collect()}
    for rule in rules.RULES:
        g = got[rule.name]
        assert g.n_docs == len(rows)
        assert g.n_kept == sum(r.failed_mask & want == 0 for r in rows)
        assert g.n_kept_without == sum(r.failed_mask & want & ~(1 << rule.bit) == 0 for r in rows)
        assert g.n_only == sum(r.failed_mask & want == 1 << rule.bit for r in rows)


def test_native_plans_run_no_python(spark):
    for name in ("op1_line_dedup", "op6_chat", "op8_rules"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


# --- 7: licenses ------------------------------------------------------------------------

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_places(text):
    w, out = PLAIN_WORD.findall(low(text)), []
    for p, label in PHRASES.items():
        p = p.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), out


def check_places(row, text):
    n, places = brute_places(text)
    starts, names = [k for k, _ in places], sorted({x for _, x in places})
    assert (row.n_words, row.n_base, row.base_labels) == (n, len(places), ",".join(names))
    assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
    assert set(names) <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
    assert (row.labels == "") == (row.score == 0)


def test_license_query(spark):
    got = {r.doc_id: r for r in queries()["op7_licenses"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        check_places(got[r.doc_id], r.text)


def test_license_templates(spark, tmp_path):
    rng = random.Random(1)
    voc = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x"]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += ["LICENSED under the Apache-License, Version 2.0", "licensed under an apache license, version 2.0", "the apache licence", "cc", "by cc", "reserved " * 3]
    texts += ["GNU Lesser General Public License", None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this work"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op7_licenses"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        check_places(got[k], t)
    assert got[40].labels == "apache-2.0" and got[40].score == 1.0
    assert got[41].labels == "apache-2.0" and got[41].score < 1.0
    assert got[42].labels == "" and got[49].labels == "mit"
    assert licenses.scan_licenses(odd(spark)).count() == len(ODD) + 3
    assert licenses.scan_licenses(odd(spark).limit(0)).count() == 0


# --- 9: urls ----------------------------------------------------------------------------


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host, best = low(host), None
    for rule, verdict in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_url_rules_and_model(spark):
    rows = ["http://A.Example.ORG/es/x?q", "https://example.org/en/1#f", "http://xexample.org/en/1", "http://b.com/fr/", "http://b.com/de/?x", "http://com", "x://com/fr/", None, "", "no scheme", "http://", "http://h?://com/de/", "http://cheappills.net/a", "http://cheap-pills.net/a", "a://b\nc/d\n?e"]
    rows += [f"http://news{k}.net/page/{k}" for k in range(20)] + ["http://cheap.net/pills", "http://pills.net/", "http://cheap-deals.net/"]
    d = spark.createDataFrame(list(enumerate(rows)) + [(0, rows[0]), (None, rows[1])], "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    got = urls.filter_urls(d).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        host, path, best = brute_url(rows[r.page_id if r.page_id is not None else 1])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.score > 0 else "allow")
    by_id = {r.page_id: r for r in got}
    assert by_id[12].words == "cheap pills" and by_id[12].verdict == "block" and by_id[20].verdict == "allow"
    assert urls.filter_urls(d.limit(0)).count() == 0


def test_url_results_do_not_depend_on_what_goes_to_every_task(spark, monkeypatch):
    rows = [f"http://{h}.net/{p}{k}/{p}" for k in range(6) for h, p in (("cheap-pills", "offer"), ("cheappills", "slug"), ("dailynews", "daily"), ("news-daily", "paper"), (f"oddhost{k}", "slug"))]
    rows += ["http://cheap.net/pills", "http://pills.net/", "http://antidisestablishmentarianisms-x.com/", "http://myantidisestablishmentarianisms.com/"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")

    def run(words, names):
        monkeypatch.setattr(urls, "VOCABULARY", words)
        monkeypatch.setattr(urls, "TOKENS", names)
        return {r.page_id: r for r in urls.filter_urls(d, html_col=None).collect()}

    whole = run(50_000, 100_000)
    assert whole[len(rows) - 1].words == "my antidisestablishmentarianisms"
    for words, names in ((50_000, 3), (2, 100_000), (1, 1)):
        got = run(words, names)
        for k, r in whole.items():
            assert (got[k].words, got[k].verdict) == (r.words, r.verdict) and got[k].score == pytest.approx(r.score)


def test_segmenter_equals_brute_force():
    counts = {"cheap": 5, "pills": 3, "ch": 2, "eap": 1, "p": 9, "ills": 2, "a": 4}
    s = urls.Segmenter(counts)
    for text in ("cheappills", "apills", "chap", "zzz", ""):
        every = [()] if not text else [tuple(text[i:j] for i, j in itertools.pairwise([0, *c, len(text)])) for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n)]
        best = max(sum(s.cost(w) for w in e) for e in every)
        assert sum(s.cost(w) for w in s.split(text)) == pytest.approx(best) and "".join(s.split(text)) == text


# --- pipeline and registration ------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    d = table(spark, SF, "documents")
    seen, columns = [d.count()], d.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, d, SF)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and sum((k in ids) == bool(q) for k, q in labels.items()) >= 0.9 * len(labels)
    lined = stages["line dedup"](spark, kept, SF)
    assert lined.columns == columns
    unique = stages["near duplicates"](spark, lined, SF)
    rows = lined.orderBy("doc_id").collect()
    want = brute_classes([r.text for r in rows])
    assert {r.doc_id for r in unique.collect()} == {rows[root].doc_id for _, root in want}
    clean = stages["decontamination"](spark, unique, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    good = {r.doc_id for r in unique.collect() for n, h, _ in [brute_hits(r.text, items, 13)] if not (h and 20 * len(h) >= n)}
    assert {r.doc_id for r in clean.collect()} == good and clean.columns == columns
    run = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in run.collect()} == good and seen[0] > len(good)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    d = odd(spark).withColumn("n_chars", F.lit(1).cast("long"))
    stage = dict(corpus_pipeline.STAGES)[name]
    for part in (d, d.limit(0), d.where("text IS NULL")):
        out = stage(spark, part, SF)
        assert out.count() <= part.count()
        assert name == "tokens" or out.columns == d.columns


def test_every_operator_is_registered():
    names = list(queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)
