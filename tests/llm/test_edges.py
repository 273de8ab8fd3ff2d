"""Cases at the edges: rows without id, bytes that are no UTF-8, characters beyond 255, very long and very deep input, large groups."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, lines, neardup, pages, passages, quality
from quillspark.llm import textkernel as K
from quillspark.llm.runtime import Scratch

LONG = "the line of a row that has no id, and which is long enough to be near to another"


def broken(spark, rows):
    """Rows (id, bytes) as strings that may hold anything."""
    return spark.createDataFrame(rows, "doc_id long, raw binary").select("doc_id", F.expr("CAST(raw AS STRING)").alias("text"))


def deduped(spark, rows):
    return sorted(((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()), key=repr)


def test_lines_near_those_of_rows_without_id(spark):
    assert deduped(spark, [(None, LONG), (5, LONG), (7, LONG + "!")]) == sorted([(None, LONG), (5, ""), (7, "")], key=repr)
    assert deduped(spark, [(None, LONG), (7, LONG + "!"), (8, "else")]) == sorted([(None, LONG), (7, ""), (8, "else")], key=repr)
    assert deduped(spark, [(5, LONG), (7, LONG + "!")]) == [(5, LONG), (7, "")]


def test_line_ids_of_other_types(spark):
    rows = [("b", LONG), ("a", LONG + "!"), (None, "x"), ("c", "x\nx")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.text for r in got} == {"a": LONG + "!", "b": "", None: "x", "c": ""}
    rows = [(-3, "y\n" + LONG), (-2, LONG + "!\nz"), (2**62, LONG)]
    assert deduped(spark, rows) == sorted([(-3, "y\n" + LONG), (-2, "z"), (2**62, "")], key=repr)


def test_documents_near_those_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = [*words[:-1], "other"]
    rows = [(None, " ".join(words)), (9, " ".join(near)), (4, " ".join([*near[:-1], "third"]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 4, False), (9, 4, False), (4, 4, True)}
    rows = [(None, " ".join(words)), (9, " ".join(near))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 9, False), (9, 9, True)}


def test_bytes_that_are_no_text(spark):
    bad = b"one \xff\xfe line of some length that is read all the same\nand \xc3"
    rows = [(1, bad), (2, b"\xa9 a row that begins inside a character"), (3, "naïve – text".encode()), (4, None)]
    df = broken(spark, rows)
    got = {r.doc_id: r for r in bpe.digest(df).collect()}
    for k, raw in rows:
        assert got[k].decoded_sha256 == hashlib.sha256((raw or b"").decode("utf-8", "replace").encode()).hexdigest()
    assert lines.dedup_lines(df, Scratch(spark, "t")).select(F.expr("CAST(text AS BINARY)").alias("b"), "doc_id").where("doc_id = 1").first().b == bad
    twice = broken(spark, [(1, bad), (2, b"x\n" + bad)])
    cut = lines.dedup_lines(twice, Scratch(spark, "t")).where("doc_id = 2").select(F.expr("CAST(text AS BINARY)").alias("b")).first().b
    assert cut == b"x"
    long = b" ".join(b"w%d\xff" % k for k in range(80))
    out = passages.remove_repeats(broken(spark, [(1, long), (2, b"\xfe new " + long)]), Scratch(spark, "t"))
    assert out.where("doc_id = 2").select(F.expr("CAST(text AS BINARY)").alias("b")).first().b.startswith(b"\xfe new")
    assert neardup.near_duplicates(df, Scratch(spark, "t")).count() == 4 and quality.judge(df).count() == 4
    html = spark.createDataFrame([(1, "http://h/", b"<p>ab\xff</p>"), (2, None, None)], "page_id long, url string, raw binary").select("page_id", "url", F.expr("CAST(raw AS STRING)").alias("html"))
    assert {r.page_id: r.text for r in pages.extract(html, Scratch(spark, "t")).collect()} == {1: "ab�", 2: ""}


def line_set(line):
    text = " ".join(line.translate({c: c + 32 for c in range(65, 91)}).split())
    return {text[k : k + 8] for k in range(max(1, len(text) - 7))} if text else set()


def test_lines_of_many_alphabets():
    rng = random.Random(3)
    letters = "abcdefgh ABC  éßÿ–—“日本語Жю😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 40]))) for _ in range(400)]
    texts += [t.lower() for t in texts[:50]] + [" " + t for t in texts[:50]]
    normal = [" ".join(t.translate({c: c + 32 for c in range(65, 91)}).split()) for t in texts]
    data, offsets = K.flat(pa.array(texts))
    values, bounds = lines.line_sets(data, offsets)
    own = [frozenset(values[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(texts))]
    want = [line_set(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in want]
    for a, b in [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(3000)]:
        assert len(own[a] & own[b]) == len(want[a] & want[b])
    read = lines.read_lines(data, offsets)
    digest = dict(zip(read.row.tolist(), zip(*(x.tolist() for x in lines.line_digests(read)), strict=True), strict=True))
    assert len(set(digest.values())) == len({t for t in normal if t}) and set(digest) == {k for k, t in enumerate(normal) if t}
    assert all((digest[a] == digest[b]) == (normal[a] == normal[b]) for a in digest for b in (0, 1, 400, 401, 450) if b in digest)
    joined = lines.read_lines(*K.flat(pa.array(["\n".join(texts)])))
    assert list(zip(*(x.tolist() for x in lines.line_digests(joined)), strict=True)) == [digest[k] for k in sorted(digest)]
    assert joined.number.tolist() == sorted(digest)


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    text = " ".join(words)
    rows = [(1, text), (2, text + " more"), (3, "short text here"), (4, "\n".join([text, "x", text]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4 if got[4].component_id == 4 else 1}
    assert {r.doc_id: len(r.text) for r in lines.dedup_lines(df, Scratch(spark, "t")).collect()} == {1: len(text), 2: 0, 3: 15, 4: 1}
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {1: 400_000, 2: 400_001, 3: 3, 4: 800_001}
    cut = {r.doc_id: r for r in passages.remove_repeats(df, Scratch(spark, "t")).collect()}
    assert cut[1].removed == [] and len(cut[2].text.split()) <= 31 and len(cut[4].text.split()) <= 62


def test_winnowing_equals_plain():
    rng = np.random.default_rng(2)
    for _ in range(30):
        count = rng.integers(0, 60, 12)
        values = rng.integers(0, 50, int(count.sum())).astype(np.uint64)
        first = np.cumsum(count) - count
        want = set()
        for a, n in zip(first.tolist(), count.tolist(), strict=True):
            for k in range(max(1, n - passages.WINNOW + 1) if n else 0):
                part = values[a + k : a + min(n, k + passages.WINNOW)]
                want.add(a + k + int(part.argmin()))
        assert set(passages.winnowed(values, first, count).tolist()) == want


def test_deep_pages():
    for page in ("<div>" * 40_000 + "text", "<div class='ad'>" * 40_000 + "text" + "</b>" * 40_000):
        blocks, places = pages.read(page)
        assert len(places) == 40_000 and [b.text for b in blocks] == ["text"]
    assert pages.main_text("<div>" * 40_000 + "text", frozenset()) == "text"


def test_classes_equal_grouping_by_vectors(spark):
    rng = random.Random(5)
    rows = []
    for h in ("a.example", "b.example", "c.example"):
        common = [f"notice {h} {k}" for k in range(6)]
        for k in range(rng.randrange(3, 12)):
            body = "".join(f"<div><p>{x}</p></div>" for x in common if rng.random() < 0.8) + "".join(f"<p>{rng.choice('xyz')} {rng.randrange(40)}</p>" for _ in range(5))
            rows.append((len(rows), f"http://{h}/{k}", f"<html><body><h1>page {k}</h1>{body}</body></html>"))
            if k % 4 == 0:
                rows.append((len(rows), f"http://{h}/{k}/copy", rows[-1][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", pages.host(F.col("url")))
    vectors, contents = defaultdict(Counter), defaultdict(set)
    for _, url, html in rows:
        h = url.split("/")[2]
        blocks, places = pages.read(html)
        content = pages.content_of(blocks)
        if content not in contents[h]:
            contents[h].add(content)
            for t in pages.tokens_of(blocks, places):
                vectors[h, t][content] += 1
    classes = defaultdict(set)
    for (h, (t, _)), vector in vectors.items():
        if len(vector) >= pages.MIN_PAGES:
            classes[h, tuple(sorted(vector.items()))].add(t)
    want = sorted((h, sorted(tokens), len(v), len(contents[h])) for (h, v), tokens in classes.items())
    got = sorted((r.host, sorted(r.tokens), r.pages, r.all_pages) for r in pages.classes_of(pages.occurrences(df), Scratch(spark, "t")).collect())
    assert got == want and len(want) > 6
    template = {r.host: set(r.template) for r in pages.templates(df, Scratch(spark, "t")).collect()}
    place = {t: p for _, (t, p) in vectors}
    assert template and all(place[t] == 0 or place[t] in template[h] for h in template for t in template[h])


def test_one_large_bucket_is_dealt_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 512)
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("uid"), F.lit(7).cast("long").alias("key"), F.lit(0).alias("band"), F.when(F.col("id") < 5, F.col("id")).otherwise(-1).cast("long").alias("component"))
    rows = rows.withColumn("largest", F.lit(-1).cast("long")).withColumn("main", F.lit(-(-(n - 5) // 512)).cast("long")).withColumn("rest", F.lit(1).cast("long"))
    rows = rows.select("*", F.lit(9).cast("long").alias("n_shingles"), F.lit(b"").alias("sketch"), F.lit(b"").alias("parity"), F.array(F.lit(1).cast("long")).alias("bands"))
    dealt = neardup._dealt(rows).select("key", "uid", "side", "component").collect()
    assert len(dealt) == (n - 5) + 5 * (-(-(n - 5) // 512) + 1)
    groups = defaultdict(list)
    for r in dealt:
        groups[r.key].append(r)
    assert max(map(len, groups.values())) < 800
    met = Counter()
    for g in groups.values():
        for a in (r for r in g if r.component >= 0):
            for b in g:
                if a.component != b.component and (a.side < 0 or a.side != b.side):
                    met[min(a.uid, b.uid), max(a.uid, b.uid)] += 1
    assert set(met) == {(a, b) for a in range(5) for b in range(a + 1, n)}


def test_a_bucket_of_one_component_is_not_dealt(spark):
    method = neardup.Method(bands=2)
    facts = spark.range(20_000).select(F.col("id").alias("uid"), F.lit(9).cast("long").alias("n_shingles"), F.lit(b"").alias("sketch"), F.lit(b"").alias("parity"), F.lit(1).cast("long").alias("band0"), F.col("id").alias("band1"))
    component = spark.range(20_000).select(F.col("id").alias("uid"), F.lit(0).cast("long").alias("component"))
    assert neardup._open(Scratch(spark, "t"), facts, component, method, 2).count() == 0


@pytest.mark.parametrize("far", [0, 1])
def test_leaders_are_bounded(monkeypatch, far):
    monkeypatch.setattr(neardup, "LEADERS", 4)
    rng = np.random.default_rng(far)
    method = neardup.Method()
    entries = np.zeros(300, neardup._entry(method))
    if far:
        entries["sketch"] = rng.integers(0, 256, entries["sketch"].shape)
    left, right, lead = neardup._leaders(method, entries, np.array([0]), np.array([300]))
    assert (len(right), len(lead)) == ((0, 4) if far else (299, 1))
    alone = np.ones(300, bool)
    alone[left] = alone[right] = False
    assert neardup._possible(method, entries["sketch"], alone, np.array([0]), np.array([300])).sum() == 0


def test_rules_are_ordered_by_what_they_meet():
    seen = []

    def rule(name, feature, share):
        def rejects(f):
            seen.append((name, f.n, feature in f.have))
            f.get(feature)
            return np.arange(f.n) < share * f.n

        return quality.Rule(name, rejects)

    f = quality.Features(*K.flat(pa.array(["one two three, and more words here"] * 1000)))
    rules = (rule("none", "n_words", 0), rule("most", "n_words", 0.9), rule("half", "n_symbols", 0.5))
    order = quality.greedy_order(f, rules)
    assert sorted(k for k, *_ in order) == [0, 1, 2] and rules[order[0][0]].name != "none"
    assert [n for *_, n in order][0] == 1000 and [n for *_, n in order][1] == 1000 - order[0][2]
    assert any(warm for _, _, warm in seen)
    kept = quality.cascade(f, tuple(rules[k] for k, *_ in order))
    assert len(kept) == [n for *_, n in order][-1] - order[-1][2]


def test_ranges_against_plain_windows(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passages_known = [fresh(rng.choice([18, 30, 52, 90, 200])) for _ in range(12)]
    lines_known = [fresh(rng.choice([6, 19, 20, 33])) for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            text.append(" ".join(fresh(rng.randrange(40)) + rng.choice(passages_known) + fresh(rng.randrange(20))) if kind < 0.5 else " ".join(rng.choice(lines_known)) if kind < 0.8 else " ".join(fresh(60)))
        rows.append((i, "\n".join(text)))
    got = {r.doc_id: r for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    seen_windows, seen_lines, n_removed = set(), set(), 0
    for i, text in rows:
        words, starts, lines_of, at = [], [], [], 0
        for line in text.split("\n"):
            own = line.split(" ")
            lines_of.append((len(words), own))
            for w in own:
                starts.append(at)
                words.append(w)
                at += len(w) + 1
        removed = {k for k, s in enumerate(starts) if any(r.start <= s < r.end for r in got[i].removed)}
        windows = [tuple(words[k : k + passages.WINDOW]) for k in range(len(words) - passages.WINDOW + 1)]
        known, own_windows, own_lines = set(), set(), set()
        for k, w in enumerate(windows):
            if w in seen_windows or w in own_windows:
                known |= set(range(k, k + passages.WINDOW))
            own_windows.add(w)
        for k, own in lines_of:
            if len(own) >= passages.MIN_WORDS and (tuple(own) in seen_lines or tuple(own) in own_lines):
                known |= set(range(k, k + len(own)))
                assert set(range(k, k + len(own))) <= removed
            own_lines.add(tuple(own))
        assert removed <= known
        run = []
        for k in range(len(words) + 1):
            if k < len(words) and k in known:
                run.append(k)
            else:
                if len(run) > 50:
                    assert set(run[15:-15]) <= removed
                run = []
        n_removed += len(removed)
        seen_windows |= own_windows
        seen_lines |= own_lines
    assert n_removed > 1000


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, removed_lines string, component_id string, size string, copies string"
    words = " ".join(f"w{k}" for k in range(70))
    rows = [(1, None, None, None, None, "x", "y", "z", "c"), (2, "", "en", "a", 0, "x", "y", "z", "c"), (None, words, "en", "a", 5, "x", "y", "z", "c"), (3, words + " again", "en", None, 5, "x", "y", "z", "c"), (3, words + " again", "en", None, 5, "x", "y", "z", "c")]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) > 0) == bool(some)
