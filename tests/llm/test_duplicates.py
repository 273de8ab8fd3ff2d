"""Near-duplicates of documents, lines, vectors; repeated passages; the pipeline. All against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, components, embeddings, lines, mixing, neardup, passages, quality
from quillspark.llm import textkernel as K
from quillspark.llm.runtime import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def groups(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(sets, part):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]


def word_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=5, n=160):
    """Families of texts at all similarities, copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        if k % 4 == 0 or not out:
            out.append([rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))])
        else:
            base = list(rng.choice(out[-12:]))
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary).upper()
            out.append(base)
    return [(k, " ".join(w) if k % 3 else "\n".join(w)) for k, w in enumerate(out)] + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("uid", "first", "sig", "lines", "ranges", "id", "hi"):  # names that the operators use themselves
        df = df.withColumn(c, F.lit(c))
    return df


def test_near_duplicates(spark):
    rows = corpus()
    sets = {i: word_set(t) for i, t in rows}
    want = groups(sets, linked(sets, 75))
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = neardup.keep_one(frame(spark, rows), Scratch(spark, "t"))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == frame(spark, []).columns


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 8)
    monkeypatch.setattr(neardup, "LOCAL", 4)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(w)))
    sets = {i: word_set(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert got == groups(sets, linked(sets, 75))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "q r s t u v w")]
    got = sorted(map(tuple, neardup.near_duplicates(frame(spark, rows), Scratch(spark, "t")).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 2, True)], key=repr)
    assert neardup.near_duplicates(frame(spark, rows).limit(0), Scratch(spark, "t")).count() == 0


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(100)]
    nodes = {x for e in edges for x in e}
    want = {n: c for n, c in groups(nodes, edges).items()}
    got = dict(map(tuple, components.connected(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {n: got.get(n, n) for n in nodes} == want
    monkeypatch.setattr(components, "TASK_EDGES", 50)
    got = dict(map(tuple, components.connected(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {n: got.get(n, n) for n in nodes} == want


def test_signatures_estimate():
    rng = np.random.default_rng(1)
    for n in (3, 30, 400):
        off = []
        for _ in range(40):
            base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = base[: n + n // 2], base[n // 2 :]
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = K.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
            off.append((s[0] == s[1]).mean() - j)
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


def line_set(line):
    text = " ".join(WORDS.findall(line.translate(LOWER)))
    return {text[k : k + 8] for k in range(max(1, len(text) - 7))} if text else set()


def deduped(rows):
    """Texts without lines whose group has an earlier line."""
    places = {(i, k): line for i, t in sorted(rows, key=lambda r: r[0]) for k, line in enumerate((t or "").split("\n")) if WORDS.search(line)}
    sets = {p: line_set(line) for p, line in places.items()}
    same = groups(sets, linked(sets, 80))
    out = {}
    for i, t in rows:
        out[i] = t if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if same.get((i, k), (i, k)) == (i, k))
    return out


def line_corpus(n=60):
    rng = random.Random(4)
    pool = [" ".join(f"word{rng.randrange(90)}" for _ in range(rng.choice([1, 4, 20, 45]))) for _ in range(50)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            if rng.random() < 0.5 and len(line) > 40:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["é", "XY", " "]) + line[at + rng.randrange(3) :]
            text.append(line.upper() if rng.random() < 0.2 else line)
            if rng.random() < 0.2:
                text.append(" ")
        rows.append((i, "\n".join(text)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n")]


def test_line_dedup(spark):
    rows = line_corpus()
    got = lines.dedup_lines(frame(spark, rows), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.text for r in got} == deduped(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        if text is not None:
            assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in r.removed_lines)
    assert lines.dedup_lines(frame(spark, []), Scratch(spark, "t"), report=False).count() == 0
    odd = [(None, "same line here"), (3, "same line here"), (3, "same line here")]
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(frame(spark, odd), Scratch(spark, "t")).collect()) == [(0, "same line here"), (3, ""), (3, "")]


def test_line_sets():
    texts = ["", "a", "abc  d ", "  ABC d", "12345678", " 123456789 ", "\t", "Éa é" * 9]
    data, offsets = K.flat(pa.array(texts))
    values, bounds = lines.line_sets(data, offsets)
    own = [set(values[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(texts))]
    want = [line_set(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in want] and own[2] == own[3]


class Passed:
    """A table whose mapInArrow is run here."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_signatures_of_many_chunks_take_few_rounds(monkeypatch):
    rng = random.Random(8)
    texts = ["\n".join("".join(rng.choice("abcdeé界 ") for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 200]))) for _ in range(40)) for _ in range(60)]
    texts[7] = None
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(lines, "CHUNK", 1 << 12)
    rounds, mixed = [], K.mix_in_place
    monkeypatch.setattr(K, "mix_in_place", lambda x: rounds.append(len(x)) or mixed(x))
    run = lines._lines(Passed(), "doc_id")
    got = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    chunks = len(list(K.chunks(batch.column(1), lines.CHUNK)))
    assert chunks > 30 and len(rounds) <= 2 * chunks + lines.METHOD.slots
    monkeypatch.undo()
    want, seen = {}, set()
    for i, text in enumerate(texts):
        own = lines.read_lines(*K.flat(pa.array([text], pa.string())))
        bands = lines.bands_of(K.super_minhash(*lines.line_shingles(own), lines.METHOD.slots)).T.tolist()
        for number, digest, band in zip(own.number.tolist(), zip(*[x.tolist() for x in lines.line_digests(own)], strict=True), bands, strict=True):
            want[i, number] = *digest, *(band if digest not in seen else [None] * len(band))
            seen.add(digest)
    assert {(r["id"], r["line"]): tuple(r.values())[2:] for r in got} == want and len(got) == len(want)


def test_pairs_are_verified_together():
    rng = random.Random(9)
    texts = ["", "a", "abcdefgh"]
    for _ in range(300):
        base = list(rng.choice(texts)) if rng.random() < 0.7 else [rng.choice("abcdefg é") for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(5) if base else 0):
            base[rng.randrange(len(base))] = rng.choice("xyz界")
        texts.append("".join(base))
    values, bounds = lines.line_sets(*K.flat(pa.array(texts)))
    own = [set(values[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(texts))]
    one, other = (np.array([rng.randrange(len(texts)) for _ in range(4000)]) for _ in range(2))
    got = neardup._reach_pairs(lines.METHOD, values, bounds, one, other)
    assert got.tolist() == [len(own[a] | own[b]) > 0 and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) and len(own[a] & own[b]) > 0 for a, b in zip(one, other, strict=True)]
    assert got.any()


def test_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = fresh(60), fresh(25)
    rows = [(5, " ".join(fresh(40) + passage + fresh(30))), (2, " ".join(fresh(10) + [w.upper() for w in passage] + fresh(10))), (7, "\n".join([" ".join(fresh(30)), " ".join(line), " ".join(fresh(5))])), (8, "x " + "\n" + "  ".join(line) + "\n"), (9, " ".join(fresh(200))), (10, None), (11, "")]
    got = {r.doc_id: r for r in passages.remove_repeats(frame(spark, rows), Scratch(spark, "t")).collect()}
    texts = dict(rows)
    assert all(got[i].text == texts[i] and got[i].removed == [] for i in (2, 7, 9, 10, 11))
    assert len(got[5].removed) == 1 and len(got[5].text.split()) <= 70 + 30 and len(got[8].removed) == 1 and got[8].text.split() == ["x"]
    for i in (5, 8):
        raw = texts[i].encode()
        cut = raw[got[i].removed[0].start : got[i].removed[0].end].decode().lower().split()
        assert len(cut) >= passages.MIN_WORDS and " ".join(cut) in " ".join(passage) + " | " + " ".join(line)
    again = passages.remove_repeats(frame(spark, [(1, " ".join(passage + fresh(20) + passage)), (None, " ".join(passage))]), Scratch(spark, "t"))
    by = {r.doc_id: r for r in again.collect()}
    assert len(by[1].removed) == 1 and by[None].removed == []
    assert passages.remove_repeats(frame(spark, []), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("length", range(51, 60))
def test_no_passage_is_missed(length):
    rng = random.Random(length)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(length)
    texts = [" ".join(fresh(rng.randrange(40)) + shared + fresh(rng.randrange(40))) for _ in range(30)]
    data, offsets = K.flat(pa.array(texts))
    row, hi, _, start, end, _ = passages.units(data, offsets)
    common = [k for k, n in zip(*np.unique(hi, return_counts=True), strict=True) if n > 1]
    for i, t in enumerate(texts):
        found = [{"start": int(s), "end": int(e)} for r, h, s, e in zip(row, hi, start, end, strict=True) if r == i and h in common]
        d, o = K.flat(pa.array([t]))
        assert passages._joined(found, *K.spans_of_words(d, o)), i


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((25, 32))
    rows = [(k, (centres[k % 25] + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.3, 0.8])).tolist()) for k in range(400)]
    rows += [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32), (403, [1.0, None] * 16), (404, rows[7][1][:16]), (405, rows[7][1]), (406, []), (405, rows[7][1]), (407, [1e300] * 32), (408, [1e300] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (u := v / np.abs(v).max()) / np.linalg.norm(u) for i, v in good.items()}
    ids = sorted(unit)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    want = groups({i for i, _ in rows}, edges)
    got = embeddings.near_duplicates(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and len(edges) > 200
    close = [abs(unit[a] @ unit[b] - 0.95) < 1e-9 for a, b in edges]
    assert not any(close)
    missed = sum(r.n_links != degree[r.vec_id] for r in got)
    assert missed <= 0.02 * len(got) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.component_id != want[r.vec_id] for r in got) <= missed
    assert embeddings.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.02).tolist()) for k in range(1100)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()
    assert {r.n_links for r in got} == {1099} and {r.component_id for r in got} == {0}


def test_pipeline(spark, tmp_path):
    from .test_rows import facts

    rng = random.Random(8)
    pool = [" ".join(f"v{rng.randrange(3000)}" for _ in range(30)) for _ in range(60)]
    rows = []
    for k in range(60):
        body = [" ".join(f"v{rng.randrange(3000)}" for _ in range(40)) for _ in range(3)] + rng.sample(pool, 2)
        rows.append((k, "\n".join(body)))
        if k % 6 == 0:
            words = rows[-1][1].split(" ")
            words[10] = "edited"
            rows.append((1000 + k, " ".join(words)))
        if k % 10 == 0:
            rows.append((2000 + k, "too short"))
            rows.append((3000 + k, rows[k][1].replace(" ", " $$ ")))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    def good(t):
        n, chars, symbols, dup, rep = facts(t)
        n_lines = sum(bool(WORDS.search(x)) for x in t.split("\n"))
        letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in WORDS.findall(t))
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or 2 * dup > n_lines or not 2 * n <= chars <= 40 * n or 10 * letters < 7 * n)

    left = [(i, t) for i, t in rows if good(t)]
    left = list(deduped(left).items())
    sets = {i: word_set(t) for i, t in left}
    same = groups(sets, linked(sets, 75))
    left = [(i, t) for i, t in left if same[i] == i]
    plan = mixing.plan(spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in left], "doc_id long, text string, source string"), Scratch(spark, "t"))
    copies = {r.doc_id: r.copies for r in plan.collect()}
    want = []
    for i, t in left:
        one = tuple(bpe.digest(spark.createDataFrame([(i, t)], "doc_id long, text string")).first()) if copies[i] else None
        want += [one] * copies[i]
    assert got == sorted(want) and 0 < len(left) < len(rows)
    assert quality.BASE and [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
