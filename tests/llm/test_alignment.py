"""Alignment of two tokenizers: against boundaries found by sets of byte offsets, and counts by plain dictionaries."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import alignment
from quillspark.llm import textkernel as K
from quillspark.llm.runtime import Scratch

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

PARTS = [
    "a", "bc", "The", " ", "  ", "   ", "\n", "\n\n", "\r", "\t", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "é", "中文", "😀", "‍", "'s", "'", "12", "2024", "!", "...", "ß",
    "<|endoftext|>", "<s>", "<0x0A>", "\x00", "\x7f", ";\r\n", "{\r\n", "word", " over", "aaaaaaa", "x.", "x,y", "e-f_g/h", "don't,", "é,", "a...", "#",
]
texts = st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=25).map("".join))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(libraries, text):
    """Groups of a text by offsets at which tokens of both sides end; None where there are no tokens."""
    if not text:
        return None
    a, b = libraries
    alphabet = alignment.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
    common = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for c in common:
        m, n = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
        out.append((ids_a[i:m], ids_b[j:n]))
        i, j = m, n
    return out


def written(groups):
    return "" if groups is None else hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest()


def expected(libraries, documents):
    every = [(i, plain(libraries, t)) for i, t in documents]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in every]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, g), own in zip(every, links, strict=True):
        best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), own.total(), best, sum(n * count[p] for p, n in own.items()), written(g)))
    return sorted(out, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=5))
def test_groups_equal_common_ends(libraries, batch):
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    own, at = alignment.aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), 0
    for i, j, data, offsets in K.chunks(pa.array(batch, pa.string()), 64):
        counts, digests, pairs, times, bounds = own.rows(data, offsets)
        for k, text in enumerate(batch[i:j]):
            want = plain(libraries, text)
            links = Counter(x * own.b.size + y for a, b in want or [] for x in a for y in b)
            assert counts[k].tolist() == [sum(len(a) for a, _ in want or []), sum(len(b) for _, b in want or []), len(want or []), links.total()]
            assert digests[k] == written(want)
            assert dict(zip(pairs[bounds[k] : bounds[k + 1]].tolist(), times[bounds[k] : bounds[k + 1]].tolist(), strict=True)) == links
        at = j
    assert at == len(batch)


def test_transducer_keeps_the_rest():
    t = alignment.Transducer({1: b"ab", 2: b"c", 3: b"abc", 4: b"x"}, {1: b"a", 2: b"bc", 3: b"abcabc"})
    assert t.groups([1, 2], [1, 2]) == [([1, 2], [1, 2])] and t.states[t.steps[1]] == (0, b"ab")
    assert t.groups([3, 1, 2], [3]) == [([3, 1, 2], [3])]
    assert t.groups([3, 3], [1, 2, 1, 2]) == [([3], [1, 2])] * 2
    assert t.groups([1], [1]) is None and t.groups([4], [1]) is None and t.groups([], []) == []
    assert alignment.linked([([1, 1, 2], [5, 5])], 10) == {15: 4, 25: 2}
    assert alignment.linked([([1] * 50 + [2], [5] * 30)], 10) == {15: 1500, 25: 30}


DOCUMENTS = [
    (1, "The quick brown fox"), (2, None), (3, ""), (4, "the sign ▁ is a space there"), (5, "over\n\nthe  lazy\r\ndog 2024"), (5, "over\n\nthe  lazy\r\ndog 2024"), (None, "no id"), (7, "a" * 5000), (8, "中文 😀 ok" * 300), (9, "\n \n x"), (10, " "),
]


@pytest.mark.parametrize("entries", [0, 3, 1 << 19])
def test_counts(spark, libraries, monkeypatch, entries):
    monkeypatch.setattr(alignment, "FREQUENT", entries)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in DOCUMENTS], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = alignment.align(df, Scratch(spark, "t"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(libraries, DOCUMENTS)


def test_empty_and_groups(spark, libraries):
    df = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    assert alignment.align(df.limit(0), Scratch(spark, "t")).count() == 0
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.groups(df).collect()}
    assert got == {i: plain(libraries, t) or [] for i, t in DOCUMENTS}


def test_given_table(spark, libraries):
    from quillspark.llm.registry import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries()["op13_token_alignment"](spark, sf).collect()), key=repr) == expected(libraries, rows)
