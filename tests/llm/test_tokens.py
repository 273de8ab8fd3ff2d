"""Encoder, token counts: against the libraries that they must equal."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe, tokencount
from quillspark.llm import textkernel as K

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")

PARTS = ["'", "'s", "'re", "'LL", "'v", "e", "a", "T", " ", "  ", "\n", "\t", "1", "²", "!", "é", "中", " ", " ", "\x1c", "\x85", "😀", "़", "ß", "<|endoftext|>", "''", "\r\n", "▁", "<s>", "\x00"]
texts = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=25).map("".join))


@pytest.fixture(scope="module")
def library():
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(batch):
    c, out = bpe.codec(P.path(bpe.VOCABULARY)), []
    for a, b, data, offsets in K.chunks(pa.array(batch, pa.string()), 64):
        ids, bounds, starts, length = c.encode(data, offsets)
        back, at = c.decode(ids, bounds)
        assert int(length.sum()) == len(ids) and (np.diff(starts) > 0).all()
        out += [(ids[bounds[k] : bounds[k + 1]].tolist(), back[at[k] : at[k + 1]].tobytes()) for k in range(b - a)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=6))
def test_encoder_equals_library(library, batch):
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    assert encoded(batch) == [(library.encode_ordinary(t), t.encode()) for t in batch]


def test_long_and_empty(library):
    batch = ["", "a" * 3000, " " * 300 + "x", "ab " * 3000, None]
    assert encoded(batch) == [(library.encode_ordinary(t or ""), (t or "").encode()) for t in batch]


def test_scan_equals_steps():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2 * bpe.FIRST, 5000).astype(np.uint8)
    state, want = bpe.OVER, []
    for x in symbols.tolist():
        want.append(state)
        state = bpe._step(state, x)
    assert bpe.states_before(symbols).tolist() == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")


def test_tables(spark, library):
    rows = [(1, "Hello, it's 12 o'clock\n\n ok", "x", 9), (2, None, None, None), (None, "", "y", 1), (3, "same", "z", 2), (3, "same", "z", 2)]
    got = sorted(bpe.digest(frame(spark, rows)).collect(), key=repr)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(r)) or sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    enc = bpe.encode(frame(spark, rows))
    assert sorted((r.text for r in bpe.decode(enc).collect()), key=repr) == sorted((t or "" for _, t, _, _ in rows), key=repr)
    one = enc.where("doc_id = 1").first()
    assert len(one.ids) == len(one.piece_offsets) and one.piece_offsets[0] == 0
    assert bpe.digest(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_counts_equal_library(batch):
    path = tokencount.vocabulary_path(tokencount.VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    counter, got = tokencount.Counter(path), []
    for _, _, data, offsets in K.chunks(pa.array(batch, pa.string()), 64):
        got += counter.rows(data, offsets).tolist()
    assert got == [len(model.encode(t)) for t in batch]


def test_count_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.vocabulary_path(tokencount.VOCABULARY))
    rows = [(1, "the the  the", "", 0), (2, None, "", 0), (3, "", "", 0), (4, "word " * 5000, "", 0), (None, "é", None, None)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(frame(spark, rows)).collect()}
    assert got == {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _, _ in rows}
    assert tokencount.count_tokens(frame(spark, [])).count() == 0
