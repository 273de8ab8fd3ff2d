"""The sample behind the token counts' broadcast table."""

from __future__ import annotations

import pytest

from quillspark.llm import tokencount

pytest.importorskip("sentencepiece")


def test_every_part_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "FREQUENT", 50)
    rows = [(k, " ".join(f"a{k:02}{j:02}" for j in range(20))) for k in range(50)] + [(50 + k, " ".join(f"other{j:04}" for j in range(10))) for k in range(50)]
    parts = spark.sparkContext.parallelize(rows, 2).toDF("doc_id long, text string")
    _, _, lengths, tokens = tokencount.frequent_lengths(parts, tokencount.vocabulary_path(tokencount.VOCABULARY))
    assert len(lengths) == len(tokens) == 50 and sum(n >= 9 for n in lengths.tolist()) >= 9
    got = tokencount.count_tokens(parts).collect()
    assert len(got) == 100 and len(tokencount.frequent_lengths(parts.limit(0), tokencount.vocabulary_path(tokencount.VOCABULARY))[0]) == 0


def test_sampled_counts_equal_library(spark):
    import numpy as np

    path = tokencount.vocabulary_path(tokencount.VOCABULARY)
    words = ["a", "sevenxx", "eight888", "nine99999", "fifteen15151515", "sixteen161616161", "é中 ß", "word,"]
    parts = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    found = sorted(zip(*(x.tolist() for x in tokencount.frequent_lengths(parts, path)), strict=True))
    count, want = tokencount.library(path), []
    for w in {x for w in words for x in w.split(" ")}:
        raw = np.frombuffer(w.encode(), np.uint8)
        a, b = tokencount.keys(raw, np.array([0]), np.array([len(raw)]))
        want.append((int(a[0]), int(b[0]), len(raw), count(w.encode())))
    assert found == sorted(want)
