"""Whitening: against fractions and a plain eigendecomposition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import whitening as W

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(n, exact covariance, integers) of the rows that count."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[k] for r in x), n) for k in range(d)]
    return n, [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)], x


def check(got, rows, components=32):
    """Rows (id, component, n, deviation, whitened, explained, identity_error) against what the vectors say."""
    n, cov, x = plain([v for _, v in rows])
    v = np.array([[float(c) for c in r] for r in cov])
    trace, d = float(sum(cov[k][k] for k in range(len(cov)))), len(cov)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = max(r[1] for r in got)
    assert len(got) == len(rows) * k and k <= min(components, d)
    assert {r[2] for r in got} == {n} and len({r[6] for r in got}) == 1 and got[0][6] <= 1e-4
    sums = [sum(r[j] for r in x) for j in range(d)]
    for (i, _), own in zip(rows, x, strict=True):
        assert {r[3] for r in got if r[0] == i} == {sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))}
    w = np.array([[r[4] for r in sorted(got) if r[0] == i] for i, _ in rows])
    assert np.abs(w.T @ w / n - np.eye(k)).max() <= 1e-4 and abs(np.abs(w.T @ w / n - np.eye(k)).max() - got[0][6]) < 1e-9
    assert [r[5] for r in sorted(got)[:k]] == pytest.approx((values[:k] / trace).tolist(), rel=1e-4)
    # Projections: centred rows times components are whitened values times roots, whatever the sign.
    centred = np.array([[float(c - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    projected = w * np.sqrt(values[:k])
    assert np.abs(projected.T @ centred / n - projected.T @ projected / n @ np.linalg.lstsq(projected, centred, rcond=None)[0]).max() < 1e-6 * trace


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string")


def test_given_table(spark):
    from quillspark.llm.registry import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries()["op11_embedding_whitening"](spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = [tuple(r) for r in out.collect()]
    assert max(r[1] for r in got) == 32
    check(got, rows)


def test_odd_rows(frame):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3).astype("float32").tolist()) for k in range(40)] + [(7, [0.5, 0.25, -0.125]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, [])]
    got = [tuple(r) for r in W.whiten(frame([(i, v, 0, "x") for i, v in good + odd]).repartition(4)).collect()]
    assert {r[0] for r in got} == {i for i, _ in good} and {r[2] for r in got} == {len(good)} and len(got) == 3 * len(good)
    unique = {i: v for i, v in good}
    assert len(unique) < len(good) and got[0][6] < 1e-9


def test_constant_dimensions_and_few_rows(frame):
    rows = [(k, [float(k), 1.0, float(-k)]) for k in range(9)]
    got = [tuple(r) for r in W.whiten(frame([(*r, 0, "") for r in rows])).collect()]
    assert {r[1] for r in got} == {1} and got[0][5] == pytest.approx(1.0)  # one direction only
    check(got, rows)
    assert W.whiten(frame([(1, [1.0, 2.0], 0, "")])).count() == 0 and W.whiten(frame([])).count() == 0
    assert W.whiten(frame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")])).count() == 0
    two = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0])]
    check([tuple(r) for r in W.whiten(frame([(*r, 0, "") for r in two])).collect()], two)


def test_lengths_are_apart(frame):
    rows = [(k, [float(k), float(k * k)]) for k in range(5)] + [(10 + k, [float(k % 3), 1.0, float(k % 2)]) for k in range(6)]
    got = [tuple(r) for r in W.whiten(frame([(*r, 0, "") for r in rows])).collect()]
    for size in (2, 3):
        own = [r for r in rows if len(r[1]) == size]
        kept = [r for r in got if r[0] in {i for i, _ in own}]
        assert {r[2] for r in kept} == {len(own)} and {r[1] for r in kept} == {1, 2}


def test_large_entries(spark):
    rows = [(k, [float(k) * 2.0**40, (-1.0) ** k * 2.0**41, 1e300, -1e300]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in W.whiten(df).collect()]
    x = [[int(64 * v[0]), int(64 * v[1])] for _, v in rows]
    sums = [sum(r[j] for r in x) for j in range(2)]
    want = {k: sum((6 * c - s) ** 2 for c, s in zip(x[k], sums, strict=True)) for k in range(6)}
    assert {r[0]: int(r[3]) for r in got} == want and {r[1] for r in got} == {1, 2} and got[0][6] < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(-(2**63), 2**63 - 1 - W.SHIFT), min_size=1, max_size=40))
def test_sums_are_exact(size, numbers):
    x = np.array((numbers * size)[: len(numbers) * size], np.int64).reshape(-1, size)
    own = W.Sums(size)
    for part in np.array_split(x, 3):
        if len(part):
            own.add(part)
    cells = {}
    for cell, place, digit in own.digits():
        cells[cell] = cells.get(cell, 0) + (digit << (W.DIGIT * place))
    big = x.astype(object)
    want = [len(x), *big.sum(axis=0).tolist(), *(big.T @ big)[np.triu_indices(size)].tolist()]
    assert [cells.get(k, 0) for k in range(len(want))] == want


def test_blocks_are_exact():
    x = np.full((3 * W.BLOCK, 2), 2**20 - 1, np.int64)
    own = W.Sums(2)
    own.add(x)
    assert own.products[0, 1] == 3 * W.BLOCK * (2**20 - 1) ** 2 and own.sums[0] == 3 * W.BLOCK * (2**20 - 1)


def test_integers_and_rank():
    assert W.integers(np.array([0.0, 1.0, -0.001, 0.015625, 1e308, -1e308])).tolist() == [0, 64, -1, 1, 2**63 - 1 - W.SHIFT, -(2**63)]
    m = np.array([[1, 2, 3], [2, 4, 6], [1, 0, 10**30]], object)
    assert W.rank(m) == 2 and W.rank(np.zeros((3, 3), object)) == 0 and W.rank(np.diag([W.PRIMES[0], 1, 5]).astype(object)) == 3
    lists = pa.array([[1.0], None, [2.0, 3.0], [], [4.0, None]], pa.list_(pa.float64())).slice(1)
    assert [(r.tolist(), x.tolist()) for r, x in W.valid_rows(lists)] == [([2], [[]]), ([1], [[128, 192]])]
