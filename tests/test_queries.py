"""Every query against its SQL on the smallest tables, and those without SQL against a brute-force version."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from quillspark.operators import resampling
from quillspark.plans import catalog
from quillspark.plans.scoring_queries import edit_rows, turn_pairs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(df):
    def clean(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else v

    df = df[sorted(df.columns)]
    return list(df.columns), sorted([tuple(clean(v) for v in r) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert values(catalog.queries()[name](spark, SF).toPandas()) == values(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("groups", ["_FEW_SQL", "_DOMINANT_SQL"])
def test_parts_are_really_filled(duck, groups):
    from quillspark.plans import corpus_queries

    moved = duck.sql(f"WITH RECURSIVE {getattr(corpus_queries, groups)} SELECT count(*) FILTER (WHERE moved), count(DISTINCT lang) FILTER (WHERE NOT moved), count(DISTINCT lang) FILTER (WHERE len = 0) FROM (SELECT parts.*, len(empty) AS len FROM parts JOIN gaps USING (lang))").fetchall()[0]
    assert moved[0] >= 3 and moved[2] >= 1  # some scopes need it and some don't


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_wer_by_role(spark):
    pairs = [r for r in turn_pairs(spark, SF).collect() if r.ref.strip()]
    want = {}
    for lang in {r.lang for r in pairs}:
        own = [(r.ref.split(), r.hyp.split()) for r in pairs if r.lang == lang]
        want[lang] = (len(own), round(100 * sum(distance(a, b) for a, b in own) / max(1, sum(len(a) for a, _ in own)), 9))
    assert {r.lang: (r.n, r.wer) for r in catalog.queries()["wer_by_role"](spark, SF).collect()} == want


def test_exact_resampling(spark):
    rows = edit_rows(spark, SF).toPandas().sort_values("pos")
    found = {r.lang: (r.point, r.low, r.high) for r in catalog.queries()["bootstrap_exact"](spark, SF).collect()}
    p = {r.lang: r.p for r in catalog.queries()["permutation_exact"](spark, SF).collect()}
    assert set(found) == set(rows["lang"])
    for lang, own in rows.groupby("lang"):
        e, n = own["edits"].to_numpy(float), own["len"].to_numpy(float)
        drawn = np.random.default_rng(42).integers(0, len(e), size=(resampling.DRAWS, len(e)))
        rates = 100 * e[drawn].sum(axis=1) / np.maximum(1, n[drawn].sum(axis=1))
        assert found[lang] == pytest.approx((100 * e.sum() / n.sum(), *np.percentile(rates, [2.5, 97.5])))
        signs = np.random.default_rng(42).integers(0, 2, size=(resampling.DRAWS, len(e))) * 2 - 1
        d = own["edits_a"].to_numpy() - own["edits_b"].to_numpy()
        assert p[lang] == ((signs * d).sum(axis=1) <= d.sum()).sum().__add__(1) / (resampling.DRAWS + 1)


def test_intervals_of_nothing():
    assert resampling.interval(np.zeros(0), np.zeros(0)) == (0.0, 0.0, 0.0)
    assert resampling.p_value(np.zeros(0), np.zeros(0)) == 1.0
