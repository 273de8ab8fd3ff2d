from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import normalize as N
from quillspark.functions import policies as P

# (policy, input, expected)
GOLDEN = [
    ("norm-1", "We won't — can't — pay Ann's ¾!", "we won't can't pay ann's 3 4"),
    ("norm-1", "Grüße, Maß", "grüsse mass"),
    ("norm-1", "?! … 」", ""),
    ("norm-1", "x\ty\nz", "xyz"),
    ("norm-1", "İzmit ‘yes’ o’clock", "izmit yes o'clock"),
    ("norm-1", "بَيْتـ", "بيت"),
    ("norm-1", "ന്‍", "ൻ"),
    ("whisper-basic", "Rain; sun? Ann's.", "rain sun ann s "),
    ("whisper-basic", "¡Olé! ¿Y tú?", " olé y tú "),
    ("whisper-basic", "x <y> [z] (q) w", "x w"),
    ("whisper-basic-nodiacritics", "Maß cœur ö", "mass coeur o"),
    ("whisper-marks", "won't 'say' it\nnow", "won't say it now"),
    ("cyrillic-yo", "Мёд, лёд", "мед лед"),
    ("turkic-tr", "Irmak İnci", "ırmak inci"),
    ("indic-vistaar", "घर, पानी।", "घर पानी"),
    ("arabic-ouaal", "إِلَى ٤٥ ـ", "الى 45"),
    ("perso-arabic", "كيف می‌خورم", "کیف می‌خورم"),
    ("uyghur-ug", "ىي", "ىی"),
    ("thai-cer", "ม​น", "ม น"),
    ("armenian-hy", "ո՞վ", "ով"),
]


@pytest.mark.parametrize(("policy", "text", "expected"), GOLDEN)
def test_golden(policy, text, expected):
    assert N.normalize_text(text, P.policy(policy)) == expected


def test_fixed_values():
    assert len(N.ZERO_WIDTH) == 8 and len(N.APOSTROPHES) == 6 and len(P.POLICIES) == 17
    assert all(len(k) == 3 for k in N.CHILLU)


@pytest.mark.parametrize("name", list(P.POLICIES))
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_lengths_and_idempotence(name, text):
    p = P.policy(name)
    once = N.normalize_text(text, p)
    if p.pipeline != "whisper" and "﷐" not in text and "﷑" not in text and p.script_map == "none" and p.case == "lower" and text.isascii() and not set("<[(") & set(text):
        assert N.normalize_text(once, p) == once
    assert N.normalize_batch([text, None, ""], p) == [once, "", ""]


def test_native_equals_general_on_ascii(spark):
    texts = [(k, "".join(chr(c) for c in range(32, 127)) + f" don't 'x {k}' a\tb (q) [z] <t> I.") for k in range(3)] + [(9, ""), (10, None), (11, "_'_ '' a'b'c 'd' x'")]
    rng = random.Random(5)
    signs = [chr(c) for c in range(128)] + list("'\'\'\'(((([[<<>>]]))))    IIii__\n\n\t")
    texts += [(20 + k, "".join(rng.choices(signs, k=rng.randint(1, 25)))) for k in range(1500)]
    texts += [(3000, "\u00c9 ascii no more (x)"), (3001, "\ufb01")]
    df = spark.createDataFrame(texts, "k int, t string").repartition(2)
    every = df.select("k", "t", *[N.normalized(F.col("t"), name).alias(name) for name in P.POLICIES]).collect()
    assert len(every) == len(texts)
    for name in P.POLICIES:
        p = P.policy(name)
        wrong = [(r.t, r[name], N.normalize_text(r.t, p)) for r in every if r[name] != N.normalize_text(r.t, p)]
        assert not wrong, (name, wrong[:3])


def test_tallies():
    _, tally = N.normalize_with_counts("A, b! it's $5 ​", P.policy("norm-1"))
    assert (tally["P"], tally["S"], tally["Cf"], tally["case_changed"]) == (2, 1, 1, 1)
    assert set(N.TALLIED) < set(tally)
    assert N.normalize_with_counts("", P.policy("norm-1"))[1]["P"] == 0


def test_counts_column(spark):
    got = spark.createDataFrame([("A, b.",), (None,)], "t string").select(N.normalized_with_counts(F.col("t"), "norm-1").alias("n")).collect()
    assert [r.n.text for r in got] == ["a b", ""] and got[0].n.counts.P == 2


def test_digests():
    rules = P.policy("whisper-basic").rules()
    assert set(rules) == set(P.READS["whisper"]) and len(P.policy("whisper-basic").digest()) == 12
    assert json.dumps(rules, sort_keys=True).startswith('{"case": "lower"')
    assert len({p.digest() for p in P.PRESETS}) == len(P.PRESETS)
    with pytest.raises(ValueError, match="has no rule"):
        P.Policy(pipeline="whisper", version="x", zero_width="space")


def test_languages():
    assert P.policy_for("tr").version == "turkic-tr" and P.policy_for("hi").version == "indic-vistaar" and P.policy_for("en").version == "whisper-basic"
    assert P.policy_for("tr", "norm-1").version == "norm-1"
    with pytest.warns(UserWarning):
        assert P.policy_for("xx").version == P.DEFAULT
    with pytest.raises(KeyError):
        P.policy("nope")
