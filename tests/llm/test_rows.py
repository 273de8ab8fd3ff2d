"""Quality rules, mixing, sharding, extraction."""

from __future__ import annotations

import html
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, pages, quality, sharding
from quillspark.llm.runtime import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, `rate` double, kept boolean"
LONG = " ".join(f"word{k}" for k in range(80))
ROWS = [
    (1, LONG, "en", "a", 1, 1, 1, 1.0, True),
    (2, None, "en", "b", None, 1, 1, 1.0, True),
    (3, "", None, "a", 0, 1, 1, 1.0, True),
    (4, "x y " * 60, "en", None, 1, 1, 1, 1.0, True),
    (5, LONG.replace(" ", " *** "), "en", "a", 1, 1, 1, 1.0, True),
    (6, "\n".join(["the very same line of text"] * 8) + "\n" + LONG, "en", "c", 1, 1, 1, 1.0, True),
    (7, "é ü\x1fß " * 3 + LONG, "fr", "b", 1, 1, 1, 1.0, True),
    (7, "é ü\x1fß " * 3 + LONG, "fr", "b", 1, 1, 1, 1.0, True),
    (None, LONG + "\t\x0b" + LONG, "en", "d", 1, 1, 1, 1.0, True),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def duck(docs):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    return c


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def facts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_quality(docs):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    for i, text, *_ in ROWS:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == facts(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [by[i].kept for i in (1, 2, 3, 4, 5, 7)] == [True, False, False, False, False, True]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in ROWS if by[i].kept)


def test_order_of_rules_changes_nothing(docs):
    both = [sorted((r.doc_id or 0, r.kept) for r in quality.judge(docs, rules=rules).collect()) for rules in (quality.RULES, quality.RULES[::-1])]
    assert both[0] == both[1]
    assert set(quality.order_rules(docs, quality.RULES)) == set(quality.RULES)
    empty = docs.limit(0)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def shares(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    capped, left = set(), float(sum(sizes.values()))
    while left > 1e-9 and len(capped) < len(order):
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += give[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                capped.add(s)
    return target


def test_mixing(spark, docs):
    got = mixing.plan(docs, Scratch(spark, "t")).collect()
    sizes = Counter()
    for _, text, _, source, *_ in ROWS:
        sizes[source] += len(words(text or ""))
    want = shares(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    taken = {r.source: (r.taken, r.target) for r in mixing.plan(many, Scratch(spark, "t")).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(a - b) < 0.15 * b for a, b in taken.values())
    assert sorted(map(tuple, mixing.plan(many, Scratch(spark, "t")).select("doc_id", "copies").collect())) == sorted(map(tuple, mixing.plan(many, Scratch(spark, "t")).select("doc_id", "copies").collect()))
    mixed = mixing.mix(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    expected = Counter()
    for r in got:
        expected[r.doc_id] += r.copies
    assert counts == +expected
    assert mixing.mix(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize(("module", "name"), [(quality, "judge"), (mixing, "plan")])
def test_sql(spark, docs, duck, module, name):
    got = module.plan(docs, Scratch(spark, "t")) if name == "plan" else None
    if name == "plan":
        got = got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    keyed = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if name == "judge" else docs
    if name == "judge":
        got = module.judge(keyed)
        duck.register("documents", keyed.toArrow())
    found = duck.sql(module.SQL)
    columns, want = found.columns, found.fetchall()
    flat = lambda rows: [-1.0 if x is None else float(x) for r in sorted(rows, key=repr) for x in r]
    own = [tuple(r) for r in got.select(*columns).collect()]
    assert len(own) == len(want) and flat(own) == pytest.approx(flat(want))
    duck.register("documents", docs.toArrow())


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs):
    import numpy as np

    keys = np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert sharding.jump(keys, 17).tolist() == [plain_jump(int(k), 17) for k in keys]
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, None).otherwise("té" ).alias("text"))
    rows = rows.unionByName(rows.limit(50)).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    placed = sharding.assign(rows, "doc_id", 40, grown="grown")
    got = sharding.number(placed, Scratch(spark, "t"), "shard", ["doc_id"]).collect()
    assert len(got) == 3051 and all(r.grown in (r.shard, 40) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(40))
    assert len({(r.doc_id, r.shard) for r in got}) == 3001
    assert sharding.assign(docs.withColumn("shard", F.lit("x")), "doc_id", 4).schema["shard"].dataType.simpleString() == "int"
    assert sharding.number(sharding.assign(rows.limit(0), "doc_id", 4), Scratch(spark, "t"), "shard", ["doc_id"]).count() == 0
    assert rows.where("text is not null").select(F.crc32(F.col("text").cast("binary")).alias("c")).first().c == zlib.crc32("té".encode())


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div>{main}<footer>&copy; foot</footer></body></html>'


def test_extraction():
    article = "<article><h1>Head &amp; more</h1><p><b>First   part.<br><p>Second <i>one</i>&lt;x&gt;</p><aside>no</aside><form>no</form><!-- no --><script>var t='</p>';</script><p>Third</p></article>"
    assert pages.main_text(PAGE.format(main=article), frozenset()) == "Head & more\n\nFirst part.\n\nSecond one<x>\n\nThird"
    assert pages.main_text(PAGE.format(main=article).partition("</p></article>")[0], frozenset()) == "Head & more\n\nFirst part.\n\nSecond one<x>\n\nThird"
    assert pages.main_text(PAGE.format(main="<main><p>Body</p><div class='reader-comments'><p>no</p></div><section id=cookie-notice>no</section></main>"), frozenset()) == "Body"
    assert pages.main_text("", frozenset()) == "" and pages.main_text("just text", frozenset()) == "just text"
    assert pages.main_text("<p>a<p>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table>", frozenset()) == "\n\n".join("abcdef")


def test_templates(spark):
    plain = "<html><body><div class='top'>Our site</div><div class='box'><p>{}</p></div><div class='low'>Write to us</div></body></html>"
    rows = [(k, f"http://h.example/{k}", plain.format(f"story number {k}")) for k in range(6)] + [(10, None, None), (11, "http://one.example/", plain.format("alone")), (12, "x", ""), (12, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash")).withColumn("template", F.lit("clash"))
    got = {r.page_id: r for r in pages.extract(df, Scratch(spark, "t")).collect()}
    assert [got[k].text for k in range(6)] == [f"story number {k}" for k in range(6)]
    assert got[10].text == "" and got[11].text == "Our site\n\nalone\n\nWrite to us" and got[12].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pages.extract(df.limit(0), Scratch(spark, "t")).count() == 0
    assert html.unescape("&amp;") == "&"
