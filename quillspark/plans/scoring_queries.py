"""Scoring: error rates, seeds, macro-averages, comparisons, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalized
from ..operators import comparing, resampling, scoring, seeds
from ..shipping import ship
from .registry import basic_sql, query, r9, table

#: Letters of the tables beyond ASCII, and single bytes that normalized text doesn't hold: DuckDB's distance counts bytes.
LETTERS, BYTES = "éóèñüçäöêßíàâîôûœæáúìùëïłøåõãý", "ABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a reference, the next one as its hypothesis, both under the default policy."""
    ship(spark)
    turns = table(spark, sf_dir, "conversations").withColumn("normal", normalized(F.col("text"), "whisper-basic"))
    own = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", F.col("role").alias("lang"), F.col("normal").alias("ref"), F.lead("normal").over(own).alias("hyp"))
    return pairs.where("hyp is not null")


TURNS_SQL = f"""
turns AS (SELECT conv_id, turn, role, {basic_sql("coalesce(text, '')")} AS normal, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL OR lead(conv_id) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS has_next FROM conversations),
pairs AS (SELECT conv_id, turn, role AS lang, normal AS ref, lead(normal) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM turns QUALIFY hyp IS NOT NULL)
"""


@query(f"""WITH {TURNS_SQL}, scored AS (SELECT *, levenshtein(translate(ref, '{LETTERS}', '{BYTES}'), translate(hyp, '{LETTERS}', '{BYTES}')) AS e FROM pairs WHERE trim(ref) <> '')
SELECT lang, count(*) AS n, round(100.0 * sum(e) / greatest(1.0, sum(length(ref))), 9) AS cer FROM scored GROUP BY lang""")
def cer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate by role: normalization, filter of blank references, edit distance, ratio of sums."""
    scored = scoring.scoreable(turn_pairs(spark, sf_dir)).select("lang", scoring.char_edits(F.col("ref"), F.col("hyp")).alias("e"), F.length("ref").alias("l"))
    return scored.groupBy("lang").agg(F.count("*").alias("n"), r9(scoring.rate(F.col("e"), F.col("l"))).alias("cer"))


@query()
def wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate by role (DuckDB's byte distance can't count words; tests hold it against a brute-force version)."""
    counted = scoring.edit_counts(scoring.scoreable(turn_pairs(spark, sf_dir)))
    return scoring.error_rates(counted, ["lang"]).select("lang", "n", r9("wer").alias("wer"))


@query("""WITH p AS (SELECT p_brand, string_split(p_name, ' ') AS r, p_name AS ref, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS hyp FROM part),
q AS (SELECT *, string_split(hyp, ' ') AS h FROM p WHERE hyp IS NOT NULL),
k AS (SELECT *, list_distinct(list_concat(r, h)) AS d FROM q),
e AS (SELECT p_brand, len(r) AS wl, length(ref) AS cl, levenshtein(ref, hyp) AS ce, levenshtein(array_to_string(list_transform(r, lambda t: chr(CAST(33 + list_position(d, t) AS INTEGER))), ''), array_to_string(list_transform(h, lambda t: chr(CAST(33 + list_position(d, t) AS INTEGER))), '')) AS we FROM k)
SELECT p_brand AS brand, count(*) AS n, round(100.0 * sum(we) / greatest(1.0, sum(wl)), 9) AS wer, round(100.0 * sum(ce) / greatest(1.0, sum(cl)), 9) AS cer FROM e GROUP BY p_brand""")
def error_rates_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and character error rates of successive part names."""
    ship(spark)
    own = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("ref"), F.lead("p_name").over(own).alias("hyp")).where("hyp is not null")
    rates = scoring.error_rates(scoring.edit_counts(pairs), ["brand"])
    return rates.select("brand", "n", r9("wer").alias("wer"), r9("cer").alias("cer"))


@query(f"""WITH n AS (SELECT role, trim({basic_sql("coalesce(text, '')")}) = '' AS blank FROM conversations)
SELECT role AS lang, count(*) FILTER (WHERE NOT blank) AS n_scored, count(*) FILTER (WHERE blank) AS n_empty_refs, count(*) FILTER (WHERE NOT blank) = 0 AS refused FROM n GROUP BY role""")
def scored_vs_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    refs = table(spark, sf_dir, "conversations").select(F.col("role").alias("lang"), normalized(F.col("text"), "whisper-basic").alias("ref"))
    return scoring.scoreable_counts(refs, ["lang"])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as results: section = return flag, lang = status and tax, seed = line number."""
    return results_of(table(spark, sf_dir, "lineitem"))


def results_of(lines: DataFrame) -> DataFrame:
    lang = F.concat("l_linestatus", (F.round(F.col("l_tax") * 100)).cast("int").cast("string"))
    keyed = lines.select(F.col("l_returnflag").alias("section"), lang.alias("lang"), F.col("l_linenumber").alias("seed"), (F.col("l_linestatus") == "O").alias("word_boundary"), "l_discount", "l_quantity")
    return keyed.groupBy("section", "lang", "seed", "word_boundary").agg((100 * F.avg("l_discount")).alias("wer"), F.avg("l_quantity").alias("cer"))


RESULTS_SQL = """
results AS (SELECT l_returnflag AS section, l_linestatus || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS lang, l_linenumber AS seed, l_linestatus = 'O' AS word_boundary,
  100 * avg(l_discount) AS wer, avg(l_quantity) AS cer FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {RESULTS_SQL}
SELECT section, lang, CASE WHEN arg_min(word_boundary, seed) THEN 'wer' ELSE 'cer' END AS kind, round(avg(wer), 9) AS wer_mean, round(stddev_samp(wer), 9) AS wer_std, count(wer) AS wer_n,
  round(avg(cer), 9) AS cer_mean, round(stddev_samp(cer), 9) AS cer_std, count(cer) AS cer_n FROM results GROUP BY section, lang""")
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seeds.by_language(results(spark, sf_dir))
    return out.select("section", "lang", "kind", *[x for m in ("wer", "cer") for x in (r9(f"{m}_mean").alias(f"{m}_mean"), r9(f"{m}_std").alias(f"{m}_std"), F.col(f"{m}_n"))])


@query(f"""WITH {RESULTS_SQL}, p AS (SELECT *, CASE WHEN seed = 1 THEN NULL WHEN seed % 2 = 0 THEN 'whisper-basic' ELSE 'norm-' || seed END AS policy FROM results)
SELECT section, lang, count(*) AS n, arg_min(policy, seed) FILTER (WHERE policy IS NOT NULL) AS policy FROM p GROUP BY section, lang""")
def seed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of a language is that of the first seed that names one."""
    named = F.when(F.col("seed") == 1, None).when(F.col("seed") % 2 == 0, "whisper-basic").otherwise(F.concat(F.lit("norm-"), F.col("seed").cast("string")))
    out = seeds.by_language(results(spark, sf_dir).withColumn("policy", named), carried=("policy",))
    return out.select("section", "lang", F.col("wer_n").alias("n"), "policy")


def _macro_sql(kept: str) -> str:
    return f"""WITH {RESULTS_SQL},
v AS (SELECT section, lang, seed, CASE WHEN word_boundary THEN 'wer' ELSE 'cer' END AS kind, CASE WHEN word_boundary THEN wer ELSE cer END AS value FROM results WHERE {kept}),
s AS (SELECT section, count(DISTINCT seed) AS n FROM v GROUP BY section),
l AS (SELECT v.section, lang, any_value(kind) AS kind, avg(value) AS m, count(DISTINCT seed) = any_value(n) AS complete FROM v JOIN s USING (section) GROUP BY v.section, lang),
p AS (SELECT v.section, seed, avg(value) AS macro FROM v JOIN l USING (section, lang) WHERE complete GROUP BY v.section, seed),
a AS (SELECT section, avg(macro) AS mean, stddev_samp(macro) AS std FROM p GROUP BY section),
c AS (SELECT section, count(*) FILTER (WHERE complete) AS n_languages, count(*) FILTER (WHERE complete AND kind = 'wer') AS w, count(*) FILTER (WHERE complete AND kind = 'cer') AS c,
  stddev_samp(m) FILTER (WHERE complete) AS spread, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (WHERE NOT complete), '') AS excluded FROM l GROUP BY section)
SELECT section, n_languages, round(mean, 9) AS mean, round(std, 9) AS std, round(spread, 9) AS spread, excluded,
  CASE WHEN w > 0 AND c > 0 THEN 'mixed (WER×' || w || ', CER×' || c || ')' WHEN w > 0 THEN 'WER' WHEN c > 0 THEN 'CER' ELSE '—' END AS label FROM c LEFT JOIN a USING (section)"""


def _macro(values: DataFrame) -> DataFrame:
    out = seeds.macro(values)
    return out.select("section", "n_languages", r9("mean").alias("mean"), r9("std").alias("std"), r9("spread_across_languages").alias("spread"), F.array_join("excluded", ",").alias("excluded"), "label")


@query(_macro_sql("true"))
def macro_per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _macro(seeds.primary_values(results(spark, sf_dir)))


@query(_macro_sql("NOT (seed = 3 AND lang IN ('O1', 'F2'))"))
def macro_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages lack a seed: they are named and left out."""
    return _macro(seeds.primary_values(results(spark, sf_dir)).where("not (seed = 3 and lang in ('O1', 'F2'))"))


@query(f"WITH {RESULTS_SQL} SELECT section, lang, seed, round(CASE WHEN word_boundary THEN wer ELSE cer END, 9) AS value, CASE WHEN word_boundary THEN 'wer' ELSE 'cer' END AS kind FROM results")
def primary_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.primary_values(results(spark, sf_dir)).select("section", "lang", "seed", r9("value").alias("value"), "kind")


@query(f"""WITH {RESULTS_SQL} SELECT a.lang, a.seed, round(a.wer - b.wer, 9) AS delta_wer, round(a.cer - b.cer, 9) AS delta_cer
FROM results a JOIN results b ON a.lang = b.lang AND a.seed = b.seed WHERE a.section = 'A' AND b.section = 'R'""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    arm = lambda x: results_of(lines.where(F.col("l_returnflag") == x))
    both = comparing.paired_runs(arm("A"), arm("R"), ["lang", "seed"], ["wer", "cer"])
    return both.select("lang", "seed", r9(F.col("wer_a") - F.col("wer_b")).alias("delta_wer"), r9(F.col("cer_a") - F.col("cer_b")).alias("delta_cer"))


@query("""WITH a AS (SELECT DISTINCT lang, CASE WHEN lang IN ('de', 'es') THEN 'latin-marks' ELSE 'whisper-basic' END AS policy FROM documents), b AS (SELECT DISTINCT lang, 'whisper-basic' AS policy FROM documents)
SELECT lang, a.policy AS policy_a, b.policy AS policy_b FROM a JOIN b USING (lang) WHERE a.policy <> b.policy""")
def policy_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    a = langs.withColumn("policy", F.when(F.col("lang").isin("de", "es"), "latin-marks").otherwise("whisper-basic"))
    return comparing.policy_mismatches(a, langs.withColumn("policy", F.lit("whisper-basic")))


@query("""WITH p AS (SELECT source AS section, lang, CASE WHEN lang IN ('de', 'es') THEN 'latin-marks' ELSE 'whisper-basic' END AS policy FROM documents), u AS (SELECT section, list_sort(list_distinct(list(policy))) AS u FROM p GROUP BY section)
SELECT section, CASE WHEN len(u) > 1 THEN 'policies differ by language (' || array_to_string(u, ', ') || ')' ELSE '' END AS caption FROM u""")
def macro_policy_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = table(spark, sf_dir, "documents").select(F.col("source").alias("section"), "lang", F.when(F.col("lang").isin("de", "es"), "latin-marks").otherwise("whisper-basic").alias("policy"))
    return seeds.policy_caption(policies.distinct())


@query("SELECT event_type, round(sum(value * (1 + user_id % 7)) / greatest(1.0, sum(1 + user_id % 7)), 9) AS mean_loss FROM events GROUP BY event_type")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("loss"), (1 + F.col("user_id") % 7).alias("n"))
    return seeds.weighted_mean_loss(losses, ["event_type"]).select("event_type", r9("mean_loss").alias("mean_loss"))


def edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as utterances of a segment: edits and lengths from their numbers."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("lang"), F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 5).alias("edits"), (5 + F.col("c_custkey") % 11).alias("len"), (F.col("c_custkey") % 5).alias("edits_a"), ((F.col("c_custkey") * 7) % 6).alias("edits_b"))


_NUMBERED_SQL = "rows AS MATERIALIZED (SELECT c_mktsegment AS lang, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS m, c_custkey % 5 AS edits, 5 + c_custkey % 11 AS len, (c_custkey * 7) % 6 AS edits_b FROM customer)"


def _draws_sql() -> str:
    """Steps of the draws, one after the other, so that each is computed once."""
    p, w, (a, b) = resampling.PRIME, resampling.WEIGHTS, resampling.SHIFTS
    fifth = lambda x: f"((({x} * {x} % {p}) * ({x} * {x} % {p}) % {p}) * {x}) % {p}"
    return f"""x AS MATERIALIZED (SELECT lang, draw, k, m, edits, edits_b, ((draw * {w[0]} + k * {w[1]} + {resampling.SEED * w[2]}) % {p} + {a}) % {p} AS y FROM rows, range({resampling.DRAWS}) d(draw)),
z AS MATERIALIZED (SELECT * EXCLUDE y, ({fifth("y")} + {b}) % {p} AS y FROM x), h AS (SELECT * EXCLUDE y, {fifth("y")} AS h FROM z)"""


@query(f"""WITH {_NUMBERED_SQL}, {_draws_sql()}, t AS (SELECT lang, draw, h % m AS k FROM h),
r AS (SELECT t.lang, draw, 100.0 * sum(edits) / greatest(1.0, sum(len)) AS rate FROM t JOIN rows USING (lang, k) GROUP BY t.lang, draw),
p AS (SELECT lang, 100.0 * sum(edits) / greatest(1.0, sum(len)) AS point FROM rows GROUP BY lang)
SELECT lang, round(point, 9) AS point, round(quantile_cont(CAST(rate AS DOUBLE), 0.025), 9) AS low, round(quantile_cont(CAST(rate AS DOUBLE), 0.975), 9) AS high FROM r JOIN p USING (lang) GROUP BY lang, point""")
def bootstrap_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = resampling.intervals_native(edit_rows(spark, sf_dir), ["lang"], "pos")
    return out.select("lang", *[r9(c).alias(c) for c in ("point", "low", "high")])


@query(f"""WITH base AS (SELECT c_mktsegment AS lang, c_custkey, 'seed' || c_custkey % 2 AS run FROM customer), long AS (SELECT run, lang, 'wer' AS metric, c_custkey, c_custkey % 5 AS edits, 5 + c_custkey % 11 AS len FROM base UNION ALL SELECT run, lang, 'cer', c_custkey, c_custkey % 9, 20 + c_custkey % 13 FROM base),
rows AS MATERIALIZED (SELECT run || '/' || lang || '/' || metric AS lang, row_number() OVER (PARTITION BY run, lang, metric ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY run, lang, metric) AS m, edits, len, edits AS edits_b FROM long), {_draws_sql()}, t AS (SELECT lang, draw, h % m AS k FROM h),
r AS (SELECT t.lang, draw, 100.0 * sum(edits) / greatest(1.0, sum(len)) AS rate FROM t JOIN rows USING (lang, k) GROUP BY t.lang, draw),
p AS (SELECT lang, 100.0 * sum(edits) / greatest(1.0, sum(len)) AS point FROM rows GROUP BY lang)
SELECT split_part(lang, '/', 1) AS run, split_part(lang, '/', 2) AS lang, split_part(lang, '/', 3) AS metric, round(point, 9) AS point, round(quantile_cont(CAST(rate AS DOUBLE), 0.025), 9) AS low, round(quantile_cont(CAST(rate AS DOUBLE), 0.975), 9) AS high FROM r JOIN p USING (lang) GROUP BY lang, point""")
def intervals_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each run, language and metric, as the command line's analysis gives them."""
    ship(spark)
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("seed"), (key % 2).cast("string")).alias("run"), F.col("c_mktsegment").alias("lang"), key.alias("pos"), (key % 5).alias("word_edits"), (5 + key % 11).alias("word_len"), (key % 9).alias("char_edits"), (20 + key % 13).alias("char_len"))
    by = ["run", "lang", "metric"]
    out = resampling.intervals_native(scoring.long_form(c, ["run", "lang", "pos"]), by, "pos")
    return out.select(*by, *[r9(x).alias(x) for x in ("point", "low", "high")])


@query()
def bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy's generator can't be had in SQL; tests hold it against the same draws on the driver."""
    ship(spark)
    return resampling.intervals_exact(edit_rows(spark, sf_dir), ["lang"], "pos")


@query(f"""WITH {_NUMBERED_SQL}, {_draws_sql()}, o AS (SELECT lang, sum(edits - edits_b) AS o FROM rows GROUP BY lang),
s AS (SELECT lang, draw, sum(CASE WHEN h % 2 = 0 THEN edits - edits_b ELSE edits_b - edits END) AS s FROM h GROUP BY lang, draw)
SELECT lang, round((count(*) FILTER (WHERE s <= o) + 1) / {resampling.DRAWS + 1}.0, 9) AS p FROM s JOIN o USING (lang) GROUP BY lang""")
def permutation_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resampling.permutation_native(edit_rows(spark, sf_dir), ["lang"], "pos").select("lang", r9("p").alias("p"))


@query()
def permutation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return resampling.permutation_exact(edit_rows(spark, sf_dir), ["lang"], "pos")


@query("""WITH a AS (SELECT conv_id, turn, role AS ref FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'x' ELSE role END AS ref FROM conversations)
SELECT conv_id, min(turn) AS turn FROM a FULL JOIN b USING (conv_id, turn) WHERE a.ref IS DISTINCT FROM b.ref GROUP BY conv_id""")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two lists of references part, by conversation."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("ref"))
    b = a.withColumn("ref", F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), "x").otherwise(F.col("ref")))
    return comparing.first_differences(a, b, ["conv_id"], "turn")
