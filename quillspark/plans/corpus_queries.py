"""Corpora: leak guard, durations, splits, selection, merging, frames, joins, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpora, durations, frames, leakguard, merging, selection, splits
from ..shipping import ship
from .registry import query, r9, table

_EVAL_SQL = "e AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS VARCHAR) AS client_id FROM orders WHERE o_orderkey % 50 IN (0, 1))"
_MARKED_SQL = f"""{_EVAL_SQL}, marked AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS VARCHAR) AS client_id, o_totalprice AS seconds, o_orderstatus,
  CASE WHEN CAST(o_orderkey AS VARCHAR) IN (SELECT path FROM e) THEN 'in_eval_splits' WHEN CAST(o_custkey AS VARCHAR) IN (SELECT client_id FROM e) THEN 'eval_speaker_clips' ELSE 'kept' END AS disposition FROM orders)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").cast("string").alias("client_id"), F.col("o_totalprice").alias("seconds"), "o_orderstatus", "o_orderkey")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir)
    return leakguard.dispositions(rows, rows.where(F.col("o_orderkey") % 50 < 2))


@query(f"WITH {_MARKED_SQL} SELECT path, disposition FROM marked")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("path", "disposition")


@query(f"""WITH {_MARKED_SQL} SELECT o_orderstatus, count(*) AS n_validated, count(*) FILTER (WHERE disposition = 'kept') AS n_kept, count(*) FILTER (WHERE disposition = 'in_eval_splits') AS n_in_eval_splits,
count(*) FILTER (WHERE disposition = 'eval_speaker_clips') AS n_eval_speaker_clips, count(DISTINCT client_id) FILTER (WHERE disposition = 'eval_speaker_clips') AS n_leaked_speakers,
round(coalesce(sum(seconds) FILTER (WHERE disposition = 'kept'), 0), 4) AS seconds_kept, round(coalesce(sum(seconds) FILTER (WHERE disposition = 'eval_speaker_clips'), 0), 4) AS seconds_removed_by_guard FROM marked GROUP BY o_orderstatus""")
def leak_guard_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leakguard.accounting(marked(spark, sf_dir), ["o_orderstatus"], seconds="seconds")
    return out.withColumns({c: F.round(c, 4) for c in ("seconds_kept", "seconds_removed_by_guard")})


@query(f"WITH {_MARKED_SQL} SELECT path FROM marked WHERE CAST(path AS BIGINT) % 50 > 1 AND disposition <> 'kept'")
def train_superset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official training rows that the guarded selection lacks: those whose speaker is in the evaluation too."""
    rows = clips(spark, sf_dir)
    kept = leakguard.dispositions(rows, rows.where(F.col("o_orderkey") % 50 < 2)).where("disposition = 'kept'")
    return leakguard.not_covered(rows.where(F.col("o_orderkey") % 50 > 1).select("path"), kept)


def _durations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), F.col("o_orderpriority").alias("lang"), F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "P", "validation").otherwise("train").alias("split"))
    known = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 <> 3").groupBy(F.col("l_orderkey").alias("clip")).agg(F.sum("l_quantity").alias("seconds"))
    return rows, known


_DURATION_SQL = """k AS (SELECT l_orderkey AS clip, sum(l_quantity) AS seconds FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS clip, o_orderpriority AS lang, CASE o_orderstatus WHEN 'F' THEN 'test' WHEN 'P' THEN 'validation' ELSE 'train' END AS split FROM orders),
d AS (SELECT lang, split, count(*) AS n_utts, coalesce(sum(seconds), 0.0) AS seconds, count(*) FILTER (WHERE seconds IS NULL) AS n_missing FROM r LEFT JOIN k USING (clip) GROUP BY lang, split)"""


@query(f"WITH {_DURATION_SQL} SELECT lang, split, n_utts, CAST(seconds AS DOUBLE) AS seconds, n_missing FROM d")
def durations_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durations.split_durations(*_durations(spark, sf_dir), ["lang", "split"], "clip")


@query(f"WITH {_DURATION_SQL}, h AS (SELECT lang, sum(seconds) / 3600.0 AS total_hours, sum(CASE WHEN split = 'train' THEN seconds ELSE 0.0 END) / 3600.0 AS train_hours FROM d GROUP BY lang) SELECT lang, round(total_hours, 9) AS total_hours, round(train_hours, 9) AS train_hours, train_hours < 10.5 AS below_threshold FROM h")
def below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = durations.split_durations(*_durations(spark, sf_dir), ["lang", "split"], "clip")
    out = durations.hours(parts, ["lang"])
    return out.select("lang", r9("total_hours").alias("total_hours"), r9("train_hours").alias("train_hours"), durations.below(F.col("train_hours"), 10.5).alias("below_threshold"))


def _split_sql(groups: str) -> str:
    """Groups (lang, k, n) in, parts (lang, k, split) out. Empty parts get the least groups of the fullest part, where there
    are three groups: if two are empty, all groups are in one; if one is, the fullest has two at least."""
    short = lambda a, b: f"({a} * total - {b})"
    t, v, s = short("0.8::DOUBLE", "a"), short("0.1::DOUBLE", "b"), short("0.1::DOUBLE", "c")
    best = f"CASE WHEN {t} >= {v} AND {t} >= {s} THEN 1 WHEN {v} >= {s} THEN 2 ELSE 3 END"
    return f"""g AS ({groups}), o AS (SELECT lang, k, n, row_number() OVER (PARTITION BY lang ORDER BY sha1(k)) AS i, sum(n) OVER (PARTITION BY lang) AS total FROM g),
f AS (SELECT lang, 0::BIGINT AS i, NULL::VARCHAR AS k, 0::BIGINT AS n, 0 AS part, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM (SELECT DISTINCT lang FROM o)
  UNION ALL SELECT lang, i, k, n, best, (a + CASE WHEN best = 1 THEN n ELSE 0 END)::BIGINT, (b + CASE WHEN best = 2 THEN n ELSE 0 END)::BIGINT, (c + CASE WHEN best = 3 THEN n ELSE 0 END)::BIGINT
  FROM (SELECT f.lang, o.i, o.k, o.n, a, b, c, {best} AS best FROM f JOIN o ON o.lang = f.lang AND o.i = f.i + 1)),
held AS (SELECT lang, [count(*) FILTER (WHERE part = 1), count(*) FILTER (WHERE part = 2), count(*) FILTER (WHERE part = 3)] AS cs FROM f WHERE i > 0 GROUP BY lang),
gaps AS (SELECT lang, list_position(cs, list_max(cs)) AS donor, CASE WHEN list_sum(cs) >= 3 THEN list_filter([1, 2, 3], lambda x: cs[x] = 0) ELSE [] END AS empty FROM held),
placed AS (SELECT f.lang, k, part, empty, part = donor AND row_number() OVER (PARTITION BY f.lang, part ORDER BY n, k) <= len(empty) AS moved, row_number() OVER (PARTITION BY f.lang, part ORDER BY n, k) AS place FROM f JOIN gaps USING (lang) WHERE i > 0),
parts AS (SELECT lang, k, moved, ['train', 'validation', 'test'][CASE WHEN moved THEN empty[place] ELSE part END] AS split FROM placed)"""


_SPEAKERS_SQL = _split_sql("SELECT lang, source AS k, count(*) AS n FROM documents GROUP BY lang, source")
_UTTERANCES_SQL = _split_sql("SELECT lang, CAST(doc_id AS VARCHAR) AS k, 1 AS n FROM documents")


def speaker_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return splits.derive(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], F.col("source"), F.col("doc_id"))


@query(f"WITH RECURSIVE {_SPEAKERS_SQL} SELECT lang, source AS speaker, any_value(split) AS split, count(*) AS n FROM documents JOIN parts USING (lang) WHERE k = source GROUP BY lang, source")
def speaker_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker-disjoint parts: documents by source within their language."""
    return speaker_parts(spark, sf_dir).groupBy("lang", F.col("source").alias("speaker")).agg(F.first("split").alias("split"), F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_UTTERANCES_SQL} SELECT lang, CAST(k AS BIGINT) AS doc_id, split, 'utterance' AS split_policy FROM parts")
def utterance_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without speakers, every row is a group."""
    ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.derive(rows, ["lang"], F.lit(None).cast("string"), F.col("doc_id")).select("lang", "doc_id", "split", "split_policy")


@query(f"WITH RECURSIVE {_SPEAKERS_SQL} SELECT lang, sha1(coalesce(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) FILTER (WHERE split = 'test'), '')) AS test_sha1 FROM documents JOIN parts USING (lang) WHERE k = source GROUP BY lang")
def test_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.test_digests(speaker_parts(spark, sf_dir), ["lang"], "doc_id")


@query(f"""WITH RECURSIVE {_SPEAKERS_SQL}, s AS (SELECT lang, split, count(DISTINCT k) AS n_speakers FROM parts GROUP BY lang, split)
SELECT lang, split, n_speakers, (SELECT count(DISTINCT source) FROM documents d WHERE d.lang = s.lang) AS n_all, 0::BIGINT AS shared FROM s""")
def speaker_disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of each part beside those of the whole language; of a language's, how many stand in two parts: none."""
    rows = speaker_parts(spark, sf_dir)
    twice = rows.groupBy("lang", "source").agg(F.count_distinct("split").alias("parts")).groupBy("lang").agg(F.count_if(F.col("parts") > 1).alias("shared"), F.count("*").alias("n_all"))
    return rows.groupBy("lang", "split").agg(F.count_distinct("source").alias("n_speakers")).join(twice, "lang")


_FEW_SQL = _split_sql("SELECT CAST(o_custkey AS VARCHAR) AS lang, CAST(o_orderkey AS VARCHAR) AS k, 1 AS n FROM orders")


@query(f"WITH RECURSIVE {_FEW_SQL} SELECT CAST(lang AS BIGINT) AS custkey, CAST(k AS BIGINT) AS orderkey, split FROM parts")
def filled_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer, one to some dozens: in scopes of three to six rows validation and test get rows from train,
    in those of one or two nothing is moved."""
    ship(spark)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return splits.derive(rows, ["o_custkey"], F.lit(None).cast("string"), F.col("o_orderkey")).select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "split")


_SPOKEN_SQL = """spoken AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS lang, o_orderkey, (o_custkey % 20) || CASE WHEN o_orderkey % 31 < 26 THEN '-most' WHEN o_orderkey % 31 < 29 THEN '-some' ELSE '-few' END AS speaker FROM orders),
keyed AS (SELECT lang, o_orderkey, CASE WHEN (SELECT count(DISTINCT speaker) FROM spoken b WHERE b.lang = a.lang) >= 3 THEN speaker ELSE CAST(o_orderkey AS VARCHAR) END AS k FROM spoken a)"""
_DOMINANT_SQL = f"{_SPOKEN_SQL}, {_split_sql('SELECT lang, k, count(*) AS n FROM keyed GROUP BY lang, k')}"


@query(f"WITH RECURSIVE {_DOMINANT_SQL} SELECT lang, o_orderkey AS orderkey, split, CASE WHEN k LIKE '%-%' THEN 'speaker' ELSE 'utterance' END AS split_policy FROM keyed JOIN parts USING (lang, k)")
def filled_speaker_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three speakers a scope, one of whom has most rows: where the shares alone leave a part empty, it gets the least."""
    ship(spark)
    lang = (F.col("o_custkey") % 20).cast("string")
    speaker = F.concat(lang, F.when(F.col("o_orderkey") % 31 < 26, "-most").when(F.col("o_orderkey") % 31 < 29, "-some").otherwise("-few"))
    rows = table(spark, sf_dir, "orders").select(lang.alias("lang"), F.col("o_orderkey").alias("orderkey"), speaker.alias("speaker"))
    return splits.derive(rows, ["lang"], F.col("speaker"), F.col("orderkey")).select("lang", "orderkey", "split", "split_policy")


_RULE = selection.Thresholds(30.0, 2.0, 2.0)
_HELD = {"3-c": "reserved"}
_CARRIED = {"5-a": "kept for its family"}
_COMMITTED = ("7-b",)


def locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as locales of their nations, balances as hours."""
    c = table(spark, sf_dir, "customer")
    locale = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.substring("c_mktsegment", 1, 1), F.col("c_custkey").cast("string"))
    hours = F.abs("c_acctbal") / 100.0
    return c.select(locale.alias("locale"), F.lit("commonvoice").alias("source"), F.lit("").alias("corpus"), hours.alias("trainable_hours"), (hours / 20.0).alias("dev_hours"), (hours / 15.0).alias("test_hours"))


@query("""WITH h AS (SELECT c_nationkey || '-' || substr(c_mktsegment, 1, 1) || c_custkey AS locale, CAST(c_nationkey AS VARCHAR) AS base, abs(c_acctbal) / 100.0 AS t FROM customer),
p AS (SELECT *, t >= 30.0 AND t / 20.0 >= 2.0 AND t / 15.0 >= 2.0 AS ok FROM h), w AS (SELECT base, arg_max(locale, struct_pack(a := t, b := locale)) FILTER (WHERE ok) AS any_winner, max(t) FILTER (WHERE ok) AS best FROM p GROUP BY base),
x AS (SELECT base, min(locale) AS winner FROM p JOIN w USING (base) WHERE ok AND t = best GROUP BY base)
SELECT locale, ok AND locale = winner AS included FROM p LEFT JOIN x USING (base)""")
def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with its overrides, and the largest variant of each language."""
    out = selection.decide(locales(spark, sf_dir), _RULE, _HELD, _CARRIED, _COMMITTED)
    return out.select("locale", F.coalesce("included", F.lit(False)).alias("included"))


@query("""WITH n AS (SELECT c_nationkey, sum(c_acctbal) AS total FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, round(total * 0.1, 4) AS dev_hours, round(total - total * 0.1 - total * 0.1, 4) AS trainable_hours FROM n""")
def derived_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora without published evaluation hours, priced at their total."""
    null = F.lit(None).cast("double")
    corpora = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total_hours")).select(F.col("c_nationkey").alias("id"), F.array(F.col("c_nationkey").cast("string")).alias("languages"), "total_hours", null.alias("train_hours"), null.alias("dev_hours"), null.alias("test_hours"))
    out = durations.corpus_hours(corpora)
    return out.select(F.col("corpus").alias("c_nationkey"), F.round("dev_hours", 4).alias("dev_hours"), F.round("trainable_hours", 4).alias("trainable_hours"))


@query("""WITH b AS (SELECT p_brand AS locale, sum(p_size) AS train, sum(p_size % 7) AS dev, sum(p_size % 5) AS test, avg(p_retailprice) / 100 AS a, sum(p_retailprice) / 500 AS v FROM part GROUP BY p_brand),
h AS (SELECT locale, train * a / 3600.0 AS train_hours, dev * a / 3600.0 AS dev_hours, test * a / 3600.0 AS test_hours, v FROM b) SELECT locale, round(train_hours, 6) AS train_hours, round(greatest(0.0, v - dev_hours - test_hours), 6) AS trainable_hours FROM h""")
def bucket_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of release buckets: clip counts times a mean length."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("locale")).agg(F.sum("p_size").alias("train"), F.sum(F.col("p_size") % 7).alias("dev"), F.sum(F.col("p_size") % 5).alias("test"), (F.avg("p_retailprice") / 100).alias("avg_secs"), (F.sum("p_retailprice") / 500).alias("valid_hours"))
    return durations.bucket_hours(b).select("locale", F.round("train_hours", 6).alias("train_hours"), F.round("trainable_hours", 6).alias("trainable_hours"))


@query("SELECT event_type, user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1")
def dedupe_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    return splits.first_of(rows, ["event_type", "user_id"], [F.col("event_id").asc()])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b AND event_type <> 'error'")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without repeats of the frame before, then without blanks."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return frames.collapse_frames(e, ["user_id"], ["ts", "event_id"], "event_type", F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER w AS step, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, b IS NULL OR value < b AS better FROM s), l AS (SELECT *, step - coalesce(max(CASE WHEN better THEN step END) OVER (PARTITION BY user_id ORDER BY step), 0) AS since FROM i),
e AS (SELECT user_id, min(step) FILTER (WHERE since >= 5) AS stop FROM l GROUP BY user_id)
SELECT user_id, CAST(max(step) FILTER (WHERE better) AS INTEGER) AS best_step, min(value) FILTER (WHERE better) AS best_loss, CAST(any_value(stop) AS INTEGER) AS stop_step FROM l JOIN e USING (user_id) WHERE stop IS NULL OR step <= stop GROUP BY user_id""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.best_checkpoints(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 5)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def length_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.by_length(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", ["lang"]).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


#: Models that the vectors are dealt to, the base among them.
MODELS = 8


def experts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as models: each vector is the tensor of one key of one model, eight successive ones the same key's; model
    0 is the base. Keys that a model lacks aren't merged."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % MODELS).alias("expert"), F.floor(F.col("vec_id") / MODELS).cast("long").cast("string").alias("key"), "embedding")
    rows = v.select("expert", "key", F.posexplode("embedding").alias("idx", "v")).select("expert", "key", "idx", F.col("v").cast("double").alias("value"))
    return rows.where("expert <> 0"), rows.where("expert = 0").drop("expert")


_EXPERTS_SQL = f"""o AS (SELECT vec_id % {MODELS} AS expert, CAST(vec_id // {MODELS} AS VARCHAR) AS key, embedding FROM embeddings),
r AS (SELECT expert, key, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM o), x AS (SELECT * FROM r WHERE expert <> 0), b AS (SELECT key, idx, value FROM r WHERE expert = 0),
c AS (SELECT key FROM x GROUP BY key HAVING count(DISTINCT expert) = (SELECT count(DISTINCT expert) FROM x)), m AS (SELECT * FROM x WHERE key IN (SELECT key FROM c))"""
_TV_SQL = "tv AS (SELECT expert, m.key, m.idx, m.value - b.value AS v FROM m JOIN b ON m.key = b.key AND m.idx = b.idx)"


def _trim_sql(source: str) -> str:
    return f"trimmed AS (SELECT expert, key, idx, v FROM (SELECT *, row_number() OVER (PARTITION BY expert, key ORDER BY abs(v) DESC, idx) AS k, count(*) OVER (PARTITION BY expert, key) AS n FROM {source}) WHERE k <= greatest(1, floor(n * 0.2::DOUBLE)))"


_ELECT_SQL = """e AS (SELECT *, sum(v) OVER (PARTITION BY key, idx) AS s FROM trimmed), merged AS (SELECT key, idx, coalesce(sum(v) FILTER (WHERE sign(v) = sign(s) AND v <> 0), 0.0) / greatest(1, count(*) FILTER (WHERE sign(v) = sign(s) AND v <> 0)) AS v FROM e GROUP BY key, idx)
SELECT b.key, b.idx, round(b.value + coalesce(merged.v, 0.0), 9) AS value FROM b LEFT JOIN merged ON b.key = merged.key AND b.idx = merged.idx WHERE b.key IN (SELECT key FROM c)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("idx").cast("int").alias("idx"), r9("value").alias("value"))


@query(f"WITH {_EXPERTS_SQL} SELECT key, idx, round(avg(value), 9) AS value FROM m GROUP BY key, idx")
def merge_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merging.merge("average", experts(spark, sf_dir)[0]))


@query(f"WITH {_EXPERTS_SQL}, {_TV_SQL}, {_trim_sql('tv')}, {_ELECT_SQL}")
def merge_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merging.merge("ties", *experts(spark, sf_dir)))


@query(f"WITH {_EXPERTS_SQL}, {_TV_SQL}, dropped AS (SELECT expert, key, idx, CASE WHEN CAST(CAST('0x' || substr(sha1('7:' || expert || ':' || key || ':' || idx), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 >= 0.5 THEN v / 0.5 ELSE 0.0 END AS v FROM tv), {_trim_sql('dropped')}, {_ELECT_SQL}")
def merge_dare_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merging.merge("dare_ties", *experts(spark, sf_dir), seed=7))


@query(f"WITH {_EXPERTS_SQL}, {_TV_SQL}, {_trim_sql('tv')} SELECT CAST(expert AS BIGINT) AS expert, key, idx, round(v, 9) AS value FROM trimmed")
def trim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = experts(spark, sf_dir)
    out = merging.trim(merging.task_vectors(merging.mergeable(rows), base), 0.2)
    return out.select(F.col("expert").cast("long").alias("expert"), "key", F.col("idx").cast("int").alias("idx"), r9("value").alias("value"))


@query(f"""WITH {_EXPERTS_SQL}, e AS (SELECT DISTINCT expert FROM x), bb AS (SELECT expert, key, idx, value FROM b, e),
j AS (SELECT coalesce(x.expert, bb.expert) AS expert, coalesce(x.key, bb.key) AS key, abs(x.value - bb.value) AS d FROM x FULL JOIN bb ON x.expert = bb.expert AND x.key = bb.key AND x.idx = bb.idx)
SELECT expert, key, CASE WHEN count(*) = count(d) THEN round(max(d), 9) END AS delta FROM j GROUP BY expert, key""")
def max_abs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each expert is from the base, by key; null where one of them lacks an entry."""
    rows, base = experts(spark, sf_dir)
    every = base.crossJoin(F.broadcast(rows.select("expert").distinct()))  # seven experts
    return merging.worst_delta(rows, every, ["expert", "key"], ["idx"]).select("expert", "key", r9("delta").alias("delta"))


@query("SELECT r_name AS scale, c_mktsegment AS arm, s AS seed, r_name || '/' || c_mktsegment || '/seed' || s AS label FROM region, (SELECT DISTINCT c_mktsegment FROM customer), range(5) t(s)")
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale by arm by seed, with the run's label. Three dimension tables of a few rows."""
    scale = table(spark, sf_dir, "region").select(F.col("r_name").alias("scale"))
    arm = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("arm")).distinct()
    jobs = scale.crossJoin(arm).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return jobs.withColumn("label", F.concat_ws("/", "scale", "arm", F.concat(F.lit("seed"), F.col("seed").cast("string"))))


@query("SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS text, c_name IS NULL AS only_right, s_name IS NULL AS only_left FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def transcripts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of transcripts by id; where both have one, the right one stands."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return corpora.preferring(right, left, "id")


@query("SELECT p_name AS stem, count(*) AS n, count(*) - 1 AS surplus FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.duplicates(table(spark, sf_dir, "part").select(F.col("p_name").alias("stem")), "stem")


@query("SELECT lang, count(*) AS n_utts, count(DISTINCT source) AS n_speakers, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.summary(table(spark, sf_dir, "documents"), ["lang"], "source", "n_chars", "n_chars")


@query("""WITH n AS (SELECT l_linestatus AS split, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'X', 0), p(split, published) AS (VALUES ('O', 30000::BIGINT), ('X', 3::BIGINT))
SELECT split, n, n IS NOT DISTINCT FROM published AS as_published FROM n LEFT JOIN p USING (split)""")
def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts by split against published ones; a published split without rows counts as 0."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("split")).agg(F.count("*").alias("n"))
    return corpora.against_published(counts, {"O": 30000, "X": 3}, "split").drop("published")


@query("SELECT o_orderpriority AS lang, count(*) FILTER (WHERE l_orderkey IS NULL) AS n_absent, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS n_present FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1")
def absent_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose recording is absent are counted."""
    files = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpora.presence(table(spark, sf_dir, "orders"), files, "o_orderkey", ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "lang")
