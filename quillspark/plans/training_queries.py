"""Batches, evaluation and the sweep over releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.policies import policy
from ..operators import batching, evaluation
from ..scratch import keep, new_folder, write_table
from ..shipping import ship
from ..sources import readers, sweeps
from .registry import basic_sql, query, r9, table
from .text_queries import _CLASSIC_SQL, _VOCAB_SQL, _frames_sql, bench_vocabulary

#: Samples that stand for a character, so that some texts fit their frames and some don't.
SAMPLES, ROWS, BUDGET = 320, 16, 20_000


def policies() -> dict:
    return {"de": policy("norm-1"), "*": policy("whisper-basic")}


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang", "text", (F.col("n_chars") * SAMPLES).cast("long").alias("samples"))


_LABELS_SQL = f"""{_VOCAB_SQL}, n AS (SELECT doc_id, lang, CAST(n_chars * {SAMPLES} AS BIGINT) AS samples, CASE WHEN lang = 'de' THEN {_CLASSIC_SQL} ELSE {basic_sql("coalesce(text, '')")} END AS x FROM documents),
r AS (SELECT *, trim(x) = '' AS blank, length(x) > {_frames_sql('samples')} AS over, (row_number() OVER (PARTITION BY lang ORDER BY samples DESC, doc_id) - 1) // {ROWS} AS batch FROM n),
ids AS (SELECT doc_id, sum(coalesce(id, 1)) AS total FROM (SELECT doc_id, unnest(string_split(x, '')) AS char FROM n) LEFT JOIN vocab USING (char) WHERE char <> '' GROUP BY doc_id)"""


def _collated_sql(kept: str, dropped: str, guard: str) -> str:
    return f"""WITH {_LABELS_SQL}, k AS (SELECT r.*, coalesce(total, 0) AS total, {kept} AS kept, {dropped} AS dropped FROM r LEFT JOIN ids USING (doc_id))
SELECT lang, batch, count(*) FILTER (WHERE kept) AS n, count(*) FILTER (WHERE dropped) AS n_dropped, count(*) FILTER (WHERE blank) AS n_empty_text, count(*) FILTER (WHERE {guard}) AS n_at_audio_guard,
  coalesce(max(samples) FILTER (WHERE kept), 0) AS padded_samples, greatest(1, coalesce(max(length(x)) FILTER (WHERE kept), 1)) AS padded_labels, CAST(coalesce(sum(total) FILTER (WHERE kept), 0) AS BIGINT) AS label_sum FROM k GROUP BY lang, batch"""


def _collated(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    rows = batching.collated(utterances(spark, sf_dir), bench_vocabulary(spark, sf_dir), policies(), **how)
    rows = rows.withColumn("__sum", F.when(F.col("kept"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x))).drop("text", "normalized", "labels")
    found = keep(batching.batches(keep(rows, "collated"), ROWS, ["lang"]), "batches")
    sums = found.groupBy("lang", "batch").agg(F.coalesce(F.sum("__sum"), F.lit(0)).alias("label_sum"))
    return batching.batch_summary(found, ["lang"]).join(sums, ["lang", "batch"])


@query(_collated_sql("NOT blank AND NOT over", "over AND NOT blank", "samples >= 200000"))
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen rows a batch, longest first: what is dropped, what is left, and the lengths that it is padded to."""
    return _collated(spark, sf_dir, drop_overlong=True, drop_empty=True)


@query(_collated_sql("true", "false", "false"))
def evaluation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for evaluation, which drops nothing."""
    return _collated(spark, sf_dir, guard=None)


@query(f"""WITH f AS (SELECT doc_id, lang, {_frames_sql(f'n_chars * {SAMPLES}')} AS frames FROM documents),
c AS (SELECT *, CAST(greatest(0, ceil(ln(greatest(frames, 1.0::DOUBLE)) / ln({batching.RATIO}::DOUBLE) - 1e-9)) AS BIGINT) AS class FROM f),
k AS (SELECT *, greatest(1, CAST(floor({BUDGET}::DOUBLE / pow({batching.RATIO}::DOUBLE, class)) AS BIGINT)) AS most FROM c),
b AS (SELECT *, (row_number() OVER (PARTITION BY lang, class ORDER BY frames DESC, doc_id) - 1) // most AS batch FROM k)
SELECT lang, class, batch, count(*) AS n, CAST(max(frames) AS BIGINT) AS padded, CAST(sum(doc_id) AS BIGINT) AS id_sum, max(frames) * count(*) <= {BUDGET} OR count(*) = 1 AS within FROM b GROUP BY lang, class, batch""")
def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of similar lengths under a budget of frames, padding included."""
    rows = utterances(spark, sf_dir).select("pos", "lang", X.frame_budget(F.col("samples")).alias("frames"))
    found = batching.budgeted(rows, BUDGET, ["lang"])
    within = (F.max("frames") * F.count("*") <= BUDGET) | (F.count("*") == 1)
    return found.groupBy("lang", "class", "batch").agg(F.count("*").alias("n"), F.max("frames").alias("padded"), F.sum("pos").alias("id_sum"), within.alias("within"))


_SCORES_SQL = """f AS (SELECT l_orderkey AS k, l_linenumber AS i, [CAST(l_quantity % 3 AS DOUBLE), CAST(l_partkey % 4 AS DOUBLE), CAST(l_suppkey % 5 AS DOUBLE), CAST(l_linenumber % 3 AS DOUBLE)] AS s FROM lineitem),
b AS (SELECT k, i, s, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS id FROM f), n AS (SELECT k, count(*) AS m FROM b GROUP BY k),
g AS (SELECT b.*, lag(id) OVER (PARTITION BY b.k ORDER BY i, s) AS before, row_number() OVER (PARTITION BY b.k ORDER BY i, s) AS r, m FROM b JOIN n USING (k)),
c AS (SELECT k, string_agg(CASE id WHEN 2 THEN 'a' ELSE 'b' END, '' ORDER BY i, s) AS hyp FROM g WHERE r <= m - 1 AND id > 1 AND id IS DISTINCT FROM before GROUP BY k)"""
_TEXT_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'Ab!' WHEN 1 THEN 'b' WHEN 2 THEN '...' ELSE 'AB' END"
_EVALUATED_SQL = f"""{_SCORES_SQL}, p AS (SELECT o_orderpriority AS lang, o_orderkey AS pos, {basic_sql(_TEXT_SQL)} AS ref, coalesce(hyp, '') AS hyp FROM orders JOIN n ON n.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey)"""


def scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as utterances, their line items as frames; the last frame is padding."""
    score = F.array(*[x.cast("double") for x in (F.col("l_quantity") % 3, F.col("l_partkey") % 4, F.col("l_suppkey") % 5, F.col("l_linenumber") % 3)])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", score.alias("s")))), lambda x: x["s"])
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(ordered.alias("scores")).withColumn("length", F.size("scores") - 1)
    text = F.when(F.col("o_orderkey") % 4 == 0, "Ab!").when(F.col("o_orderkey") % 4 == 1, "b").when(F.col("o_orderkey") % 4 == 2, "...").otherwise("AB")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lang"), F.col("o_orderkey").alias("pos"), text.alias("text")).join(frames, "pos")


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    frames = scored_frames(spark, sf_dir)
    known = spark.createDataFrame([("<blank>", 0), ("<unk>", 1), ("a", 2), ("b", 3)], "char string, id int")
    spaced = frames.select("lang").distinct().withColumn("word_boundary", F.col("lang") != "5-LOW")
    return evaluation.evaluate(frames, known, {"*": policy("whisper-basic")}, ["lang"], spaced)


@query(f"WITH {_EVALUATED_SQL} SELECT lang, pos, ref, hyp FROM p")
def evaluated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and hypotheses, from frame scores."""
    return _evaluated(spark, sf_dir)[0].select("lang", "pos", "ref", "hyp")


@query(f"""WITH {_EVALUATED_SQL}, s AS (SELECT lang, count(*) FILTER (WHERE trim(ref) <> '') AS n, count(*) FILTER (WHERE trim(ref) = '') AS n_empty_refs, sum(CASE WHEN trim(ref) <> trim(hyp) THEN 1 ELSE 0 END) FILTER (WHERE trim(ref) <> '') AS w,
  sum(levenshtein(ref, hyp)) FILTER (WHERE trim(ref) <> '') AS e, sum(length(ref)) FILTER (WHERE trim(ref) <> '') AS len FROM p GROUP BY lang), m AS (SELECT *, 100.0 * w / n AS wer, 100.0 * e / len AS cer FROM s)
SELECT lang, n, n_empty_refs, round(wer, 9) AS wer, round(cer, 9) AS cer, CASE lang WHEN '5-LOW' THEN 'cer' ELSE 'wer' END AS primary_metric, round(CASE lang WHEN '5-LOW' THEN cer ELSE wer END, 9) AS primary_value FROM m""")
def evaluated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by language, from frame scores; words are scored as such but where they aren't delimited."""
    out = _evaluated(spark, sf_dir)[1]
    return out.select("lang", "n", "n_empty_refs", r9("wer").alias("wer"), r9("cer").alias("cer"), "primary_metric", r9("primary").alias("primary_value"))


#: Languages of the sweep, the market segments; the last two are broken.
SWEPT = ("AUTOMOBILE", "BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD")


def _durations(c: DataFrame) -> DataFrame:
    """Durations of clips: none for every ninth, and for every fourth an earlier one that doesn't count."""
    clip, ms = F.concat(F.col("c_custkey").cast("string"), F.lit(".mp3")), F.col("c_custkey") % 5000
    each = F.when(F.col("c_custkey") % 4 == 0, F.array(ms + 7, ms)).otherwise(F.array(ms))
    rows = c.where("c_custkey % 9 <> 0").select(clip.alias("clip"), F.posexplode(each).alias("__turn", "duration[ms]"))
    return rows.repartition(4, "clip").sortWithinPartitions("clip", "__turn").drop("__turn")


def _releases(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    root, roots = new_folder(spark, "releases"), {}
    c = table(spark, sf_dir, "customer")
    for lang in SWEPT:
        own = c.where(F.col("c_mktsegment") == lang)
        text = F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.col("c_name"))
        clips = own.select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("client_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(".mp3")).alias("path"), text.alias("sentence"), "c_custkey")
        for name, rest in (("train", "c_custkey % 10 > 1"), ("dev", "c_custkey % 10 = 0"), ("test", "c_custkey % 10 = 1")):
            rows = clips.where(rest).drop("c_custkey")
            if (lang, name) != ("HOUSEHOLD", "test"):
                write_table(rows.drop("sentence") if (lang, name) == ("FURNITURE", "dev") else rows, f"{root}/{lang}/{name}.tsv")
        write_table(_durations(own), f"{root}/{lang}/clip_durations.tsv")
        roots[lang] = f"{root}/{lang}"
    return roots


@query("""WITH c AS (SELECT c_mktsegment AS lang, CASE c_custkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 5000 AS DOUBLE) / 1000.0 END AS seconds FROM customer WHERE c_custkey % 7 <> 0)
SELECT lang, split, count(*) AS n_utts, round(coalesce(sum(seconds), 0), 6) AS seconds, count(*) FILTER (WHERE seconds IS NULL) AS n_missing, '' AS error FROM c WHERE lang NOT IN ('FURNITURE', 'HOUSEHOLD') GROUP BY lang, split
UNION ALL VALUES ('FURNITURE', '', 0, 0.0, 0, 'lacks sentence'), ('HOUSEHOLD', '', 0, 0.0, 0, 'test.tsv')""")
def duration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of five languages in one job. One has a file without its column, one lacks a file; both say so."""
    parts, _ = sweeps.voice(spark, _releases(spark, sf_dir))
    said = F.regexp_extract("error", r"(lacks \w+|\w+\.tsv)$", 1)
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast(parts.schema[c].dataType))
    return parts.select("lang", F.coalesce("split", F.lit("")).alias("split"), number("n_utts").alias("n_utts"), F.round(number("seconds"), 6).alias("seconds"), number("n_missing").alias("n_missing"), F.coalesce(said, F.lit("")).alias("error"))


@query("SELECT c_custkey || '.mp3' AS clip, CAST(c_custkey % 5000 AS DOUBLE) / 1000.0 AS seconds FROM customer WHERE c_custkey % 9 <> 0")
def read_repeated_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of clips that are listed twice the last line counts."""
    path = write_table(_durations(table(spark, sf_dir, "customer")), new_folder(spark, "durations") + "/clip_durations.tsv")
    return readers.clip_durations(spark, path)
