"""Documents beside the data: records of repositories, presets, registries, results, reports, made of rows of the tables.

What is written here is small by nature, a row for a language, a seed or a file of a corpus.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection, vocabulary
from ..operators import seeds as S
from ..scratch import new_folder, write_file
from ..shipping import ship
from ..sources import readers, repository, sinks, specs
from . import report
from .corpus_queries import _CARRIED, _COMMITTED, _HELD, _RULE, locales
from .registry import basic_sql, query, r9, table
from .scoring_queries import RESULTS_SQL, results
from .text_queries import bench_text

#: Files of one record.
FILES = 10


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of records, ten each: some without a place, a size or a digest; every seventh record is cut off."""
    ship(spark)
    key, number = F.col("c_custkey"), F.expr(f"c_custkey div {FILES}")
    size = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(' SIZE="'), (key * 10).cast("string"), F.lit('"')))
    digest = F.when(key % 4 == 0, F.lit(' CHECKSUMTYPE="SHA-1" CHECKSUM="AB"')).otherwise(F.concat(F.lit(' CHECKSUMTYPE="MD5" CHECKSUM="'), F.upper(F.md5(F.col("c_name").cast("binary"))), F.lit('"')))
    place = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit('<mets:FLocat xlink:href="/files/'), key.cast("string"), F.lit('.zip?sequence=1"/>')))
    one = F.concat(F.lit("<mets:file"), size, digest, F.lit(">"), place, F.lit("</mets:file>"))
    rights = F.when(number % 3 == 0, '<dim:field element="rights">Creative Commons - Attribution 4.0</dim:field>').when(number % 3 == 1, '<dim:field element="rights" qualifier="uri">no</dim:field>').otherwise('<dim:field element="rights"> All rights reserved </dim:field>')
    rows = table(spark, sf_dir, "customer").select(number.alias("id"), key.alias("k"), one.alias("one"), rights.alias("rights"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "one"))), lambda x: x["one"]), "")
    head = F.lit('<mets:METS xmlns:mets="m" xmlns:xlink="x" xmlns:dim="d">')
    whole = rows.groupBy("id").agg(F.concat(head, F.first("rights"), body, F.lit("</mets:METS>")).alias("record"))
    cut = F.when(F.col("id") % 7 == 6, F.expr("left(record, length(record) - 12)")).otherwise(F.col("record"))
    return whole.select("id", cut.alias("record"), F.lit("https://repository.example/items/1").alias("base"))


_RECORDS_SQL = f"""f AS (SELECT c_custkey // {FILES} AS id, c_custkey AS k, c_name FROM customer), r AS (SELECT id, CASE id % 3 WHEN 0 THEN 'Creative Commons - Attribution 4.0' WHEN 1 THEN '' ELSE 'All rights reserved' END AS licence FROM (SELECT DISTINCT id FROM f) WHERE id % 7 <> 6)"""


@query(f"""WITH {_RECORDS_SQL}, g AS (SELECT * FROM f WHERE k % 6 <> 0) SELECT r.id, licence, k || '.zip' AS name, 'https://repository.example/files/' || k || '.zip?sequence=1' AS url, CASE WHEN k % 5 = 0 THEN -1 ELSE k * 10 END AS bytes, CASE WHEN k % 4 = 0 THEN '' ELSE md5(c_name) END AS md5 FROM r JOIN g USING (id)""")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records with their licence; what a record doesn't say of a file is shown as -1 and an empty text."""
    found = repository.files(records(spark, sf_dir)).where("error is null and name is not null")
    return found.select("id", "licence", "name", "url", F.coalesce("bytes", F.lit(-1).cast("long")).alias("bytes"), F.coalesce("md5", F.lit("")).alias("md5"))


@query(f"WITH {_RECORDS_SQL}, a AS (SELECT id, licence, FALSE AS broken FROM r WHERE licence NOT LIKE '%Attribution%' UNION ALL SELECT DISTINCT id, '', TRUE FROM f WHERE id % 7 = 6) SELECT * FROM a")
def repository_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose licence isn't the expected one, and those that can't be read."""
    found = repository.files(records(spark, sf_dir)).select("id", "licence", "error").distinct()
    other = repository.without_licence(found, "Attribution").select("id", "licence", F.lit(False).alias("broken"))
    return other.unionByName(found.where("error is not null").select("id", F.lit("").alias("licence"), F.lit(True).alias("broken")))


@query("""WITH p AS (SELECT o_orderkey AS k, ['train', 'dev', 'other', 'test'][o_orderkey % 4 + 1] AS split, ['transcriptions/stm/a/', 'audio/a/', 'transcriptions/a/'][o_custkey % 3 + 1] AS mid, ['.stm', '.wav', '.STM', '.txt'][(o_orderkey // 4) % 4 + 1] AS ending FROM orders)
SELECT k, split <> 'other' AND mid = 'transcriptions/stm/a/' AND lower(ending) = '.stm' AS stm, split <> 'other' AND mid = 'audio/a/' AND ending = '.wav' AS audio FROM p""")
def member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which members of an archive are transcripts and which are recordings, by their paths."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    key = F.col("o_orderkey")
    path = F.concat(pick(("train", "dev", "other", "test"), key % 4), F.lit("/"), pick(("transcriptions/stm/a/", "audio/a/", "transcriptions/a/"), F.col("o_custkey") % 3), key.cast("string"), pick((".stm", ".wav", ".STM", ".txt"), F.expr("(o_orderkey div 4) % 4")))
    rows = table(spark, sf_dir, "orders").select(key.alias("k"), path.alias("path"))
    return rows.select("k", repository.is_stm(F.col("path")).alias("stm"), repository.is_audio(F.col("path")).alias("audio"))


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, lower(n_name) AS code, ['commonvoice', 'manifest', 'openslr'][n_nationkey % 3 + 1] AS source, n_nationkey % 5 <> 0 AS word_boundary, CASE WHEN n_nationkey % 4 = 0 THEN 'norm-1' ELSE '' END AS normalizer,
  CASE WHEN n_nationkey % 3 = 1 THEN 'r' || n_regionkey ELSE '' END AS corpus, 'sentence' AS text_column, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey ELSE -1 END AS slr FROM nation""")
def preset_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the languages of a preset, written as its document and read with the defaults of what isn't said."""
    lines = ["languages:"]
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # twenty-five
        own = [f"code: {r.n_name.lower()}", *[["source: commonvoice", "hf_config: x"], ["source: manifest", f"corpus: r{r.n_regionkey}", "hf_config: x"], ["source: openslr", f"slr: {r.n_nationkey}", "archives: [a.zip]", "index_files: [i.tsv]"]][r.n_nationkey % 3]]
        own += (["word_boundary: false"] if r.n_nationkey % 5 == 0 else []) + (["normalizer: norm-1"] if r.n_nationkey % 4 == 0 else [])
        lines.append("  - { " + ", ".join(own) + " }")
    out = specs.preset_of(spark, specs.parsed("\n".join(lines)))
    return out.select("ord", "code", "source", "word_boundary", F.coalesce("normalizer", F.lit("")).alias("normalizer"), "corpus", "text_column", F.coalesce("slr", F.lit(-1)).cast("long").alias("slr"))


@query("""SELECT 'r' || r_regionkey AS id, lower(n_name) AS language, CASE r_regionkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS ships_split, r_regionkey * 10.0 AS total_hours FROM region JOIN nation ON n_regionkey = r_regionkey""")
def registry_of_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as corpora of their nations, written as the registry's document and read again."""
    found = []
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("languages"))
    for r in table(spark, sf_dir, "region").join(names, "r_regionkey").orderBy("r_regionkey").collect():  # five
        own = dict.fromkeys(("source_page", "licence_name", "licence_url", "audio_format", "transcripts", "preparer", "citation"), "x")
        found.append(own | {"id": f"r{r.r_regionkey}", "name": r.r_name, "languages": list(r.languages), "downloads": [], "speaker_ids": "column", "ships_split": ["full", "partial", "none"][r.r_regionkey % 3], "total_hours": r.r_regionkey * 10})
    registry = specs.corpora_of(spark, specs.parsed(json.dumps({"corpora": found})))
    return registry.select("id", F.explode("languages").alias("language"), "ships_split", "total_hours")


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """A tree of runs, its documents as the evaluation writes them: some dozens of rates a seed."""
    root, rows = new_folder(spark, "documents"), results(spark, sf_dir).where("section <> 'N'")
    named = rows.withColumn("section", F.when(F.col("section") == "A", "in_distribution").otherwise("transfer")).withColumns({"n": F.lit(7).cast("long"), "n_empty_refs": F.col("seed").cast("long")})
    for seed in sorted(r.seed for r in named.select("seed").distinct().collect()):
        own = named.where(F.col("seed") == seed)
        languages = sorted(r.lang for r in own.select("lang").distinct().collect())
        doc = sinks.results_document("base", "s", seed, own, languages)
        stats = spark.createDataFrame([(code, "test", 7) for code in languages], "lang string, split string, n_utts long")
        policies = [{"code": code, "heldout": False, "word_boundary": code.startswith("O"), "policy": "norm-1" if seed > 1 else "whisper-basic", "policy_hash": "h"} for code in languages]
        write_file(spark, f"{root}/base/s/seed{seed}/results.json", json.dumps(doc))
        write_file(spark, f"{root}/base/s/seed{seed}/text_stats.json", json.dumps(sinks.text_stats_document(stats, policies, {})))
    return root


@query(f"""WITH {RESULTS_SQL} SELECT CASE section WHEN 'A' THEN 'in_distribution' ELSE 'transfer' END AS section, lang, seed, 7::BIGINT AS n, CAST(seed AS BIGINT) AS n_empty_refs, round(wer, 9) AS wer, round(cer, 9) AS cer, word_boundary, CASE WHEN seed > 1 THEN 'norm-1' ELSE 'whisper-basic' END AS policy FROM results WHERE section <> 'N' AND seed IN (2, 4)""")
def results_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and text statistics written and read again, of two seeds of all."""
    got = readers.run_results(spark, _documents(spark, sf_dir), "base", "s").where(F.col("seed").isin(2, 4))
    return got.select("section", "lang", "seed", "n", "n_empty_refs", r9("wer").alias("wer"), r9("cer").alias("cer"), "word_boundary", "policy")


_CELL = "CASE WHEN {0} IS NULL THEN '—' ELSE printf('%.2f', {0}) || ' ± ' || CASE WHEN {1} IS NULL THEN '—' ELSE printf('%.2f', {1}) END END"


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT section, lang, CASE WHEN arg_min(word_boundary, seed) THEN 'WER' ELSE 'CER' END AS kind, avg(wer) AS wm, stddev_samp(wer) AS ws, avg(cer) AS cm, stddev_samp(cer) AS cs, count(*) AS n FROM results WHERE seed < 3 GROUP BY section, lang)
SELECT row_number() OVER (ORDER BY section, lang) + 1 AS at, '| ' || concat_ws(' | ', section, lang, kind, {_CELL.format('wm', 'ws')}, {_CELL.format('cm', 'cs')}, n) || ' |' AS line FROM s""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an aggregate's table under its head, in the order of sections and languages."""
    text = report.language_table(S.by_language(results(spark, sf_dir).where("seed < 3")))
    lines = text.rstrip("\n").split("\n")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines) if k > 1], "at long, line string")


@query("""WITH h AS (SELECT c_nationkey || '-' || substr(c_mktsegment, 1, 1) || c_custkey AS locale, CAST(c_nationkey AS VARCHAR) AS base, abs(c_acctbal) / 100.0 AS t FROM customer),
ok AS (SELECT * FROM h WHERE t >= 30.0 AND t / 20.0 >= 2.0 AND t / 15.0 >= 2.0), w AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY base ORDER BY t DESC, locale) = 1)
SELECT row_number() OVER (ORDER BY t DESC, locale) AS at, '  - { code: ' || locale || ', source: commonvoice, hf_dataset: cv-1, hf_config: ' || locale || ', text_column: sentence, normalizer: norm-1 }' AS line FROM w""")
def preset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that the rule takes as lines of a preset, those with most hours first."""
    out = selection.decide(locales(spark, sf_dir), _RULE, _HELD, _CARRIED, _COMMITTED)
    codes = {r.locale: "norm-1" for r in out.where("included").select("locale").collect()}
    lines = report.preset_block(out, "cv-1", {}, codes).rstrip("\n").split("\n")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines) if k], "at long, line string")


@query("""SELECT 'c' || s_nationkey AS corpus, 's' || s_suppkey || '.zip' AS name, 'https://x.example/' || s_suppkey AS url, s_suppkey * 100 AS bytes, sha256(s_name) AS sha256, md5(s_name) AS md5 FROM supplier""")
def fetch_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was fetched for each corpus, written as its document and read again."""
    root = new_folder(spark, "fetched")
    raw, key = F.col("s_name").cast("binary"), F.col("s_suppkey").cast("string")
    one = F.struct(F.concat(F.lit("s"), key, F.lit(".zip")).alias("name"), F.concat(F.lit("https://x.example/"), key).alias("url"), (F.col("s_suppkey") * 100).alias("bytes"), F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"))
    for r in table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(one).alias("files")).collect():  # a document for each corpus
        doc = sinks.fetch_document(f"c{r.s_nationkey}", "CC0", [f.asDict() for f in r.files], "2024-01-01T00:00:00Z")
        write_file(spark, f"{root}/c{r.s_nationkey}/fetch_manifest.json", json.dumps(doc))
    found = spark.read.schema("corpus string, files array<struct<name string, url string, bytes long, sha256 string, md5 string>>").option("multiLine", True).json(f"{root}/*/fetch_manifest.json")
    return found.select("corpus", F.inline("files"))


@query("SELECT c_custkey AS utt_id, ['dev', 'Train', 'valid'][c_custkey % 3 + 1] AS split FROM customer WHERE c_custkey % 10 = 0")
def manifest_odd_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest whose split is none that there is: a manifest with such rows is refused."""
    key = F.col("c_custkey")
    odd = F.element_at(F.array(F.lit("dev"), F.lit("Train"), F.lit("valid")), (key % 3 + 1).cast("int"))
    split = F.when(key % 10 == 0, odd).when(key % 10 == 1, "").when(key % 10 == 2, "test").when(key % 10 == 3, "validation").otherwise("train")
    return readers.odd_splits(table(spark, sf_dir, "customer").select(key.alias("utt_id"), split.alias("split")))


@query(f"""WITH c AS (SELECT item_id % 3 AS lang, unnest(string_split({basic_sql('text')}, '')) AS char FROM benchmark), v AS (SELECT lang, char FROM c WHERE char <> '' AND NOT (lang = 1 AND char = ' ') GROUP BY lang, char)
SELECT lang, count(*) AS n, bool_or(char = ' ') AND lang <> 2 AS usable FROM v GROUP BY lang""")
def vocabulary_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vocabularies: one holds the space, one lacks it, and in one it is the blank."""
    texts = bench_text(spark, sf_dir).withColumn("lang", F.col("item_id") % 3)
    chars = texts.select("lang", F.explode(vocabulary.characters(F.col("normalized"))).alias("char")).distinct().where("not (lang = 1 and char = ' ')")
    numbered = chars.withColumn("id", F.when((F.col("lang") == 2) & (F.col("char") == " "), 0).otherwise(2))
    return numbered.groupBy("lang").agg(F.count("*").alias("n")).join(vocabulary.spaces(numbered, ["lang"]), "lang")
