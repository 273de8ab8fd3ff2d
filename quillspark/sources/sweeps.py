"""Many releases read as one table, so that a sweep over all languages is one job and a broken file is a row.

The files of all languages are one text scan. Each line knows its file; a file's first line is its header, joined back by
file, and columns are found by the header's names, so files may order them as they like. What is wrong with a file (it is
missing, its header lacks a column, a line is no UTF-8) becomes a row with the reason, found where the file is read; the
other languages aren't touched by it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import durations, leakguard
from ..scratch import keep
from .readers import SPLIT_FILES, audio_headers, exists

DURATIONS, VALIDATED = "clip_durations.tsv", "validated.tsv"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the reader's metadata writes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def _plain(path: Column) -> Column:
    """One slash after the scheme, however the path is written; a table written in parts is its folder."""
    return F.regexp_replace(F.regexp_replace(path, r"/part-[^/]*$", ""), r"^(\w+):/+", "$1:/")


def tables(spark: SparkSession, files: Mapping[tuple[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """Tab-separated files by (language, name): their lines (lang, name, at, header, fields) and what is wrong with files
    (lang, name, error). ``at`` orders the lines of a file."""
    there = {key: path for key, path in files.items() if exists(spark, path)}
    missing = [(*key, f"FileNotFoundError: {path}") for key, path in files.items() if key not in there]
    problems = spark.createDataFrame(missing, "lang string, name string, error string")
    empty = "lang string, name string, at struct<start: long, id: long>, header array<string>, fields array<string>"
    if not there:
        return spark.createDataFrame([], empty), problems
    # One row a file, from the settings.
    named = spark.createDataFrame([(*key, _qualified(spark, path)) for key, path in there.items()], "lang string, name string, __file string").withColumn("__file", _plain(F.col("__file")))
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    raw = spark.read.text(list(there.values())).select("value", F.col("_metadata.file_path").alias("__path"), at.alias("at"))
    lines = raw.withColumn("__file", _plain(F.col("__path"))).join(named, "__file")
    first = lines.groupBy("__path").agg(F.min("at").alias("__first"), F.min_by("value", "at").alias("__header"))
    split = lambda c: F.split(F.col(c), "\t", -1)
    whole = lines.join(first, "__path").where(F.col("at") != F.col("__first"))
    bad = lines.where(~F.is_valid_utf8("value")).groupBy("lang", "name").agg(F.concat(F.lit("UnicodeDecodeError: "), F.count("*").cast("string"), F.lit(" lines")).alias("error"))
    return whole.select("lang", "name", "at", split("__header").alias("header"), split("value").alias("fields")), problems.unionByName(bad)


def headers(spark: SparkSession, files: Mapping[tuple[str, str], str], columns: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(lang, name, error) of files whose header lacks a column that ``columns`` names for them."""
    there = {key: path for key, path in files.items() if key[1] in columns and exists(spark, path)}
    if not there:
        return spark.createDataFrame([], "lang string, name string, error string")
    named = spark.createDataFrame([(*key, list(columns[key[1]]), _qualified(spark, path)) for key, path in there.items()], "lang string, name string, __need array<string>, __file string").withColumn("__file", _plain(F.col("__file")))
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    # The first block of each file; a file without lines has no header at all.
    raw = spark.read.text(list(there.values())).where(F.col("_metadata.file_block_start") == 0).select("value", F.col("_metadata.file_path").alias("__path"), at.alias("at"))
    first = raw.groupBy("__path").agg(F.min_by("value", "at").alias("__header")).withColumn("__file", _plain(F.col("__path")))
    lacks = F.array_except("__need", F.split(F.coalesce("__header", F.lit("")), "\t", -1))
    found = named.join(first, "__file", "left").where(F.size(lacks) > 0)
    return found.groupBy("lang", "name").agg(F.concat(F.lit("ValueError: lacks "), F.array_join(F.array_sort(F.flatten(F.collect_set(lacks))), ", ")).alias("error"))


def field(name: str) -> Column:
    """A column's value without white space around it; empty where the line or the file has none."""
    return strip(F.coalesce(F.get("fields", F.array_position("header", F.lit(name)).cast("int") - 1), F.lit("")))


def voice(spark: SparkSession, roots: Mapping[str, str], text_columns: Mapping[str, str] | None = None, train_source: str = "train") -> tuple[DataFrame, DataFrame]:
    """Hours of releases by language: (lang, split, n_utts, seconds, n_missing, error) and, for training rows that are those
    validated less the evaluation, (lang, what the guard counted).

    A language with anything wrong has one row with the reason, and no other. Without a list of durations the headers of
    its recordings are read.
    """
    names = [*SPLIT_FILES.values(), DURATIONS, *([VALIDATED] if train_source != "train" else [])]
    files = {(lang, name): f"{root}/{name}" for lang, root in roots.items() for name in names}
    unlisted = [lang for lang in roots if not exists(spark, files[lang, DURATIONS])]
    wanted = {key: path for key, path in files.items() if key != (key[0], DURATIONS) or key[0] not in unlisted}
    texts = {lang: (text_columns or {}).get(lang, "sentence") for lang in roots}
    lines, problems = tables(spark, wanted)
    needed = [headers(spark, {k: p for k, p in wanted.items() if texts[k[0]] == text}, {n: ("path", text, *(("client_id",) if train_source != "train" else ())) if n != DURATIONS else ("clip", "duration[ms]") for n in names}) for text in sorted(set(texts.values()))]
    for more in needed:
        problems = problems.unionByName(more)
    lines = keep(lines, "sweep")
    column = F.lit("")
    for text in sorted(set(texts.values())):
        column = F.when(F.col("lang").isin([k for k, v in texts.items() if v == text]), field(text)).otherwise(column)
    clips = lines.where(F.col("name") != DURATIONS).select("lang", "name", field("path").alias("path"), column.alias("text"), field("client_id").alias("client_id")).where("path <> '' and text <> ''")
    listed = lines.where(F.col("name") == DURATIONS).select("lang", "at", field("clip").alias("path"), F.expr("try_cast(trim(get(fields, cast(array_position(header, 'duration[ms]') as int) - 1)) as double)").alias("ms"))
    known = listed.where("ms is not null and path <> ''").groupBy("lang", "path").agg((F.max_by("ms", "at") / 1000.0).alias("seconds"))
    for lang in unlisted:
        if exists(spark, f"{roots[lang]}/clips/*"):
            measured = audio_headers(spark, f"{roots[lang]}/clips/*").where("seconds is not null")
            known = known.unionByName(measured.select(F.lit(lang).alias("lang"), F.element_at(F.split("path", "/"), -1).alias("path"), "seconds"))
    split = F.lit(None).cast("string")
    for part, name in SPLIT_FILES.items():
        split = F.when(F.col("name") == name, part).otherwise(split)
    official = clips.withColumn("split", split).where("split is not null")
    guards = None
    rows = official.select("lang", "split", "path")
    if train_source != "train":
        evaluation, validated = official.where("split <> 'train'"), clips.where(F.col("name") == VALIDATED)
        unnamed = evaluation.select("lang", "client_id").unionByName(validated.select("lang", "client_id")).where("client_id = ''").groupBy("lang").agg(F.concat(F.lit("ValueError: "), F.count("*").cast("string"), F.lit(" rows have no client_id: the speaker guard can't be applied")).alias("error"))
        # Recordings and speakers are those of a language.
        own = lambda c: F.concat_ws("\t", "lang", c)
        marked = leakguard.dispositions(validated.withColumns({"__key": own("path"), "__who": own("client_id")}), evaluation.select(own("path").alias("__key"), own("client_id").alias("__who")), "__key", "__who")
        marked = keep(marked.drop("__key", "__who"), "sweep")
        kept = marked.where(F.col("disposition") == leakguard.KEPT)
        lost = official.where("split = 'train'").join(kept, ["lang", "path"], "left_anti").groupBy("lang").agg(F.concat(F.lit("ValueError: the guard removes "), F.count("*").cast("string"), F.lit(" training rows of the release")).alias("error"))
        problems = problems.unionByName(unnamed.withColumn("name", F.lit(VALIDATED))).unionByName(lost.withColumn("name", F.lit(VALIDATED)))
        rows = evaluation.select("lang", "split", "path").unionByName(kept.select("lang", F.lit("train").alias("split"), "path"))
        guards = leakguard.accounting(marked.join(known, ["lang", "path"], "left"), ["lang"], seconds="seconds")
    problems = keep(problems.groupBy("lang").agg(F.min_by("error", "name").alias("error")), "sweep")
    parts = durations.split_durations(rows.withColumn("__clip", F.struct("lang", "path")), known.select(F.struct("lang", "path").alias("__clip"), "seconds"), ["lang", "split"], "__clip")
    parts = parts.join(problems, "lang", "left_anti").withColumn("error", F.lit(None).cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    failed = problems.select("lang", null("string").alias("split"), null("long").alias("n_utts"), null("double").alias("seconds"), null("long").alias("n_missing"), "error")
    return parts.unionByName(failed), guards if guards is not None else spark.createDataFrame([], "lang string")
