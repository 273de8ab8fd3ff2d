"""Transcripts and recordings of a corpus brought together, and what is counted on the way."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preferring(right: DataFrame, left: DataFrame, key: str = "utt_id", value: str = "text") -> DataFrame:
    """(key, value, only_right, only_left) of either side; where both have a key, the first argument's value."""
    r = right.select(key, F.col(value).alias("__r"), F.lit(True).alias("__in_r"))
    other = left.select(key, F.col(value).alias("__l"), F.lit(True).alias("__in_l"))
    both = r.join(other, key, "full_outer")
    return both.select(key, F.coalesce("__r", "__l").alias(value), F.col("__in_l").isNull().alias("only_right"), F.col("__in_r").isNull().alias("only_left"))


def with_audio(index: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows of an index whose recording is there, with the file's columns. Several files of a key are refused elsewhere (``duplicates``)."""
    return index.join(files, key)


def by_either_key(files: DataFrame, transcripts: DataFrame, first: str, second: str, key: str = "utt_id", text: str = "text") -> DataFrame:
    """files with ``text``: by the first of their keys that has a text, else by the second; null where neither has."""
    known = transcripts.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key).agg(F.min(text).alias("__text"))
    one = known.select(F.col(key).alias("__a"), F.col("__text").alias("__one"))
    two = known.select(F.col(key).alias("__b"), F.col("__text").alias("__two"))
    both = files.join(one, F.col(first) == F.col("__a"), "left").join(two, F.col(second) == F.col("__b"), "left")
    return both.withColumn(text, F.coalesce("__one", "__two")).drop("__a", "__b", "__one", "__two")


def recorded_segments(segments: DataFrame, recordings: DataFrame, on: Iterable[str] = ("split", "subset", "recording")) -> DataFrame:
    """Segments whose recording is there; a recording is looked up once, however many segments it has."""
    return segments.join(recordings.select(*on).distinct(), list(on), "left_semi")


def presence(rows: DataFrame, files: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, n_present, n_absent): rows with and without their recording."""
    marked = rows.join(files.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.groupBy(*by).agg(F.count("__there").alias("n_present"), F.count_if(F.col("__there").isNull()).alias("n_absent"))


def duplicates(files: DataFrame, stem: str) -> DataFrame:
    """(stem, n, surplus) of names that several files share: must be none where the name is the id."""
    return files.groupBy(stem).agg(F.count("*").alias("n")).where("n > 1").withColumn("surplus", F.col("n") - 1)


def require_unique(files: DataFrame, stem: str) -> None:
    found = duplicates(files, stem)
    some = found.orderBy(stem).take(3)
    if some:
        surplus = found.agg(F.sum("surplus")).first()[0]
        raise ValueError(f"{surplus} files share a {stem}, for example {[r[0] for r in some]}")


def summary(rows: DataFrame, by: list[str], speaker: str, amount: str, out: str = "seconds") -> DataFrame:
    """(by, n_utts, n_speakers, amount): rows, distinct speakers and a sum."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_utts"), F.count_distinct(speaker).alias("n_speakers"), F.sum(amount).alias(out))


def shipped_speakers(info: DataFrame, dataset: str = "dataset", speaker: str = "speaker") -> DataFrame:
    """(dataset, n): speakers that a corpus lists for each of its parts; of repeated speakers the last part counts."""
    one = info.groupBy(speaker).agg(F.max(dataset).alias(dataset))
    return one.groupBy(dataset).agg(F.count("*").alias("n"))


def against_published(counts: DataFrame, published: Mapping[str, int], by: str, n: str = "n") -> DataFrame:
    """(by, n, published, as_published) of all names on either side."""
    rows = counts.select(by, F.col(n).alias("n"))
    expected = F.create_map(*[F.lit(x) for p in published.items() for x in p]) if published else F.create_map().cast("map<string,int>")
    listed = F.array(*[F.lit(k) for k in published]) if published else F.array().cast("array<string>")
    missing = rows.groupBy().agg(F.collect_set(by).alias("__have")).select(F.explode(F.array_except(listed, "__have")).alias(by), F.lit(0).cast("long").alias("n"))
    out = rows.unionByName(missing).withColumn("published", F.try_element_at(expected, F.col(by)).cast("long"))
    return out.withColumn("as_published", F.col("n").eqNullSafe(F.col("published")))


def require_published(counts: DataFrame, published: Mapping[str, int], by: str, n: str = "n") -> None:
    odd = against_published(counts, published, by, n).where("not as_published").orderBy(by).take(5)
    if odd:
        raise ValueError(f"counts differ from the published ones: {[tuple(r)[:3] for r in odd]}")


def concatenated(parts: Mapping[str, DataFrame], lang: str = "lang") -> DataFrame:
    """The training sets of several languages as one table, each row with its language."""
    if not parts:
        raise ValueError("no languages to train on")
    return reduce(DataFrame.unionByName, [df.withColumn(lang, F.lit(code)) for code, df in sorted(parts.items())])


def usable(text: Column, path: Column) -> Column:
    """Has a row both a text and a path?"""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.trim(F.coalesce(path, F.lit(""))) != "")
