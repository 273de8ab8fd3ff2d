"""Hours of audio by language and split, from published or measured seconds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_durations(rows: DataFrame, durations: DataFrame, by: list[str], key: str, seconds: str = "seconds") -> DataFrame:
    """(by, n_utts, seconds, n_missing): rows without a duration are counted, not guessed."""
    known = durations.groupBy(key).agg(F.max(seconds).alias("__seconds")) if durations is not None else None
    joined = rows.join(known, key, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n_utts"), F.coalesce(F.sum("__seconds"), F.lit(0.0)).alias("seconds"), F.count_if(F.col("__seconds").isNull()).alias("n_missing"))


def hours(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, total_hours, train_hours)."""
    return parts.groupBy(*by).agg((F.sum("seconds") / 3600.0).alias("total_hours"), (F.sum(F.when(F.col("split") == "train", F.col("seconds")).otherwise(0.0)) / 3600.0).alias("train_hours"))


def below(train_hours: Column, least: Column | float) -> Column:
    """Under the threshold; a threshold of 0 is none."""
    least = F.lit(least) if isinstance(least, int | float) else least
    return (least != 0) & (train_hours < least)


def sweep(spark: SparkSession, languages: Iterable[str], measure: Callable[[str], DataFrame], schema: str = "split string, n_utts long, seconds double, n_missing long") -> DataFrame:
    """(lang, split, ..., error): a language that can't be read gives a row with its error and doesn't stop the others.

    Each language is measured by itself, a few aggregated rows, so that a file which fails while it is read shows here."""
    rows, names = [], [x.split()[0] for x in schema.split(", ")]
    for code in languages:
        try:
            rows += [(code, *[r[c] for c in names], None) for r in measure(code).select(*names).collect()]
        except Exception as e:
            rows.append((code, *[None] * len(names), f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, f"lang string, {schema}, error string")


def bucket_hours(locales: DataFrame) -> DataFrame:
    """(locale, train_hours, dev_hours, test_hours, validated_hours, trainable_hours) from clip counts and a mean length."""
    part = lambda name: (F.coalesce(F.col(name), F.lit(0)) * F.coalesce(F.col("avg_secs"), F.lit(0.0)) / 3600.0).alias(f"{name}_hours")
    out = locales.select("locale", part("train"), part("dev"), part("test"), F.coalesce("valid_hours", F.lit(0.0)).alias("validated_hours"))
    return out.withColumn("trainable_hours", F.greatest(F.lit(0.0), F.col("validated_hours") - F.col("dev_hours") - F.col("test_hours")))


def corpus_hours(corpora: DataFrame, share: float = 0.1) -> DataFrame:
    """(locale, corpus, dev_hours, test_hours, trainable_hours) of each language of a corpus.

    Published dev and test hours stand; else the corpus is priced at its total less the shares that will be derived.
    """
    published = F.col("dev_hours").isNotNull() & F.col("test_hours").isNotNull() & F.col("train_hours").isNotNull()
    total = F.when(F.coalesce(F.col("total_hours"), F.lit(0.0)) != 0, F.col("total_hours")).otherwise(F.coalesce("train_hours", F.lit(0.0)))
    part = total * F.lit(share)
    return corpora.select(
        F.explode("languages").alias("locale"),
        F.col("id").alias("corpus"),
        F.when(published, F.col("dev_hours")).otherwise(part).alias("dev_hours"),
        F.when(published, F.col("test_hours")).otherwise(part).alias("test_hours"),
        F.when(published, F.col("train_hours")).otherwise(total - part - part).alias("trainable_hours"),
    )
