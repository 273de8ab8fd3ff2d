"""Aggregates over the seeds of an experiment: per language, and macro-averages seed by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import primary, primary_kind


def by_language(results: DataFrame, keys: tuple[str, ...] = ("section", "lang"), carried: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample deviation of each metric over seeds (null for one seed), and the primary metric.

    ``results``: (keys, seed, word_boundary, wer, cer). The first seed that has a language fixes its metric, and what else is
    ``carried``, such as the policy that its texts were normalized under; a seed that doesn't name it isn't asked.
    """
    aggregates = []
    for m in ("wer", "cer"):
        aggregates += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"), F.array_sort(F.collect_list(F.when(F.col(m).isNotNull(), F.struct("seed", F.col(m).alias("value"))))).alias(f"{m}_values")]
    kind = F.min_by(primary_kind(F.col("word_boundary")), "seed").alias("kind")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seed"))).alias(c) for c in carried]
    return results.groupBy(*keys).agg(kind, *first, *aggregates)


def primary_values(results: DataFrame, keys: tuple[str, ...] = ("section", "lang")) -> DataFrame:
    """(keys, seed, kind, value): each language's primary metric by seed, under the metric of its first seed; nulls left out."""
    first = F.first(primary_kind(F.col("word_boundary"))).over(Window.partitionBy(*keys).orderBy("seed"))
    picked = results.withColumn("kind", first)
    return picked.select(*keys, "seed", "kind", primary(F.col("kind") == "wer", F.col("wer"), F.col("cer")).alias("value")).where("value is not null")


def macro(values: DataFrame, group: tuple[str, ...] = ("section",), lang: str = "lang", seeds: DataFrame | None = None) -> DataFrame:
    """The macro-average of each group: languages that have every seed, averaged within a seed, then across seeds.

    ``std`` is the spread of the per-seed averages; ``spread_across_languages`` is that of the languages' means, which is
    another quantity. Languages without every seed are named, not averaged.
    """
    wanted = (seeds if seeds is not None else values.select(*group, "seed").distinct()).groupBy(*group).agg(F.countDistinct("seed").alias("__seeds"))
    per_language = values.groupBy(*group, lang).agg(F.countDistinct("seed").alias("__have"), F.avg("value").alias("__mean"), F.first("kind").alias("__kind"))
    # One row a language: small against the values.
    marked = per_language.join(wanted, list(group)).withColumn("__complete", F.col("__have") == F.col("__seeds"))
    complete = marked.where("__complete").select(*group, lang)
    per_seed = values.join(complete, [*group, lang], "left_semi").groupBy(*group, "seed").agg(F.avg("value").alias("macro"))
    across = per_seed.groupBy(*group).agg(F.avg("macro").alias("mean"), F.stddev_samp("macro").alias("std"), F.transform(F.array_sort(F.collect_list(F.struct("seed", "macro"))), lambda x: x["macro"]).alias("per_seed"))
    count = lambda kind: F.count_if(F.col("__complete") & (F.col("__kind") == kind))
    made_of = marked.groupBy(*group).agg(
        F.count_if("__complete").alias("n_languages"),
        count("wer").alias("n_wer"),
        count("cer").alias("n_cer"),
        F.stddev_samp(F.when(F.col("__complete"), F.col("__mean"))).alias("spread_across_languages"),
        F.array_sort(F.collect_set(F.when(~F.col("__complete"), F.col(lang)))).alias("excluded"),
    )
    return made_of.join(across, list(group), "left").withColumn("label", label(F.col("n_wer"), F.col("n_cer")))


def label(n_wer: Column, n_cer: Column) -> Column:
    """What a macro-average must be called, given how many languages are scored on words and on characters."""
    mixed = F.concat(F.lit("mixed (WER×"), n_wer.cast("string"), F.lit(", CER×"), n_cer.cast("string"), F.lit(")"))
    return F.when((n_wer > 0) & (n_cer > 0), mixed).when(n_wer > 0, "WER").when(n_cer > 0, "CER").otherwise("—")


def policy_caption(policies: DataFrame, group: tuple[str, ...] = ("section",), policy: str = "policy") -> DataFrame:
    """(group, caption): named if the languages of a group ran under more than one policy, else empty."""
    used = policies.groupBy(*group).agg(F.array_sort(F.collect_set(policy)).alias("__used"))
    text = F.concat(F.lit("policies differ by language ("), F.array_join("__used", ", "), F.lit(")"))
    return used.select(*group, F.when(F.size("__used") > 1, text).otherwise("").alias("caption"))


def weighted_mean_loss(losses: DataFrame, by: list[str], loss: str = "loss", n: str = "n") -> DataFrame:
    return losses.groupBy(*by).agg((F.sum(F.col(loss) * F.col(n)) / F.greatest(F.lit(1.0), F.sum(n).cast("double"))).alias("mean_loss"))
