"""Comparison of two runs over the same utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import edit_counts, long_form, rate


def paired_runs(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows of both runs with the same keys; what only one has is left out."""
    renamed = lambda df, side: df.select(*on, *[F.col(v).alias(f"{v}_{side}") for v in values])
    return renamed(a, "a").join(renamed(b, "b"), on)


def first_differences(a: DataFrame, b: DataFrame, by: list[str], position: str = "pos", ref: str = "ref") -> DataFrame:
    """(by, position): the first place at which references of shared groups differ or one is missing. Must be empty."""
    shared = a.select(*by).distinct().intersect(b.select(*by).distinct())
    left = a.join(shared, by, "left_semi").select(*by, position, F.col(ref).alias("ref_a"), F.lit(True).alias("in_a"))
    right = b.join(shared, by, "left_semi").select(*by, position, F.col(ref).alias("ref_b"), F.lit(True).alias("in_b"))
    both = left.join(right, [*by, position], "full_outer")
    differs = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("ref_a").eqNullSafe(F.col("ref_b"))
    return both.where(differs).groupBy(*by).agg(F.min(position).alias(position))


def policy_mismatches(a: DataFrame, b: DataFrame, lang: str = "lang", policy: str = "policy") -> DataFrame:
    """Shared languages that the runs normalized under different policies."""
    return paired_runs(a, b, [lang], [policy]).where(F.col(f"{policy}_a") != F.col(f"{policy}_b"))


def require_same_policies(a: DataFrame, b: DataFrame, lang: str = "lang", policy: str = "policy") -> None:
    if a.isEmpty() or b.isEmpty():
        raise ValueError("a run without recorded policies can't be compared")
    found = policy_mismatches(a, b, lang, policy).take(5)
    if found:
        raise ValueError(f"policies differ: {[tuple(r) for r in found]}")


def paired_edits(a: DataFrame, b: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """(by, metric, position, len, edits_a, edits_b) of utterances that both runs have; refuses different references."""
    found = first_differences(a, b, by, position).take(1)
    if found:
        raise ValueError(f"the runs scored different references: first at {tuple(found[0])}")
    counted = lambda df: long_form(edit_counts(df), [*by, position])
    left, right = counted(a).withColumnRenamed("edits", "edits_a"), counted(b).drop("len").withColumnRenamed("edits", "edits_b")
    return left.join(right, [*by, "metric", position])


def deltas(paired: DataFrame, by: list[str]) -> DataFrame:
    """(by, point_a, point_b, delta, n)."""
    out = paired.groupBy(*by).agg(rate(F.col("edits_a"), F.col("len")).alias("point_a"), rate(F.col("edits_b"), F.col("len")).alias("point_b"), F.count("*").alias("n"))
    return out.withColumn("delta", F.col("point_a") - F.col("point_b"))
