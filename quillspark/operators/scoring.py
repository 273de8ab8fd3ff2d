"""Word and character error rates.

Edits and reference lengths stay integers up to the last division, so a rate doesn't depend on the order of its rows. A
rate is a ratio of sums, never a mean of ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import char_edits, word_edits
from ..functions.text import is_blank, words

METRICS = ("wer", "cer")


def edit_counts(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with word_edits, word_len, char_edits, char_len."""
    r, h = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    return pairs.withColumns({"word_edits": word_edits(r, h), "word_len": F.size(words(r)).cast("long"), "char_edits": char_edits(r, h), "char_len": F.length(r).cast("long")})


def rate(edits: Column, length: Column) -> Column:
    """100 * sum of edits / sum of lengths, the latter at least 1."""
    return 100.0 * F.sum(edits) / F.greatest(F.lit(1.0), F.sum(length).cast("double"))


def error_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, wer, cer) from pairs with edit counts."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("word_edits"), F.col("word_len")).alias("wer"), rate(F.col("char_edits"), F.col("char_len")).alias("cer"))


def long_form(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each pair and metric: (keep, metric, edits, len)."""
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{k}_edits").alias("edits"), F.col(f"{k}_len").alias("len")) for m, k in (("wer", "word"), ("cer", "char"))])
    return pairs.select(*keep, F.inline(both))


def scoreable(pairs: DataFrame, ref: str = "ref") -> DataFrame:
    return pairs.where(~is_blank(F.col(ref)))


def scoreable_counts(pairs: DataFrame, by: list[str], ref: str = "ref") -> DataFrame:
    """(by, n_scored, n_empty_refs); a group of nothing but blank references can't be scored (``refused``)."""
    counted = pairs.groupBy(*by).agg(F.count_if(~is_blank(F.col(ref))).alias("n_scored"), F.count_if(is_blank(F.col(ref))).alias("n_empty_refs"))
    return counted.withColumn("refused", F.col("n_scored") == 0)


def primary(word_boundary: Column, wer: Column, cer: Column) -> Column:
    """Words where they are delimited (the default), else characters."""
    return F.when(F.coalesce(word_boundary, F.lit(True)), wer).otherwise(cer)


def primary_kind(word_boundary: Column) -> Column:
    return F.when(F.coalesce(word_boundary, F.lit(True)), F.lit("wer")).otherwise(F.lit("cer"))


def is_primary(word_boundary: Column, metric: Column) -> Column:
    return F.coalesce(word_boundary, F.lit(True)) == (metric == "wer")


def boundary_contradiction(word_boundary: Column, unspaced: Column) -> Column:
    """Transcripts look unspaced where words are declared, or the other way round; null if they agree."""
    return F.when(word_boundary & unspaced, F.lit("declared spaced, looks unspaced")).when(~word_boundary & ~unspaced, F.lit("declared unspaced, looks spaced"))
