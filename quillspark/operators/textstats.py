"""Statistics of transcripts under a policy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import TALLIED, is_ascii, normalize_text, normalized_ascii, normalized_with_counts
from ..functions.policies import Policy
from ..functions.text import has_digits, is_blank, words
from .vocabulary import ANY_LANGUAGE

UNSPACED_MEDIAN = 1.0
UNKNOWN_WARNING = 0.001


def prepared(texts: DataFrame, policy: Policy | str, text: str = "text") -> DataFrame:
    """texts with ``normalized`` and the removal tallies, in one pass through the normalizer."""
    done = texts.withColumn("__n", normalized_with_counts(F.coalesce(F.col(text), F.lit("")), policy))
    return done.withColumn("normalized", F.col("__n.text")).withColumn("counts", F.col("__n.counts")).drop("__n")


def normalized_by_language(rows: DataFrame, policies: dict[str, Policy], lang: str = "lang", text: str = "text", out: str = "normalized") -> DataFrame:
    """rows with their text under the policy of their language, that of ``ANY_LANGUAGE`` for those without one; a language
    that has neither is refused. One pass, whatever the number of policies; ASCII text doesn't leave the JVM."""
    named, value = [c for c in policies if c != ANY_LANGUAGE], F.coalesce(F.col(text), F.lit(""))
    fallback = policies.get(ANY_LANGUAGE)
    if fallback is None:
        unknown = rows.where(~F.coalesce(F.col(lang).isin(named), F.lit(False))).select(lang).distinct().take(3)
        if unknown:
            raise KeyError(f"no policy for {[r[0] for r in unknown]}")

    @F.pandas_udf("string")
    def beyond(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else normalize_text(t, policies.get(c, fallback)) for t, c in zip(texts, codes, strict=True)], index=texts.index)

    by_policy: dict[str, list[str]] = {}
    for code in named:
        by_policy.setdefault(policies[code].digest(), []).append(code)
    plain = F.lit(None).cast("string") if fallback is None else normalized_ascii(value, fallback)
    for codes in by_policy.values():
        plain = F.when(F.col(lang).isin(codes), normalized_ascii(value, policies[codes[0]])).otherwise(plain)
    return rows.withColumn(out, F.when(is_ascii(value), plain).otherwise(beyond(F.when(~is_ascii(value), value), F.col(lang).cast("string"))))


def text_stats(rows: DataFrame, by: list[str], raw: str = "text", normalized: str = "normalized", unknown: str | None = None, counts: str | None = None) -> DataFrame:
    """One row for each group. ``unknown``: number of unknown characters of a row; ``counts``: its removal tally."""
    blank = is_blank(F.col(normalized))
    n_unknown = F.sum(F.when(~blank, F.col(unknown)).otherwise(0)) if unknown else F.lit(0).cast("long")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_utts"),
        F.coalesce(F.sum(F.length(raw)), F.lit(0)).cast("long").alias("n_chars_raw"),
        F.coalesce(F.sum(F.length(normalized)), F.lit(0)).cast("long").alias("n_chars_normalized"),
        F.count_if(has_digits(F.col(raw))).alias("n_utts_with_digits"),
        F.count_if(blank).alias("n_utts_empty_after_norm"),
        F.coalesce(F.median(F.when(~blank, F.size(words(F.col(normalized))))), F.lit(0.0)).alias("median_tokens_per_utt"),
        n_unknown.alias("unk_chars"),
        *([F.sum(f"{counts}.{k}").alias(f"removed_{k}") for k in TALLIED] + [F.sum(f"{counts}.case_changed").alias("case_changed_chars")] if counts else []),
    )
    return out.withColumns({
        "unk_rate": F.when(F.col("n_chars_normalized") > 0, F.col("unk_chars") / F.col("n_chars_normalized")).otherwise(0.0),
        "looks_unspaced": (F.col("n_utts") > 0) & (F.col("median_tokens_per_utt") <= UNSPACED_MEDIAN),
    })


def unknown_characters(rows: DataFrame, vocabulary: DataFrame, text: str = "normalized", out: str = "unknown") -> DataFrame:
    """rows with the number of characters of ``text`` outside the vocabulary (char, id).

    A character inventory is small by nature (the code points of a script); it travels as one string, and what is left of
    a text without them is counted.
    """
    inventory = vocabulary.where(F.length("char") == 1).agg(F.array_join(F.collect_set("char"), "").alias("__known"))
    left = F.call_function("translate", F.coalesce(F.col(text), F.lit("")), F.col("__known"), F.lit(""))
    return rows.crossJoin(F.broadcast(inventory)).withColumn(out, F.length(left).cast("long")).drop("__known")


def warn_unknown(stats: DataFrame, threshold: float = UNKNOWN_WARNING) -> DataFrame:
    return stats.where(F.col("unk_rate") > threshold)
