"""From frame scores to error rates in one plan.

The best symbol of each frame up to the row's own length, repeats collapsed, ids to characters, the result normalized under
the policy of its language; the reference is the corpus's own text under the same policy, never a round trip through ids.
Rows whose reference is blank are counted and not scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policies import Policy
from .scoring import edit_counts, error_rates, primary, primary_kind, scoreable, scoreable_counts
from .textstats import normalized_by_language
from .vocabulary import decode, greedy


def hypotheses(frames: DataFrame, vocabulary: DataFrame, policies: dict[str, Policy], lang: str = "lang", scores: str = "scores", length: str = "length") -> DataFrame:
    """frames with ``hyp``; a row without frames has the empty one."""
    best = frames.withColumn("__ids", greedy(F.col(scores), F.greatest(F.col(length), F.lit(0))))
    decoded = decode(best, vocabulary, "__ids", "__decoded").withColumn("__decoded", F.coalesce("__decoded", F.lit("")))
    return normalized_by_language(decoded, policies, lang, "__decoded", "hyp").drop("__ids", "__decoded", scores, length)


def pairs(frames: DataFrame, vocabulary: DataFrame, policies: dict[str, Policy], lang: str = "lang", text: str = "text") -> DataFrame:
    """frames with ``ref`` and ``hyp`` under the policy of their language."""
    return normalized_by_language(hypotheses(frames, vocabulary, policies, lang), policies, lang, text, "ref").drop(text)


def rates(scored: DataFrame, by: list[str], boundaries: DataFrame | None = None, lang: str = "lang") -> DataFrame:
    """(by, n, n_empty_refs, wer, cer, primary_metric, primary) of pairs; refuses a group of nothing but blank references.

    ``boundaries``: (lang, word_boundary), a row a language; words count where it says nothing."""
    counts = scoreable_counts(scored, by)
    refused = counts.where("refused").take(3)
    if refused:
        raise ValueError(f"every reference is blank: {[tuple(r)[: len(by)] for r in refused]}")
    out = error_rates(edit_counts(scoreable(scored)), by).join(counts.select(*by, "n_empty_refs"), by)
    out = out.join(boundaries.select(lang, "word_boundary"), lang, "left") if boundaries is not None else out.withColumn("word_boundary", F.lit(None).cast("boolean"))
    spaced = F.col("word_boundary")
    return out.select(*by, "n", "n_empty_refs", "wer", "cer", primary_kind(spaced).alias("primary_metric"), primary(spaced, F.col("wer"), F.col("cer")).alias("primary"))


def evaluate(frames: DataFrame, vocabulary: DataFrame, policies: dict[str, Policy], by: list[str], boundaries: DataFrame | None = None, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, rates) of frames (by, position, text, scores array<array<double>>, length): what sidecars and results hold."""
    scored = pairs(frames, vocabulary, policies, lang, text)
    return scored, rates(scored, by, boundaries, lang)
