"""Rows into batches: labels, filters, padded lengths, and which batch each row is in.

A batch is a run of rows in length order, so a row's batch follows from its rank (``ranking``) and no task holds a language.
Batches of a fixed number of rows are runs of that many; batches under a budget of frames are runs within a class of similar
lengths, of as many rows as the budget takes of the longest that the class allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import Policy
from ..functions.text import is_blank
from .frames import GUARD_SAMPLES, alignment
from .ranking import ranked
from .textstats import normalized_by_language
from .vocabulary import encode

#: What labels are padded with; a model takes their lengths from it.
IGNORED = -100
#: Lengths of one class differ by this factor at most.
RATIO = 1.25


def collated(rows: DataFrame, vocabulary: DataFrame, policies: dict[str, Policy], lang: str = "lang", text: str = "text", samples: str = "samples", drop_overlong: bool = False, drop_empty: bool = False, guard: int | None = GUARD_SAMPLES) -> DataFrame:
    """rows with ``normalized``, ``labels`` (ids), ``n_labels``, ``disposition`` and what becomes of them: ``kept`` tells whether
    they are in their batch. Texts are normalized under the policy of their language, then encoded.

    Training drops rows that don't fit their frames or have no text; evaluation keeps them all, as a smaller test set is
    another one. ``guard``: the number of samples from which on a recording counts as cut; None for evaluation.
    """
    done = alignment(encode(normalized_by_language(rows, policies, lang, text), vocabulary, "normalized", "labels"), "normalized", samples)
    blank, over = is_blank(F.col("normalized")), F.size("labels") > F.col("frames")
    kept = ~((blank & F.lit(drop_empty)) | (over & F.lit(drop_overlong)))
    dropped = over & F.lit(drop_overlong) & ~(blank & F.lit(drop_empty))
    cut = F.lit(False) if guard is None else F.col(samples) >= guard
    return done.withColumns({"n_labels": F.size("labels"), "kept": kept, "blank": blank, "dropped": dropped, "at_guard": cut})


def batches(rows: DataFrame, size: int, by: list[str], samples: str = "samples", position: str = "pos") -> DataFrame:
    """rows with ``batch``, from 0 in each group: so many rows, longest first, ties by position."""
    out = ranked(rows, by, [F.desc(samples), F.asc(position)], "__rank")
    return out.withColumn("batch", F.expr(f"(__rank - 1) div {int(size)}")).drop("__rank")


def length_class(length: Column, ratio: float = RATIO) -> Column:
    """The number of the class of a length: class k holds lengths above ratio ** (k - 1) up to ratio ** k."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length.cast("double"), F.lit(1.0))) / F.lit(math.log(ratio)) - F.lit(1e-9))).cast("long")


def capacity(number: Column, budget: int, ratio: float = RATIO) -> Column:
    """Rows of a class that a budget takes, each padded to the class's longest; one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(float(budget)) / F.pow(F.lit(ratio), number.cast("double")))).cast("long")


def budgeted(rows: DataFrame, budget: int, by: list[str], length: str = "frames", position: str = "pos", ratio: float = RATIO) -> DataFrame:
    """rows with ``class`` and ``batch``, from 0 in each group and class: padded to its longest row, a batch has at most
    ``budget`` frames, unless it is one row."""
    classed = rows.withColumn("class", length_class(F.col(length), ratio))
    out = ranked(classed, [*by, "class"], [F.desc(length), F.asc(position)], "__rank")
    return out.withColumn("batch", F.floor((F.col("__rank") - 1) / capacity(F.col("class"), budget, ratio))).drop("__rank")


def batch_summary(rows: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """(by, batch, n, n_dropped, n_empty_text, n_at_audio_guard, padded_samples, padded_labels) of collated rows in batches."""
    kept = lambda c: F.when(F.col("kept"), F.col(c))
    return rows.groupBy(*by, "batch").agg(
        F.count_if("kept").alias("n"),
        F.count_if("dropped").alias("n_dropped"),
        F.count_if("blank").alias("n_empty_text"),
        F.count_if("at_guard").alias("n_at_audio_guard"),
        F.coalesce(F.max(kept(samples)), F.lit(0).cast("long")).alias("padded_samples"),
        F.greatest(F.lit(1), F.coalesce(F.max(kept("n_labels")), F.lit(1))).cast("long").alias("padded_labels"),
    )


def padded(labels: Column, length: Column) -> Column:
    """Labels of one row, filled up to the batch's length."""
    return F.concat(labels, F.array_repeat(F.lit(IGNORED), (length - F.size(labels)).cast("int")))
