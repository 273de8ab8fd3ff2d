"""Frames, alignment filters, and sequences of losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import frame_budget, is_blank
from .ranking import ranked

GUARD_SAMPLES = 200_000


def collapse_frames(frames: DataFrame, by: list[str], order: list[str], symbol: str, blank: Column) -> DataFrame:
    """Frames that differ from the one before them and aren't blank."""
    before = F.lag(symbol).over(Window.partitionBy(*by).orderBy(*order))
    marked = frames.withColumn("__before", before)
    return marked.where(~F.col(symbol).eqNullSafe(F.col("__before")) & ~blank).drop("__before")


def alignment(rows: DataFrame, normalized: str, samples: str) -> DataFrame:
    """rows with what training does to them: blank, unalignable or usable, and whether the length guard cuts them."""
    budget = frame_budget(F.col(samples))
    what = F.when(is_blank(F.col(normalized)), "blank").when(F.length(normalized) > budget, "unalignable").otherwise("usable")
    return rows.withColumns({"frames": budget, "disposition": what, "at_guard": F.col(samples) >= GUARD_SAMPLES})


def training_record(marked: DataFrame, by: list[str]) -> DataFrame:
    count = lambda x: F.count_if(F.col("disposition") == x)
    return marked.groupBy(*by).agg(count("blank").alias("dropped_blank"), count("unalignable").alias("dropped_unalignable"), F.count_if("at_guard").alias("at_guard"), count("usable").alias("usable"))


def best_checkpoints(losses: DataFrame, by: list[str], order: list[str], loss: str, patience: int) -> DataFrame:
    """(by, best_step, best_loss, stop_step): first strictly least finite loss up to the stop, and the first step at which
    ``patience`` steps have gone by without a new one (null if none)."""
    own = Window.partitionBy(*by).orderBy(*order)
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    finite = F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) != float("inf"))
    best_before = F.min(F.when(finite, F.col(loss))).over(past)
    steps = losses.withColumn("__step", F.row_number().over(own)).withColumn("__before", best_before)
    steps = steps.withColumn("__better", finite & (F.col("__before").isNull() | (F.col(loss) < F.col("__before"))))
    last = F.coalesce(F.last(F.when(F.col("__better"), F.col("__step")), ignorenulls=True).over(own), F.lit(0))
    steps = steps.withColumn("__since", F.col("__step") - last)
    steps = steps.withColumn("__stop", F.min(F.when(F.col("__since") >= patience, F.col("__step"))).over(Window.partitionBy(*by)))
    seen = steps.where(F.col("__stop").isNull() | (F.col("__step") <= F.col("__stop")))
    return seen.groupBy(*by).agg(F.max(F.when(F.col("__better"), F.col("__step"))).alias("best_step"), F.min(F.when(F.col("__better"), F.col(loss))).alias("best_loss"), F.first("__stop").alias("stop_step"))


def by_length(rows: DataFrame, length: str, position: str, by: list[str] | None = None) -> DataFrame:
    """rows with ``rank``: longest first, ties by position. ``position`` restores the order."""
    return ranked(rows, by or [], [F.desc(length), F.asc(position)])
