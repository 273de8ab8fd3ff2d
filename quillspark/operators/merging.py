"""Merging of models as grouped aggregates over (expert, key, idx, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import keep

HEAD = ("ctc_proj.", "ctc_norm.")


def is_head(key: Column) -> Column:
    return F.startswith(key, F.lit(HEAD[0])) | F.startswith(key, F.lit(HEAD[1]))


def mergeable(experts: DataFrame, head: bool = True) -> DataFrame:
    """Entries of keys that every expert has (without the head's, if it isn't merged)."""
    n = experts.select(F.count_distinct("expert").alias("__n"))
    common = experts.groupBy("key").agg(F.count_distinct("expert").alias("__have")).crossJoin(F.broadcast(n)).where("__have = __n").select("key")
    rows = experts.join(common, "key", "left_semi")
    return rows if head else rows.where(~is_head(F.col("key")))


def average(experts: DataFrame) -> DataFrame:
    """(key, idx, value): elementwise mean."""
    return experts.groupBy("key", "idx").agg(F.avg("value").alias("value"))


def task_vectors(experts: DataFrame, base: DataFrame) -> DataFrame:
    """(expert, key, idx, value): expert less base."""
    return experts.join(base.select("key", "idx", F.col("value").alias("__base")), ["key", "idx"]).select("expert", "key", "idx", (F.col("value") - F.col("__base")).alias("value"))


#: Bits of a value that one pass of the selection decides, and entries among which a window may decide the rest.
DIGIT, FEW = 16, 1 << 16
_LARGEST = (1 << 63) - 1


def magnitudes(vectors: DataFrame) -> DataFrame:
    """vectors with ``__bits``, the bits of |value| as a whole number, which has the same order (not a number comes last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(names.index("value")).to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.abs(values).view(np.int64))], [*names, "__bits"])

    names = vectors.columns
    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("__bits", T.LongType())]))


def first_of_each(rows: DataFrame, by: list[str], high: str, low: str, wanted: Column, few: int = FEW) -> DataFrame:
    """The ``wanted`` (of ``__n``, the group's rows) rows of each group that are largest by ``high``, then least by ``low``,
    both whole numbers from 0 on.

    A selection by radix passes: a pass counts, for each group, the next digit of the rows that agree with all digits found
    so far (partial sums, 65,536 a group at most), and the digit at which the count reaches what is wanted is the next one
    found. Rows above it are in, rows below it out. It ends when at most ``few`` rows of each group are undecided, which a
    window orders. So no group is sorted, and no task holds one, however large it is or however many of its values are equal.
    """
    rows = keep(rows.withColumn("__low", F.lit(_LARGEST) - F.col(low)), "select")
    zero = F.lit(0).cast("long")
    cut = rows.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__need", wanted.cast("long")).withColumn("__left", F.col("__n"))
    cut = keep(cut.withColumns({"__high_cut": zero, "__low_cut": zero}), "select")
    keys = [(F.col(high), "__high_cut"), (F.col("__low"), "__low_cut")]
    compared = [(key, cut_, shift) for key, cut_ in keys for shift in range(64 - DIGIT, -1, -DIGIT)]
    done = 0
    for key, found, shift in compared:
        if cut.where((F.col("__left") > few) & (F.col("__left") > F.col("__need"))).isEmpty():
            break
        digit = F.shiftright(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = rows.join(cut, by).where(_prefix(compared[:done], "=")).groupBy(*by, digit.alias("__digit")).agg(F.count("*").alias("__count"))
        above = F.sum("__count").over(Window.partitionBy(*by).orderBy(F.desc("__digit")).rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("__above", F.coalesce(above, zero)).join(cut.drop("__left"), by)
        here = counts.where((F.col("__above") < F.col("__need")) & (F.col("__need") <= F.col("__above") + F.col("__count")))
        state = {"__need": F.col("__need") - F.col("__above"), "__left": F.col("__count"), found: F.col(found).bitwiseOR(F.shiftleft(F.col("__digit"), shift))}
        cut = keep(here.withColumns(state).select(cut.columns), "select")
        done += 1
    joined = rows.join(cut, by)
    kept = rows.columns
    sure = joined.where(_prefix(compared[:done], ">")).select(kept)
    edge = joined.where(_prefix(compared[:done], "="))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(high), F.desc("__low")))
    whole = edge.where(F.col("__left") <= F.col("__need")).select(kept)
    part = edge.where(F.col("__left") > F.col("__need")).withColumn("__place", place).where("__place <= __need").select(kept)
    return sure.unionByName(whole).unionByName(part).drop("__low")


def _prefix(passes: list[tuple[Column, str, int]], how: str) -> Column:
    """Is a row, by the digits of these passes, equal to its group's cut, or above it?"""
    equal, above = F.lit(True), F.lit(False)
    last = {found: (key, shift) for key, found, shift in passes}  # the passes over one number refine each other
    for found, (key, shift) in last.items():
        own, edge = F.shiftright(key, shift), F.shiftright(F.col(found), shift)
        above = above | (equal & (own > edge))
        equal = equal & (own == edge)
    return equal if how == "=" else above


def trim(vectors: DataFrame, density: float, few: int = FEW) -> DataFrame:
    """The max(1, int(n * density)) entries of largest magnitude of each expert and key; ties by position, so never more."""
    if density >= 1.0:
        return vectors
    wanted = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(density)))
    return first_of_each(magnitudes(vectors), ["expert", "key"], "__bits", "idx", wanted, few).select(vectors.columns)


def elect(vectors: DataFrame) -> DataFrame:
    """(key, idx, value): the sign of the sum is elected, and entries of that sign are averaged."""
    total = F.sum("value").over(Window.partitionBy("key", "idx"))
    agrees = (F.signum("value") == F.signum("__total")) & (F.col("value") != 0)
    return vectors.withColumn("__total", total).groupBy("key", "idx").agg((F.coalesce(F.sum(F.when(agrees, F.col("value"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(agrees))).alias("value"))


def _added(base: DataFrame, merged: DataFrame, keys: DataFrame) -> DataFrame:
    whole = base.join(keys, ["key", "idx"], "left_semi").select("key", "idx", F.col("value").alias("__base"))
    return whole.join(merged, ["key", "idx"], "left").select("key", "idx", (F.col("__base") + F.coalesce("value", F.lit(0.0))).alias("value"))


def ties(experts: DataFrame, base: DataFrame, density: float = 0.2) -> DataFrame:
    """(key, idx, value): trim, elect, average, add to the base."""
    return _added(base, elect(trim(task_vectors(experts, base), density)), experts.select("key", "idx").distinct())


def kept_by_hash(seed: int, drop: float) -> Column:
    """A draw for each entry that depends on seed, expert, key and position alone."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("expert").cast("string"), F.col("key").cast("string"), F.col("idx").cast("string"))
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) >= drop


def dare_ties(experts: DataFrame, base: DataFrame, density: float = 0.2, drop: float = 0.5, seed: int = 0) -> DataFrame:
    """Entries of the task vectors are dropped at random and the rest scaled up, then as ``ties``."""
    vectors = task_vectors(experts, base).withColumn("value", F.when(kept_by_hash(seed, drop), F.col("value") / F.lit(1.0 - drop)).otherwise(0.0))
    return _added(base, elect(trim(vectors, density)), experts.select("key", "idx").distinct())


def disagreeing(entries: DataFrame) -> DataFrame:
    """Keys of entries that aren't numbers (expert, key, value) on which experts disagree: must be none."""
    return entries.groupBy("key").agg(F.count_distinct("value").alias("n")).where("n > 1")


def with_head_of(merged: DataFrame, base: DataFrame) -> DataFrame:
    """The merged body with the base's head."""
    return merged.where(~is_head(F.col("key"))).unionByName(base.where(is_head(F.col("key"))).select("key", "idx", "value"))


STRATEGIES = {"average": lambda experts, base, **o: average(experts), "ties": ties, "dare_ties": dare_ties}


def merge(name: str, experts: DataFrame, base: DataFrame | None = None, merge_head: bool = True, **options: float) -> DataFrame:
    if name not in STRATEGIES:
        raise KeyError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    if name != "average" and base is None:
        raise ValueError(f"{name} needs a base")
    rows = mergeable(experts, merge_head)
    out = STRATEGIES[name](rows, base, **options)
    return out if merge_head or base is None else with_head_of(out, base)


def worst_delta(a: DataFrame, b: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """(by, delta): the largest absolute difference; null where a position is missing on one side."""
    both = a.select(*by, *on, F.col("value").alias("__a")).join(b.select(*by, *on, F.col("value").alias("__b")), [*by, *on], "full_outer")
    gap = F.bool_or(F.col("__a").isNull() | F.col("__b").isNull())
    return both.groupBy(*by).agg(F.when(~gap, F.max(F.abs(F.col("__a") - F.col("__b")))).alias("delta"))
