"""Places of rows in the order of their group, without a group in one task.

Rows are range-partitioned by group and order, so a large group lies in many tasks and small ones share a task. Each task
numbers its rows; what a row's place lacks is the number of its group's rows in earlier tasks, a running sum over one row
for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import keep

#: Bits of ``monotonically_increasing_id`` that number the rows of a task; the rest is the task.
_ROW_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """rows with their place from 1 in ``order`` among those of the same ``by`` (nulls are a group too). The order must tell
    rows apart where it matters which comes first; rows that it doesn't are numbered in some order. The rows are read twice,
    as their ranges are sampled first: what is dear to make should be written before."""
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    placed = keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "rank")
    placed = placed.withColumn("__task", F.shiftright("__at", _ROW_BITS))
    runs = placed.groupBy(*by, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(own.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift")
    starts = runs.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__task").alias("__of"), shift)
    same = F.col("__task") == F.col("__of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    return placed.join(starts, same).withColumn(out, F.col("__at") + F.col("__shift")).select(*rows.columns, out)
