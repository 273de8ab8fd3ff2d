"""Sharding by jump consistent hashing (operator 5).

A stable key is mapped to a shard by the jump hash: a pseudo-random sequence of jumps seeded by the key, of which the
last below the number of shards counts. There is no ring table, and going from n to n + 1 shards moves a key only to
the new shard, with probability 1 / (n + 1). The jumps of a whole Arrow batch run together: each round advances the
keys that are still below the number of shards, and the expected number of rounds grows with its logarithm.

Slots number the rows of a shard from 0 without gaps. Rows are sorted by range over (shard, key, ...), which also cuts a
large shard into several tasks; each task's rows are counted by shard, and a running sum of those counts (one row a task
and shard) gives each task its first slot. No task needs a whole shard.

Defined results: a null key hashes as a fixed value and so has one shard; a null text has no bytes; equal keys share a
shard; an empty table gives an empty result; rows equal in all columns get different slots in either order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .runtime import Scratch, table, tune

SHARDS = 40
OVERHEAD = 16
NULL_KEY = 0x5BD1E995


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    out, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
    key, at = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64)
    while len(active):
        out[active] = at
        with np.errstate(over="ignore"):
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
        to = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = to < shards
        active, key, at = active[on], key[on], to[on]
    return out


def assign(df: DataFrame, key: str, shards: int, name: str = "shard", grown: str | None = None) -> DataFrame:
    """df with the shard of its integer key (and with the shard if there were one more); columns of these names are replaced."""
    df = df.drop(name, *[grown] * bool(grown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
            mixed = K.mix(column.fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.uint64))
            more = [pa.array(jump(mixed, shards + k), pa.int32()) for k in range(1 + bool(grown))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, name, *[grown] * bool(grown)])

    more = [T.StructField(x, T.IntegerType()) for x in (name, grown) if x]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def number(df: DataFrame, scratch: Scratch, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with each row's place in its group, from 0, by ``order``; no group is gathered in one task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    # Written once: range bounds come from a sample, and counts and slots must see the same cut.
    cut = scratch.keep(tied.repartitionByRange(parts, group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").withColumn("__task", F.spark_partition_id()))
    counts = cut.groupBy(group, "__task").agg(F.count("*").alias("__rows"))
    base = F.coalesce(F.sum("__rows").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = scratch.keep(counts.select(group, "__task", base.alias("__base")))
    within = F.row_number().over(Window.partitionBy(group, "__task").orderBy(*order, "__tie")) - 1
    return cut.withColumn("__in", within).join(first, [group, "__task"]).withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__base", "__in", "__tie", "__task")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    documents = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(sized, "doc_id", SHARDS, grown="grown_shard")
    out = number(placed, Scratch(spark, "op5"), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
