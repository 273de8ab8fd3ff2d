"""Train, validation and test parts that share no speaker.

Rows are grouped by speaker if every row has one and there are three or more, else by row. Groups are taken in the order
of their keys' SHA-1; each goes to the part that is furthest below its share.

Groups of several rows are folded one after the other, as the next choice depends on all earlier ones; the fold streams over
(group, size), sorted, and holds the two least groups of each part, so its memory doesn't grow with the corpus. Where every
group is one row, as it is without speakers, no fold is needed: the choices are known beforehand (``part_by_rank``), and
each row needs but its rank, which many tasks find together.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import ranked

PARTS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
LEAST_GROUPS = 3
#: From so many groups of one row on, no part is empty after the first pass: the last two of seven go to validation and test.
LEAST_EVEN = 7


class Fold:
    """The part of each group of a corpus; groups come in their order. The two least groups of each part are held back, as
    those that the filling of empty parts may still move."""

    def __init__(self, total: int) -> None:
        self.room = [share * total for share in SHARES]
        self.held, self.counts = [0, 0, 0], [0, 0, 0]
        self.least: list[list[tuple[int, str]]] = [[], [], []]

    def add(self, key: str, size: int) -> list[tuple[str, str]]:
        """Groups whose part is settled now."""
        short = [self.room[k] - self.held[k] for k in range(3)]
        best = short.index(max(short))  # the earlier part of equals
        self.held[best] += size
        self.counts[best] += 1
        bisect.insort(self.least[best], (size, key))
        return [(self.least[best].pop()[1], PARTS[best])] if len(self.least[best]) > 2 else []

    def finish(self) -> list[tuple[str, str]]:
        """The rest, after empty parts have got the least group of the part that has most."""
        if sum(self.counts) >= LEAST_GROUPS:
            for empty in range(3):
                if self.counts[empty]:
                    continue
                donor = self.counts.index(max(self.counts))
                if self.counts[donor] < 2:
                    break
                self.least[empty].append(self.least[donor].pop(0))
                self.counts[donor], self.counts[empty] = self.counts[donor] - 1, 1
        return [(key, PARTS[k]) for k in range(3) for _, key in self.least[k]]


def assign(keys: list[str], sizes: list[int]) -> list[str]:
    """The part of each group; groups come in their order."""
    fold, found = Fold(sum(sizes)), {}
    for key, size in zip(keys, sizes, strict=True):
        found |= dict(fold.add(key, size))
    found |= dict(fold.finish())
    return [found[key] for key in keys]


def part_by_rank(rank: Column, total: Column) -> Column:
    """The part of the group with this rank (from 1) of ``total`` groups of one row.

    Train takes rows until it is no longer further below its share than the others; what is left over is then less than
    one row apart, so from there on validation, test and train take turns. Differences of a share's total and a whole number
    below it are exact in doubles, so the comparison that ends the first stretch is the fold's own.
    """
    train, rest = F.lit(SHARES[0]) * total, F.lit(SHARES[1]) * total
    first = F.greatest(F.floor(train - rest), F.lit(1)) - 1  # at most the number that train takes first, and two below it at least
    for _ in range(3):
        first = F.when(train - first >= rest, first + 1).otherwise(first)
    turn = F.pmod(rank - 1 - first, F.lit(3))
    return F.when(rank <= first, PARTS[0]).when(turn == 0, PARTS[1]).when(turn == 1, PARTS[2]).otherwise(PARTS[0])


def _folded(groups: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, group_key, split) from (scope, group_key, size, total): a stream through each scope's groups in their order."""
    fields = [groups.schema[c] for c in scope] + [T.StructField("group_key", T.StringType()), T.StructField("split", T.StringType())]
    n = len(scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None
        fold = Fold(0)
        kinds = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=True)], *[pa.array(c, pa.string()) for c in columns[n:]]], [f.name for f in fields])

        for batch in batches:
            kinds = [batch.column(k).type for k in range(n)]
            for *own, key, size, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (own := tuple(own)) != last:
                    held += [(*last, *x) for x in fold.finish()] if last is not None else []
                    last, fold = own, Fold(total)
                held += [(*own, *x) for x in fold.add(key, size)]
            if len(held) >= 10_000:
                yield out()
        held += [(*last, *x) for x in fold.finish()] if last is not None else []
        if held:
            yield out()

    order = groups.select(*scope, "group_key", "size", "total").repartition(*scope).sortWithinPartitions(*scope, F.sha1(F.col("group_key").cast("binary")))
    return order.mapInArrow(run, T.StructType(fields))


def grouping(rows: DataFrame, scope: list[str], speaker: Column, identity: Column) -> DataFrame:
    """rows with ``group_key`` and ``split_policy`` ("speaker" or "utterance")."""
    keyed = rows.withColumn("__speaker", speaker.cast("string")).withColumn("__identity", identity.cast("string"))
    policy = keyed.groupBy(*scope).agg(F.when((F.count_if(F.col("__speaker").isNull()) == 0) & (F.count_distinct("__speaker") >= LEAST_GROUPS), "speaker").otherwise("utterance").alias("split_policy"))
    joined = keyed.join(policy, scope)
    return joined.withColumn("group_key", F.when(F.col("split_policy") == "speaker", F.col("__speaker")).otherwise(F.col("__identity"))).drop("__speaker", "__identity")


def derive(rows: DataFrame, scope: list[str], speaker: Column, identity: Column) -> DataFrame:
    """rows with ``split_policy`` and ``split``."""
    keyed = grouping(rows, scope, speaker, identity)
    sizes = keyed.groupBy(*scope, "group_key").agg(F.count("*").alias("size"))
    totals = sizes.groupBy(*scope).agg(F.sum("size").alias("total"), ((F.max("size") == 1) & (F.count("*") >= LEAST_EVEN)).alias("even"))
    sized = sizes.join(totals, scope)
    even = ranked(sized.where("even").select(*scope, "group_key", "total"), scope, [F.sha1(F.col("group_key").cast("binary")).asc()])
    even = even.select(*scope, "group_key", part_by_rank(F.col("rank"), F.col("total")).alias("split"))
    parts = even.unionByName(_folded(sized.where(~F.col("even")), scope))
    return keyed.join(parts, [*scope, "group_key"]).drop("group_key")


def test_digests(parted: DataFrame, scope: list[str], identity: str) -> DataFrame:
    """(scope, test_sha1): digest of the sorted ids of the test part, one to a line. The ids of a scope stream through its
    task in order, so only the state of the digest is held."""
    n, names = len(scope), [*scope, "test_sha1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, kinds = None, None, None
        of = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], k) for x, k in zip(last, kinds, strict=True)], pa.array([digest.hexdigest()])], names)
        for batch in batches:
            kinds = [batch.column(k).type for k in range(n)]
            for *own, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (own := tuple(own)) == last:
                    digest.update(b"\n")
                else:
                    if last is not None:
                        yield of()
                    last, digest = own, hashlib.sha1()
                digest.update(key.encode())
        if last is not None:
            yield of()

    ids = parted.where(F.col("split") == "test").select(*scope, F.col(identity).cast("string").alias("__id")).where("__id is not null")
    digests = ids.repartition(*scope).sortWithinPartitions(*scope, "__id").mapInArrow(run, T.StructType([*[parted.schema[c] for c in scope], T.StructField("test_sha1", T.StringType())]))
    every = digests.unionByName(parted.select(*scope).distinct().withColumn("test_sha1", F.lit(None).cast("string")))
    return every.groupBy(*scope).agg(F.coalesce(F.max("test_sha1"), F.lit(hashlib.sha1().hexdigest())).alias("test_sha1"))


def partition_manifest(rows: DataFrame, scope: list[str]) -> DataFrame:
    """A manifest's own split where all rows of a corpus have one, a derived one where none has; anything between is refused."""
    filled = F.coalesce(F.col("split"), F.lit("")) != ""
    state = rows.groupBy(*scope).agg(F.count_if(filled).alias("filled"), F.count("*").alias("n"))
    partly = state.where((F.col("filled") > 0) & (F.col("filled") < F.col("n"))).take(5)
    if partly:
        raise ValueError(f"the split column is filled on some rows only: {[tuple(r) for r in partly]}")
    shipped = rows.where(filled).withColumn("split_policy", F.lit("shipped"))
    rest = rows.where(~filled).drop("split")
    derived = derive(rest, scope, F.when(F.trim("speaker") != "", F.col("speaker")), F.col("utt_id"))
    return shipped.unionByName(derived.select(shipped.columns))


def partition_with_test(rows: DataFrame, scope: list[str], side: str = "side") -> DataFrame:
    """A published test side stays; of the training side only the derived validation part leaves train."""
    train, test = rows.where(F.col(side) == "train"), rows.where(F.col(side) == "test")
    overlap = train.select(*scope, "speaker").distinct().intersect(test.select(*scope, "speaker").distinct()).take(5)
    if overlap:
        raise ValueError(f"speakers on both sides: {[tuple(r) for r in overlap]}")
    parted = derive(train, scope, F.when(F.trim("speaker") != "", F.col("speaker")), F.col("utt_id"))
    if not parted.where("split_policy <> 'speaker'").isEmpty():
        raise ValueError("the training side has too few speakers for a part of its own")
    parted = parted.withColumn("split", F.when(F.col("split") == "validation", "validation").otherwise("train")).drop("split_policy")
    return parted.unionByName(test.withColumn("split", F.lit("test")).select(parted.columns))


def first_of(rows: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
