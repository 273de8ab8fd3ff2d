"""Near-duplicate embeddings by collision counting over one-dimensional projections (operator 2).

Each unit vector is projected on ``PROJECTIONS`` random directions, and each projection is cut into steps of ``WIDTH``. A
pair collides in a direction when the second projection lies in the window around the first one's step, the step itself
and those beside it. At a cosine of 0.95 a collision has a probability of ``hit_rate()``, about 0.92, for unrelated vectors one of
about 0.26, independently by direction, so the number of collisions tells them apart: a pair passes with at least
``LEAST`` of them, a count that a pair at the threshold misses with a probability below 0.001. What passes is verified
by its cosine in double precision.

Windows over one sorted projection alone would meet a fixed share of all pairs, in quadratic time. So rows first meet in
cells: for each of several tables, the signs of some further projections. The number of signs grows with the logarithm
of the rows, and the number of tables is chosen so that a pair at the threshold shares no cell with a probability of
0.002 at most (higher cosines far less). Collisions are counted for the pairs of a cell, not by sorting whole
projections. Rows carry half a byte a projection to the cells, no vectors; only rows with a passing pair are sent there
again with their vectors. A pair that meets in several tables is counted in the first of them only, which both rows can
tell by themselves, so no table of pairs is built: a task gives each row's number of links and a spanning forest of the
links it found. A cell of many rows is dealt by pairs of blocks. Equal vectors are one row all the way, with their number.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing;
vectors of different lengths don't link; rows equal in id and vector count as one vector; rows that share an id have the
links of all their vectors and one component; rows without an id link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected, local_roots
from .neardup import binary
from .runtime import Scratch, table, tune

COSINE = 0.95
PROJECTIONS = 32
WIDTH = math.sqrt(2 - 2 * COSINE)
MISS_COUNT = 0.001
MISS_CELLS = 0.002
BLOCK = 512


def least_collisions(trials: int, p: float, miss: float) -> int:
    """The largest count that at least 1 - miss of binomial draws reach."""
    below, k = 0.0, 0
    while True:
        below += math.comb(trials, k) * p**k * (1 - p) ** (trials - k)
        if below > miss:
            return k
        k += 1


def hit_rate() -> float:
    """Probability that two projections, normal with WIDTH as the deviation of their difference, are at most one step apart.

    The first lies anywhere in its step, so the second has from one to two steps to either side: the mean over places."""
    inside = lambda t: math.erf(t / math.sqrt(2)) / 2
    return sum(inside(2 - (k + 0.5) / 1000) + inside(1 + (k + 0.5) / 1000) for k in range(1000)) / 1000


LEAST = least_collisions(PROJECTIONS, hit_rate(), MISS_COUNT)
#: Rows that a cell of unrelated vectors has: more of them need fewer tables, but more pairs are counted.
CELL = 128


def plan_cells(rows: int, cosine: float = COSINE, miss: float = MISS_CELLS) -> tuple[int, int]:
    """(signs by table, tables) for so many rows."""
    signs = min(40, max(4, math.ceil(math.log2(max(rows, 2) / CELL))))
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


@lru_cache(8)
def directions(dim: int, signs: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, signs, tables, 7])
    return rng.standard_normal((dim, PROJECTIONS)), rng.standard_normal((dim, signs * tables))


def cells(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The cell of each row in each table."""
    bits = (x @ directions(x.shape[1], signs, tables)[1]) > 0
    return bits.reshape(len(x), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def steps(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The steps of each row's projections, two to a byte. Places beyond the range are in its last steps, which only adds collisions."""
    own = np.clip(np.floor(x @ directions(x.shape[1], signs, tables)[0] / WIDTH), -8, 7).astype(np.int8) + np.int8(8)
    return (own[:, ::2] | (own[:, 1::2] << 4)).astype(np.uint8)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many directions rows of steps are at most one apart."""
    out = 0
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        out = out + ((x - y + np.uint8(1)) <= 2).sum(axis=1)  # unsigned: below it wraps
    return out


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, dim, hi, lo, vec): vectors that can link, as bytes of their own type, and 128 bits that tell them apart."""
    kind = "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out, digests = [], [], [], []
            for k, v in enumerate(batch.column(1)):
                values = v.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    keep.append(k)
                    dims.append(len(x) if kind == "<f8" else -len(x))
                    out.append((x + 0).tobytes())  # one zero
                    digests.append(xxhash.xxh3_128_digest(out[-1]))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), *map(pa.array, np.ascontiguousarray(halves)), pa.array(out, pa.binary())], ["id", "dim", "hi", "lo", "vec"])

    own = dict(vectors.dtypes)[id_column]
    return vectors.select(id_column, column).where(F.col(id_column).isNotNull()).mapInArrow(run, f"id {own}, dim int, hi long, lo long, vec binary")


def _matrices(dim: np.ndarray, vec: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which rows have it, and their unit vectors. A negative ``dim`` is one of single precision."""
    for size in np.unique(dim):
        at = np.flatnonzero(dim == size)
        raw = np.frombuffer(b"".join([vec[k] for k in at.tolist()]), "<f8" if size > 0 else "<f4")
        yield at, unit_vectors(raw.reshape(len(at), abs(int(size))))


def _by_key(dealt: DataFrame, of: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """Streams rows sorted by key to ``of``, in tables of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = t.slice(cut)
            if cut and (out := of(t.slice(0, cut))) is not None:
                yield out
        if held is not None and held.num_rows and (out := of(held)) is not None:
            yield out

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _pairs(key: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(i, d): rows i and i + d have the same key and may be compared; all such pairs."""
    for d in range(1, len(key)):
        same = key[:-d] == key[d:]
        if not same.any():
            return
        yield np.flatnonzero(same & ((side[:-d] < 0) | (side[:-d] != side[d:]))), d


def flagged(dealt: DataFrame) -> DataFrame:
    """(uid, key, side, tab) of those rows (key, side, tab, uid, steps) that have a passing pair in their cell."""

    def of(t: pa.Table) -> pa.RecordBatch | None:
        own = np.frombuffer(b"".join(t["steps"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        passed = np.zeros(t.num_rows, bool)
        for i, d in _pairs(t["key"].to_numpy(), t["side"].to_numpy()):
            i = i[~(passed[i] & passed[i + d])]
            i = i[collisions(own[i], own[i + d]) >= LEAST]
            passed[i] = passed[i + d] = True
        return t.select(["uid", "key", "side", "tab"]).filter(pa.array(passed)).combine_chunks().to_batches()[0] if passed.any() else None

    return _by_key(dealt, of, T.StructType([dealt.schema[c] for c in ("uid", "key", "side", "tab")]))


def compared(dealt: DataFrame, signs: int, tables: int) -> DataFrame:
    """(uid, links, root) from rows (key, side, tab, uid, n, dim, vec); links counts the others with their numbers n."""

    def of(t: pa.Table) -> pa.RecordBatch | None:
        n = t.num_rows
        uid, number = t["uid"].to_numpy(), t["n"].to_numpy()
        links, lefts, rights = np.zeros(n, np.int64), [], []
        for at, x in _matrices(t["dim"].to_numpy(), t["vec"].to_pylist()):
            q, own = steps(x, signs, tables), cells(x, signs, tables)
            tab = t["tab"].to_numpy()[at]
            for i, d in _pairs(t["key"].to_numpy()[at], t["side"].to_numpy()[at]):
                i = i[collisions(q[i], q[i + d]) >= LEAST]
                if len(i):
                    earlier = (own[i] == own[i + d]) & (np.arange(tables)[None, :] < tab[i][:, None])
                    i = i[~earlier.any(axis=1)]
                    i = i[(x[i] * x[i + d]).sum(axis=1) >= COSINE]
                    np.add.at(links, at[i], number[at[i + d]])
                    np.add.at(links, at[i + d], number[at[i]])
                    lefts.append(at[i])
                    rights.append(at[i + d])
        if not links.any():
            return None
        root = local_roots(n, np.concatenate(lefts), np.concatenate(rights))
        out = links > 0
        return pa.RecordBatch.from_arrays([pa.array(uid[out]), pa.array(links[out]), pa.array(uid[root[out]])], ["uid", "links", "root"])

    return _by_key(dealt, of, T.StructType([T.StructField(k, T.LongType()) for k in ("uid", "links", "root")]))


def near_duplicates(vectors: DataFrame, scratch: Scratch, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each row of vectors."""
    each, same = scratch.keep(usable(vectors, id_column, column)), ["dim", "hi", "lo"]
    named = each.select("id", *same).distinct()
    # Equal vectors are one row; their cosine is 1.
    counts = named.groupBy(*same).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    rows = scratch.keep(each.groupBy(*same).agg(F.first("vec").alias("vec")).join(counts, same).withColumn("uid", F.monotonically_increasing_id()))
    of_id = scratch.keep(named.join(rows.select("uid", *same), same).select("id", "uid"))
    signs, tables = plan_cells(rows.count())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch.column("dim").to_numpy(), batch.column("vec").to_pylist()):
                own, q = cells(x, signs, tables), binary(steps(x, signs, tables))
                part = batch.select(["uid", "dim"]).take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([*part.columns, q, pa.array(np.full(len(at), t, np.int32)), pa.array(own[:, t])], ["uid", "dim", "steps", "tab", "cell"])

    placed = rows.select("uid", "dim", "vec").mapInArrow(place, "uid long, dim int, steps binary, tab int, cell long")
    # Cells of more than one block: at most one for BLOCK rows of a table.
    large = scratch.keep(placed.groupBy("tab", "dim", "cell").count().where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK)).drop("count"))
    dealt = placed.join(large, ["tab", "dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid", "tab"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.xxhash64("tab", "dim", "cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(key.alias("key"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("side"), "tab", "uid", "steps")
    passing = scratch.keep(flagged(dealt))
    found = scratch.keep(compared(passing.hint("merge").join(rows.select("uid", "n", "dim", "vec"), "uid").select("key", "side", "tab", "uid", "n", "dim", "vec"), signs, tables))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    # An id of several vectors joins their components, like a link.
    several = of_id.groupBy("id").agg(F.min("uid").alias("root"), F.count("*").alias("vectors")).where("vectors > 1")
    joined = found.select("uid", "root").unionByName(of_id.join(several, "id").select("uid", "root"))
    component = connected(scratch, joined, "uid", "root")
    placed = rows.select("uid", "n", "first").join(links, "uid", "left").join(component, "uid", "left")
    placed = scratch.keep(placed.select("uid", "first", F.coalesce("component", "uid").alias("component"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("links")))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    by_uid = scratch.keep(placed.join(least, "component").select("uid", "links", "least"))
    by_id = of_id.join(by_uid, "uid").groupBy(F.col("id").alias("linked_id")).agg(F.sum("links").alias("n_links"), F.min("least").alias("component"))
    out = vectors.select(id_column).join(by_id, F.col(id_column) == F.col("linked_id"), "left")
    own = F.coalesce(F.col("component"), F.col(id_column))
    return out.select(id_column, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col(id_column)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))
