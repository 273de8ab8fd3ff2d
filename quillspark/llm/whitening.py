"""Embedding whitening from an exact integer scatter (operator 11).

Entries become integers, x = floor(64 * c) + 1,000,000. The shift is taken off again, as the scatter doesn't depend on it,
and sums and cross-products are added up without any rounding: in a task, x is cut into limbs of ``LIMB`` bits, so that the
products of a block of rows fit the 53 bits of a double and one matrix product is exact; blocks are added as Python
integers; and tasks hand on the digits of each sum to the base 2**32, one row a digit, which Spark adds as longs. What
reaches the driver are the d * (d + 1) / 2 sums of a dimension d, however many rows there are. There n * XtX - S * St is
formed exactly; only then it becomes doubles, and ``eigh`` gives the components. The number of components that aren't
constant is the rank of the integer scatter, found by elimination modulo a prime, so that no rounding decides it.

Rows are whitened in a second pass and written out; ``identity_error`` is measured on the whitened rows themselves.

Defined results: vectors that are null or hold a null or non-finite entry are dropped; an entry beyond the range of longs is
cut to it; vectors of different lengths are fit lists of their own, and one without entries has no
components; a component along which all vectors agree (fewer vectors than dimensions, equal rows, one row) has variance 0
and is left out, so those rows may have fewer than 32 components or none; ``deviation`` is null where it has more than 38
digits; ties of eigenvalues give one of their bases, the same for all rows; repeated rows count as often as they occur; ids
may be null or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table, tune

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMB, BLOCK = 20, 8192  # products of two limbs have 40 bits, sums of BLOCK of them 53
DIGIT = 32
#: Primes below 2**31 for the rank; a rank modulo a prime is at most the rank, and less only if the prime divides a minor.
PRIMES = (2147483647, 2147483629)
_LEAST, _MOST = -(2**63), 2**63 - 1


def integers(values: np.ndarray) -> np.ndarray:
    """x less the shift, floor(64 * c), so that x fits a long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    out = np.where(np.abs(scaled) < 2.0**62, scaled, 0).astype(np.int64)
    out[scaled >= 2.0**62] = _MOST - SHIFT
    out[scaled <= -(2.0**62)] = _LEAST
    wide = (np.abs(scaled) >= 2.0**62) & (np.abs(scaled) < 2.0**63)
    if wide.any():
        out[wide] = [max(_LEAST, min(_MOST - SHIFT, int(c))) for c in scaled[wide]]
    return out


def valid_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: which rows have it and nothing but finite entries, and their integers, a row each."""
    values = column.values if isinstance(column, pa.ListArray | pa.LargeListArray) else column.flatten()
    offsets = column.offsets.to_numpy().astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    held = values.slice(low, high - low)
    numbers = held.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(numbers) | np.asarray(held.is_null())
    odd = np.concatenate([[0], np.cumsum(bad)])[offsets - low]
    keep = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(odd) == 0))
    sizes = np.diff(offsets)
    for size in np.unique(sizes[keep]):
        rows = keep[sizes[keep] == size]
        at = (offsets[rows] - low)[:, None] + np.arange(size)
        yield rows, integers(numbers[at])


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as sum of limb k times 2**(LIMB * k), as doubles; limbs have the sign of x."""
    sign, left = np.sign(x).astype(np.float64), np.abs(x.astype(np.int64)).view(np.uint64)  # the least long too
    out = []
    while True:
        out.append((left & np.uint64((1 << LIMB) - 1)).astype(np.float64) * sign)
        left = left >> np.uint64(LIMB)
        if not left.any():
            return out


class Sums:
    """Number of rows, sums and cross-products of one length of vectors, as Python integers."""

    def __init__(self, size: int) -> None:
        self.n, self.sums, self.products = 0, np.zeros(size, object), np.zeros((size, size), object)

    def add(self, x: np.ndarray) -> None:
        for k in range(0, len(x), BLOCK):
            parts = limbs(x[k : k + BLOCK])
            whole = lambda a: a.astype(np.int64).astype(object)
            for i, a in enumerate(parts):
                self.sums += whole(a.sum(axis=0)) << (LIMB * i)
                for j, b in enumerate(parts[i:], i):
                    cross = whole(a.T @ b)
                    self.products += (cross if i == j else cross + cross.T) << (LIMB * (i + j))
        self.n += len(x)

    def digits(self) -> Iterator[tuple[int, int, int]]:
        """(cell, place, digit): cell 0 is n, then the sums, then the upper triangle by row."""
        upper = self.products[np.triu_indices(len(self.sums))]
        for cell, value in enumerate([self.n, *self.sums.tolist(), *upper.tolist()]):
            sign, left, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
            while left:
                yield cell, place, sign * (left & ((1 << DIGIT) - 1))
                left, place = left >> DIGIT, place + 1


def scatter_digits(vectors: DataFrame, column: str) -> DataFrame:
    """(size, cell, place, digit), added up over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sums] = {}
        for batch in batches:
            for _, x in valid_rows(batch.column(0)):
                held.setdefault(x.shape[1], Sums(x.shape[1])).add(x)
        for size, sums in held.items():
            found = np.array(list(sums.digits()), np.int64).reshape(-1, 3)
            for k in range(0, len(found), 50_000):
                some = found[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size)), *[pa.array(np.ascontiguousarray(some[:, j])) for j in range(3)]], ["size", "cell", "place", "digit"])

    each = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "size long, cell long, place long, digit long")
    return each.groupBy("size", "cell", "place").agg(F.sum("digit").alias("digit"))


def rank(matrix: np.ndarray) -> int:
    """The rank of a matrix of Python integers."""
    best = 0
    for p in PRIMES:
        m, row = (matrix % p).astype(np.int64), 0
        for col in range(m.shape[1]):
            pivots = np.flatnonzero(m[row:, col])
            if not len(pivots):
                continue
            k = row + int(pivots[0])
            m[[row, k]] = m[[k, row]]
            m[row] = m[row] * pow(int(m[row, col]), -1, p) % p
            below = np.flatnonzero(m[row + 1 :, col]) + row + 1
            m[below] = (m[below] - m[below, col][:, None] * m[row][None, :] % p) % p
            row += 1
            if row == len(m):
                break
        best = max(best, row)
        if best == len(matrix):
            break
    return best


@dataclass(frozen=True)
class Space:
    """A fitted space: number of rows, sums of the shifted integers, and the leading components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column for each component

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as Python integers where longs don't hold them."""
        largest = self.n * max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1) + max(map(abs, self.sums), default=0)
        sums = np.array(self.sums, object if largest >= 2**62 else np.int64)
        return (x.astype(object) if largest >= 2**62 else x) * self.n - sums

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Whitened rows and their deviations, from integers without the shift."""
        own = self.centred(x)
        if own.dtype == object:
            exact, as_double = own, np.array([[a / self.n for a in r] for r in own.tolist()], np.float64).reshape(own.shape)
        else:
            as_double = own / self.n  # below 2**62, so at most one rounding before the division
            exact = own if float(np.abs(own.astype(np.float64)).max(initial=0)) ** 2 * max(own.shape[1], 1) < 2.0**62 else own.astype(object)
        return as_double @ self.vectors / np.sqrt(self.values), (exact * exact).sum(axis=1)


def fit_space(size: int, cells: dict[int, int], components: int = COMPONENTS) -> Space:
    n, sums = cells[0], [cells.get(1 + k, 0) for k in range(size)]
    products = np.zeros((size, size), object)
    rows, cols = np.triu_indices(size)
    for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
        products[i, j] = products[j, i] = cells.get(1 + size + k, 0)
    s = np.array(sums, object)
    scatter = n * products - np.multiply.outer(s, s)  # exact; n * n times the covariance
    covariance = np.array([[a / (n * n) for a in row] for row in scatter.tolist()], np.float64).reshape(size, size)
    trace = sum(scatter[k, k] for k in range(size)) / (n * n) if size else 0.0
    values, vectors = np.linalg.eigh(covariance) if size else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[: min(components, rank(scatter) if size else 0)]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0)[0] < 0, -1.0, 1.0) if len(order) else vectors
    good = values > 0  # of a variance that is lost in the rounding of the largest one nothing can be said
    return Space(n, tuple(sums), trace, values[good], np.ascontiguousarray(vectors[:, good]))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length of vectors. What is gathered here grows with the square of that length, not with the rows."""
    cells: dict[int, dict[int, int]] = {}
    for size, cell, place, digit in scatter_digits(vectors, column).collect():
        own = cells.setdefault(size, {})
        own[cell] = own.get(cell, 0) + (digit << (DIGIT * place))
    return {size: fit_space(size, own, components) for size, own in cells.items()}


def identity_error(vectors: DataFrame, spaces: dict[int, Space], column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all spaces; 0 without components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in valid_rows(batch.column(0)):
                w, _ = spaces[x.shape[1]].whiten(x)
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)  # so that sums and products are one matrix
                held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for size, m in held.items():
            at = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size)), pa.array(at[0]), pa.array(at[1]), pa.array(m.ravel())], ["size", "i", "j", "v"])

    parts = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "size long, i long, j long, v double")
    worst, found = 0.0, {}
    for size, i, j, v in parts.groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect():
        k = len(spaces[size].values) + 1
        found.setdefault(size, np.zeros((k, k)))[i, j] = v
    for size, m in found.items():
        mean, n = m[0, 1:] / spaces[size].n, spaces[size].n
        off = m[1:, 1:] / n - np.multiply.outer(mean, mean) - np.eye(len(mean))
        worst = max(worst, float(np.abs(off).max(initial=0)))
    return worst


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error): one row for each vector and component."""
    spaces = fit(vectors, column, components)
    error = identity_error(vectors, spaces, column)
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in valid_rows(batch.column(1)):
                space = spaces[x.shape[1]]
                k = len(space.values)
                for at in range(0, len(rows) if k else 0, BLOCK):
                    w, exact = space.whiten(x[at : at + BLOCK])
                    kind, some = pa.decimal128(38, 0), rows[at : at + BLOCK]
                    if exact.dtype == object:
                        deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact.tolist()], kind)
                    else:
                        deviation = pa.array(exact).cast(kind)
                    each = pa.array(np.repeat(np.arange(len(some)), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(some)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                        pa.array(np.full(len(w) * k, space.n)),
                        deviation.take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(space.values / space.trace, len(some))),
                        pa.array(np.full(len(w) * k, error)),
                    ], names)

    schema = f"{id_column} {dict(vectors.dtypes)[id_column]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.select(id_column, F.col(column).cast("array<double>").alias("v")).mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
