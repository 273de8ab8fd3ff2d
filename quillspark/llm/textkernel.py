"""Vectorised text primitives shared by the corpus operators.

Everything works on flat byte buffers: a slice of an Arrow string column becomes one ``uint8`` array
plus row offsets, and words, lines and shingles are located and hashed with array arithmetic.

Hashes of words are exact functions of their bytes: a random table lookup per byte, weighted by powers
of an odd multiplier, summed by prefix sums modulo 2**64 and finished with a 64-bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled by one round of array arithmetic; bounds temporaries to a few dozen times this.
CHUNK_BYTES = 1 << 19

_MULT = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
#: One random odd value for each byte; LOWER_TABLE gives A-Z the values of a-z.
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
BYTE_TABLE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for n positions at least."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_MULT, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("p", _MULT), ("i", inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """The same written over x, which is at its place afterwards; returns an array of its size to use again."""
    held = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, U64(shift), out=held)
        x ^= held
        if factor > 1:
            with np.errstate(over="ignore"):
                x *= U64(factor)
    return held


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


try:
    _libc = ctypes.CDLL(None)
    _malloc_trim = _libc.malloc_trim
    # Arrays of a few megabytes come from memory that was used before: fresh pages for each cost more than the arithmetic.
    _M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3
    _libc.mallopt(_M_TRIM_THRESHOLD, 64 << 20)
    _libc.mallopt(_M_MMAP_THRESHOLD, 16 << 20)
except (OSError, AttributeError):  # not glibc
    _malloc_trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside others in its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): runs of whole rows of about ``limit`` bytes; a longer row alone."""
    data, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    if len(data) > 4 * limit:
        give_back()


def valid_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """The rows and their text as one string; what is no UTF-8 in a row is replaced by U+FFFD."""
    raw = data.tobytes()
    try:
        inner = offsets[:-1][offsets[:-1] < len(data)]
        if ((data[inner] & 0xC0) == 0x80).any():  # a character across two rows is none
            raise UnicodeDecodeError("utf-8", b"", 0, 0, "row")
        return data, offsets, raw.decode()
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sizes = [len(x.encode()) for x in rows]
        text = "".join(rows)
        return np.frombuffer(text.encode(), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), text


def strings(column: pa.Array) -> list[str | None]:
    """Values of a string column; what is no UTF-8 is replaced by U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside 0x20 and 0x09-0x0D, none across two rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = word[:-1], word[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the index of its first span, and the number of spans after the last row."""
    return np.searchsorted(starts, offsets, "left")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row; a row with fewer words gives its whole sequence as one, a row without words none.

    ``first``: for each row, the index of its first word. Returns hashes and, as ``first``, their bounds by row.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(made, out=bounds[1:])
    row = np.repeat(np.arange(len(counts)), made)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    padded = np.concatenate([words, np.zeros(width, U64)])
    left = np.minimum(counts[row], width).astype(U64) if len(row) else np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = left.copy()
        for k in range(width):
            w = padded[at + k]
            if k:
                w = np.where(left > k, w, U64(0))
            out = out * U64(0xD6E8FEB86659FD93) + w
    return mix(out), bounds


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and their bounds."""
    out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(bounds) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a == 1:
            part = values[a:b]
        elif b > a:
            part = np.sort(values[a:b])
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        else:
            continue
        sizes[i] = len(part)
        out.append(part)
    new = np.zeros(len(bounds), np.int64)
    np.cumsum(sizes, out=new[1:])
    return (np.concatenate(out) if out else np.zeros(0, U64)), new


def distinct_short(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for 48-bit values (the upper bits of ``values``), all rows in one sort: for many short rows."""
    n = len(bounds) - 1
    values = values & ~U64(0xFFFF)
    if n > 0xFFFF:
        return distinct_by_row(values, bounds)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    packed = np.sort((row << U64(48)) | (values >> U64(16)))
    packed = packed[np.concatenate((np.ones(min(1, len(packed)), bool), packed[1:] != packed[:-1]))]
    new = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount((packed >> U64(48)).astype(np.int64), minlength=n), out=new[1:])
    return packed << U64(16), new


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values, modulo 2**64 for unsigned ones."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, values.dtype)
        np.cumsum(values, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the elements of ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def super_minhash(values: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, m slots of 16 bits by row; values of a row may repeat. Rows without values get zeros."""
    return super_minhash_rounds(values, bounds, m, m)[0]


def super_minhash_rounds(values: np.ndarray, bounds: np.ndarray, m: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The same after so many rounds, and which rows are unfinished then: their signatures are of no use.

    In round j each element draws r in [0, 1) and takes slot p(j) of its own random permutation with rank j + r; a slot
    keeps its least rank. A round can only give ranks from j to j + 1, so a row whose slots all hold ranks below j is
    finished. Rounds run over the elements of all unfinished rows at once.
    """
    n = len(bounds) - 1
    full = np.iinfo(np.uint64).max
    sig = np.full(n * m, full, U64)
    counts = np.diff(bounds)
    first = np.repeat(np.arange(0, n * m, m), counts)  # the place in sig of each element's row
    active, draws, going = values, [], counts > 0
    for j in range(rounds):
        if not len(active):
            break
        with np.errstate(over="ignore"):
            h = active + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slot = mix_in_place(h)
        np.right_shift(h, U64(32), out=slot)
        slot *= U64(m - j)
        slot >>= U64(32)
        slot = slot.view(np.int64)
        if j:
            # The permutation is a swap of place j with a later one in each round. What stands there now is traced back
            # through the swaps: it was where the swap that brought it took it from.
            slot += j
            own = slot
            for k in range(j - 1, -1, -1):
                slot = np.where(slot == draws[k], k, slot)
        else:
            own = slot
        h &= U64(0xFFFFFFFF)
        if j:
            h |= U64(j << 32)
        np.minimum.at(sig, first + slot, h)
        going = (sig.reshape(n, m).max(axis=1) >= (U64(j + 1) << U64(32))) & (counts > 0)
        if not going.any() or j == rounds - 1:
            break
        draws.append(own)
        # Few rows go on as a rule: in the first round their elements are found by the bounds.
        stay = ragged(bounds[:-1][going], counts[going]) if j == 0 else np.flatnonzero(going[first // m])
        if len(stay) < len(active):
            active, first, draws = active[stay], first[stay], [d[stay] for d in draws]
    sig[sig == full] = 0
    return (mix(sig) >> U64(48)).astype(np.uint16).reshape(n, m), going
