"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokens are found without a regex. Each code point gets a class; with its next two characters an apostrophe gets one
of two more. The classes are the alphabet of an automaton of eight states, so each character is a function from states
to states; these functions are closed under composition (a small monoid), composition is associative, and the state
before every character follows from a scan of compositions: within columns of a matrix of characters step by step for
all columns at once, over the columns' totals by doubling. A row's first character is a constant function, so rows of
one array don't affect each other. A pre-token starts where the state before a character and its class say so.

Distinct pre-tokens are merged once, by rank, and cached in a table (``pieces``); ids of all pre-tokens are then one
gather. Byte offsets of the pre-tokens stay with them, so a token can be traced to its bytes; decoding gathers the bytes
of the ids.

Defined results: null is the empty text, which has no ids; texts are encoded whole; invalid UTF-8 is replaced by U+FFFD;
equal texts give equal ids; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as K
from .pieces import PieceTable
from .runtime import table, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Symbols: letter, number, space, other white space, other, apostrophe before one or two letters of a contraction.
LETTER, NUMBER, SPACE, WHITE, OTHER, APO1, APO2 = range(7)
FIRST = 7  # added for the first character of a row
# States: what the last character was part of; one or two letters of a contraction still to come; contraction over.
IN_LETTERS, IN_NUMBERS, AT_SPACE, AT_WHITE, IN_OTHERS, NEED1, NEED2, OVER = range(8)


def _step(state: int, symbol: int) -> int:
    if symbol >= FIRST:
        return _step(OVER, symbol - FIRST)
    if symbol == LETTER:
        return {NEED2: NEED1, NEED1: OVER}.get(state, IN_LETTERS)
    if symbol in (APO1, APO2):
        return IN_OTHERS if state in (IN_OTHERS, AT_SPACE) else (NEED1 if symbol == APO1 else NEED2)
    return {NUMBER: IN_NUMBERS, SPACE: AT_SPACE, WHITE: AT_WHITE, OTHER: IN_OTHERS}[symbol]


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol; table of compositions (first, then second); state that each element leads to from OVER."""
    of_symbol = [tuple(_step(s, x) for s in range(8)) for x in range(2 * FIRST)]
    found = list(dict.fromkeys([tuple(range(8)), *of_symbol]))
    at = {f: k for k, f in enumerate(found)}
    k = 0
    while k < len(found):
        for other in list(found):
            for f, g in ((found[k], other), (other, found[k])):
                h = tuple(g[x] for x in f)
                if h not in at:
                    at[h] = len(found)
                    found.append(h)
        k += 1
    n = len(found)
    compose = np.zeros((n, n), np.uint8)
    for f, g in product(range(n), repeat=2):
        compose[f, g] = at[tuple(found[g][x] for x in found[f])]
    return np.array([at[f] for f in of_symbol], np.uint8), compose, np.array([f[OVER] for f in found], np.uint8)


ELEMENT, COMPOSE, LEADS = _monoid()
_N = len(COMPOSE)
_FLAT = COMPOSE.ravel()
COLUMN = 256


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each character."""
    n = len(symbols)
    columns = max(1, -(-n // COLUMN))
    grid = np.zeros((columns, COLUMN), np.uint8)  # element 0 is the identity
    grid.ravel()[:n] = ELEMENT[symbols]
    grid = np.ascontiguousarray(grid.T)
    for k in range(1, COLUMN):  # running compositions within each column
        grid[k] = _FLAT[grid[k - 1].astype(np.int32) * _N + grid[k]]
    total, shift = grid[-1].copy(), 1
    while shift < columns:  # over the columns' totals, by doubling
        total[shift:] = _FLAT[total[:-shift].astype(np.int32) * _N + total[shift:]]
        shift *= 2
    before = np.concatenate([np.zeros(1, np.uint8), total[:-1]]).astype(np.int32) * _N
    after = LEADS[_FLAT[before[None, :] + grid]].T.ravel()[:n]
    return np.concatenate([np.array([OVER], np.uint8), after[:-1]])


# For (state before, symbol): does a pre-token start? White space in a run of it starts one only as its last character.
_STARTS = np.zeros((8, FIRST), bool)
for _s in range(8):
    _STARTS[_s, LETTER] = _s not in (IN_LETTERS, NEED1, NEED2, AT_SPACE)
    _STARTS[_s, NUMBER] = _s not in (IN_NUMBERS, AT_SPACE)
    for _x in (OTHER, APO1, APO2):
        _STARTS[_s, _x] = _s not in (IN_OTHERS, AT_SPACE)
    for _x in (SPACE, WHITE):
        _STARTS[_s, _x] = _s not in (AT_SPACE, AT_WHITE)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the general categories L and N and the property White_Space of the Unicode
    tables that the tokenizer library holds (its matcher is asked once for each property); without it, Python's."""
    out = np.full(0x110000, OTHER, np.uint8)
    try:
        import tiktoken

        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            members = probe.decode_bytes(probe.encode_ordinary(everything)).decode("utf-8")
            out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    except ImportError:
        for c in range(0x110000):
            major = unicodedata.category(chr(c))[0]
            if major in "LN":
                out[c] = LETTER if major == "L" else NUMBER
        white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        out[white] = WHITE
    out[0x20] = SPACE
    return out


_S, _T, _M, _D, _R, _E, _V, _L = (ord(c) for c in "stmdrevl")


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters start a pre-token. ``points``: code points of rows one after the other; ``first``: is it a row's first?"""
    n = len(points)
    symbols = classes()[points]
    apostrophes = np.flatnonzero(points == 0x27)
    if len(apostrophes):
        # Characters of the next row don't count: they read as NUL.
        one, two = apostrophes + 1, apostrophes + 2
        c1 = np.where((one < n) & ~first[np.minimum(one, n - 1)], points[np.minimum(one, n - 1)], 0)
        c2 = np.where((c1 > 0) & (two < n) & ~first[np.minimum(two, n - 1)], points[np.minimum(two, n - 1)], 0)
        short = (c1 == _S) | (c1 == _T) | (c1 == _M) | (c1 == _D)
        long = ((c1 == _R) & (c2 == _E)) | ((c1 == _V) & (c2 == _E)) | ((c1 == _L) & (c2 == _L))
        symbols[apostrophes[short]] = APO1
        symbols[apostrophes[long]] = APO2
    state = states_before(symbols + FIRST * first.astype(np.uint8))
    state[first] = OVER
    starts = _STARTS[state, symbols]
    white = (symbols == SPACE) | (symbols == WHITE)
    ahead = np.zeros(n, bool)  # the next character is in the same row and isn't white space
    ahead[:-1] = ~white[1:] & ~first[1:]
    return starts | (white & ahead)


def pretokens(data: np.ndarray, offsets: np.ndarray, text: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of rows of UTF-8 text, and for each row the index of its first. ``text``: the same as a string."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte of each character
    points = np.frombuffer((text if text is not None else data.tobytes().decode()).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = at[boundaries(points, first[at])]
    return starts, np.searchsorted(starts, offsets, "left")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is joined until no pair is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
            heapq.heappush(heap, (r, h, e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for piece, k in self.ranks.items():
            by_id[k] = piece
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte_bounds = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.restart()

    def restart(self) -> None:
        self.ids, self.fill = np.zeros(1 << 16, np.uint32), 0
        self.bounds = array("q", [0])
        self.table = PieceTable(self._make)

    def _make(self, piece: bytes) -> int:
        ids = merge(piece, self.ranks)
        while self.fill + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.fill : self.fill + len(ids)] = ids
        self.fill += len(ids)
        self.bounds.append(self.fill)
        return len(self.bounds) - 2

    def encode(self, data: np.ndarray, offsets: np.ndarray, text: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, their bounds by row, byte starts of the pre-tokens, and the number of ids of each."""
        if self.fill > 1 << 23:
            self.restart()
        starts, first = pretokens(data, offsets, text)
        rows = self.table.rows(data, starts, np.concatenate([starts[1:], [len(data)]]).astype(np.int64)[: len(starts)])
        bounds = np.array(self.bounds)
        low, length = bounds[rows], bounds[rows + 1] - bounds[rows]
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self.ids[K.ragged(low, length)], total[first], starts, length

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids and their bounds by row."""
        low = self.byte_bounds[ids]
        length = self.byte_bounds[ids.astype(np.int64) + 1] - low
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self.bytes[K.ragged(low, length)], total[bounds]


@lru_cache(4)
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(documents: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, piece_offsets array<int>: byte of the text at which each id's pre-token starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                data, offsets, text = K.valid_text(data, offsets)
                ids, bounds, starts, length = c.encode(data, offsets, text)
                where = np.repeat(starts, length)
                where = where - np.repeat(offsets[:-1], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, where)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], [id_column, "ids", "piece_offsets"])

    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {dict(documents.dtypes)[id_column]}, ids array<int>, piece_offsets array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in batches:
            lists = batch.column(1).to_pylist()
            ids = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x or [], np.int64) for x in lists]])
            bounds = np.concatenate([[0], np.cumsum([len(x or []) for x in lists])]).astype(np.int64)
            data, at = c.decode(ids, bounds)
            raw = data.tobytes()
            texts = [raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"{id_column} {dict(encoded.dtypes)[id_column]}, text string")


def digest(documents: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as little-endian 32-bit integers, SHA-256 of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary_path())
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                data, offsets, whole = K.valid_text(data, offsets)
                ids, bounds, _, _ = c.encode(data, offsets, whole)
                back, at = c.decode(ids, bounds)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                text = memoryview(back)
                sha = lambda view, lo, hi: hashlib.sha256(view[lo:hi]).hexdigest()
                yield pa.RecordBatch.from_pydict({
                    id_column: batch.column(0).slice(a, b - a),
                    "n_tokens": np.diff(bounds).astype(np.int64),
                    "ids_sha256": [sha(raw, 4 * bounds[k], 4 * bounds[k + 1]) for k in range(b - a)],
                    "decoded_sha256": [sha(text, at[k], at[k + 1]) for k in range(b - a)],
                })

    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {dict(documents.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digest(table(spark, sf_dir, "documents"))
