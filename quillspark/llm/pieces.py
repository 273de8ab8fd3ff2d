"""Exact, vectorised lookup of short byte strings in a growing table, shared by the encoder and the token counter.

A piece of at most 16 bytes is keyed by its length, its first eight and its last eight bytes, which determine it; the
key is compared in full, so a hash only chooses the place. Longer pieces go through a dictionary of bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textkernel as K

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
PROBES = 4


def keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words that determine each piece of 1 to 16 bytes, given its length."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    first = np.ascontiguousarray(eights[starts]).view(np.uint64).ravel() & _MASKS[np.minimum(lengths, 8)]
    tail = np.ascontiguousarray(eights[starts + np.maximum(lengths - 8, 0)]).view(np.uint64).ravel()
    return first, np.where(lengths > 8, tail, np.uint64(0))


class PieceTable:
    """piece -> small integer row, filled by ``make`` (bytes -> row) at the first sight of a piece, or by ``make_all`` for
    many pieces at once."""

    def __init__(self, make: Callable[[bytes], int], bits: int = 20, limit: int = 1 << 19, make_all: Callable[[list[bytes]], list[int]] | None = None) -> None:
        self.make, self.bits, self.limit = make, bits, limit
        self.make_all = make_all or (lambda pieces: [make(piece) for piece in pieces])
        self.long: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        n = (1 << self.bits) + PROBES
        self.first, self.last = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.length, self.row, self.used = np.zeros(n, np.uint8), np.zeros(n, np.int64), 0

    def _place(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (K.mix(a + K.mix(b + n.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, out = self._place(a, b, n), np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for k in range(PROBES):
            p = at[todo] + k if k else at
            x, y, z = (a, b, n) if not k else (a[todo], b[todo], n[todo])
            hit = (self.first[p] == x) & (self.last[p] == y) & (self.length[p] == z)
            out[todo[hit]] = self.row[p[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
        for at, x, y, z, r in zip(self._place(a, b, n).tolist(), a.tolist(), b.tolist(), n.tolist(), rows.tolist(), strict=True):
            for p in range(at, at + PROBES):
                if not self.length[p]:
                    self.first[p], self.last[p], self.length[p], self.row[p] = x, y, z, r
                    self.used += 1
                    break

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each piece (none may be empty)."""
        n = ends - starts
        out = np.empty(len(n), np.int64)
        short = n <= 16
        at = np.flatnonzero(short)
        if len(at):
            a, b = keys(data, starts[at], n[at])
            got = self._find(a, b, n[at])
            miss = np.flatnonzero(got < 0)
            if len(miss):
                triple = np.empty(len(miss), [("a", "u8"), ("b", "u8"), ("n", "i8")])
                triple["a"], triple["b"], triple["n"] = a[miss], b[miss], n[at][miss]
                order = np.lexsort((triple["n"], triple["b"], triple["a"]))
                t = triple[order]
                new = np.concatenate([[True], t[1:] != t[:-1]])
                heads = order[new]
                raw = data.tobytes() if len(heads) > 64 else None
                s, e = starts[at][miss][heads], ends[at][miss][heads]
                made = np.array(self.make_all([raw[i:j] if raw is not None else data[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)]), np.int64)
                value = np.empty(len(miss), np.int64)
                value[order] = made[np.cumsum(new) - 1]
                got[miss] = value
                if self.used + len(heads) > self.limit:
                    self.clear()  # a cache: starting anew bounds its memory
                h = miss[heads]
                self.add(a[h], b[h], n[at][h], made)
            out[at] = got
        for i in np.flatnonzero(~short).tolist():
            piece = data[starts[i] : ends[i]].tobytes()
            row = self.long.get(piece)
            if row is None:
                row = self.make(piece)
                if len(piece) <= 256:
                    if len(self.long) >= 1 << 17:
                        self.long.clear()
                    self.long[piece] = row
            out[i] = row
        return out
