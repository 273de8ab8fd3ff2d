"""Token counts of whole texts by a piece vocabulary (operator 4).

A text is cut into pre-tokens, runs of spaces with what follows up to the next space; no piece of the vocabulary spans
such a cut, so the count of a text is the sum over its pre-tokens. Each pre-token's count is looked up on the map side
in two tiers: a broadcast table of the frequent pre-tokens of a sample of every part (``SAMPLE_ROWS`` rows a task, at most
``FREQUENT`` entries of 32 bytes, so the broadcast has a fixed size), and a cache in each worker that the tokenizer
library fills at a miss. Only the sample's distinct pre-tokens are shuffled. Both tiers hold exact keys and exact counts: they decide the cost of
a lookup, never its result.

Defined results: null is the empty text with no tokens; white space and special strings are ordinary text, as the
library's default has it; texts are taken whole; equal texts have equal counts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .bpe import vocabulary_path
from .pieces import PieceTable, keys
from .runtime import Scratch, table, tune

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
SAMPLE_ROWS = 1000
#: Counts from here on rank alike.
TOP = 100_000
FREQUENT = 1 << 16
#: The vocabulary's own sign for a space, should a text hold it.
SIGN = "▁".encode()


@lru_cache(2)
def library(path: str) -> Callable[[bytes], int]:
    """Number of tokens of a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any("▁" in piece.lstrip("▁") for piece in pieces):
        raise ValueError("a piece spans a space, so texts can't be counted by pre-tokens")
    return lambda text: len(model.encode(text.decode("utf-8", "replace")))


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, as the library is to see them, and the index of each row's first.

    The library puts a space before a text. So a row's first pre-token stands for itself, and each other one loses the
    first of its spaces.
    """
    space = data == 0x20
    head = np.zeros(len(data) + 1, bool)
    head[1:-1] = space[1:] & ~space[:-1]
    row = np.zeros(len(data) + 1, bool)
    row[offsets] = True
    starts = np.flatnonzero((head | row)[:-1])
    ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64)[: len(starts)]
    return starts + ~row[starts], ends, np.searchsorted(starts, offsets, "left")


class Counter:
    """Counts by a table that starts with the frequent pre-tokens."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, ...] | None = None) -> None:
        self.count = library(path)
        self.table = PieceTable(self.count)
        if frequent is not None:
            self.table.add(*frequent)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, first = pretokens(data, offsets)
        out = np.ones(len(starts), np.int64)  # a single space is one token
        full = np.flatnonzero(ends > starts)
        out[full] = self.table.rows(data, starts[full], ends[full])
        counts = K.row_sums(out, first)
        raw = data.tobytes()
        if SIGN in raw:  # the sign reads as a space: such rows go to the library whole
            for k in range(len(offsets) - 1):
                text = raw[offsets[k] : offsets[k + 1]]
                if SIGN in text:
                    counts[k] = self.count(text)
        return counts


_counters: dict[str, Counter] = {}


def frequent_lengths(documents: DataFrame, path: str) -> tuple[np.ndarray, ...]:
    """The sample's most frequent short pre-tokens: two key words, length and count of each.

    The sample is what every task reads first, at most SAMPLE_ROWS rows a task, so that each part of a corpus in some order
    is in it. Counts are summed over all tasks; the table is filled from the top by a bound on the count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts = 0, []
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0).slice(0, SAMPLE_ROWS - seen)):
                seen += len(offsets) - 1
                starts, ends, _ = pretokens(data, offsets)
                n = ends - starts
                at = np.flatnonzero((n > 0) & (n <= 16))
                triple = np.empty(len(at), [("a", "u8"), ("b", "u8"), ("n", "i8")])
                triple["a"], triple["b"] = keys(data, starts[at], n[at])
                triple["n"] = n[at]
                parts.append(np.unique(triple, return_counts=True))
            if seen >= SAMPLE_ROWS:
                break
        for found, times in parts:
            yield pa.RecordBatch.from_pydict({"a": found["a"].copy().view(np.int64), "b": found["b"].copy().view(np.int64), "n": found["n"].copy(), "times": times.astype(np.int64)})

    scratch = Scratch(documents.sparkSession, "op4")
    seen = documents.select("text").mapInArrow(run, "a long, b long, n long, times long")
    summed = scratch.keep(seen.groupBy("a", "b", "n").agg(F.sum("times").alias("times")))
    # The least count that no more entries reach than the table holds; counts from TOP on rank alike.
    bound, held = TOP + 1, 0
    for r in sorted(summed.groupBy(F.least("times", F.lit(TOP)).alias("level")).agg(F.count("*").alias("entries")).collect(), key=lambda r: -r.level):
        rest, held = FREQUENT - held, held + r.entries
        if held > FREQUENT:
            break
        bound = r.level
    level = F.least("times", F.lit(TOP))
    most = summed.where(level >= bound).collect()
    if held > FREQUENT:
        most += summed.where(level == r.level).take(rest)
    scratch.free(summed)
    columns = [np.array([r[j] for r in most], np.int64) for j in range(3)]
    count = library(path)
    tokens = [count(x.tobytes()[:n] if n <= 8 else x.tobytes() + y.tobytes()[16 - n :]) for x, y, n in zip(columns[0], columns[1], columns[2].tolist(), strict=True)]
    return columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2], np.array(tokens, np.int64)


def count_tokens(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of documents."""
    path = path or vocabulary_path(VOCABULARY)
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = Counter(path, frequent.value)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                tokens = counter.rows(data, offsets)
                yield pa.RecordBatch.from_pydict({id_column: batch.column(0).slice(a, b - a), "n_bytes": np.diff(offsets), "n_tokens": tokens, "over_limit": tokens > limit})

    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {dict(documents.dtypes)[id_column]}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return count_tokens(table(spark, sf_dir, "documents"))
