"""Substring dedup by hashing of units (operator 9).

A unit is a whole line, or a window of 16 words. Units are normalised (A-Z lower-cased, white space ignored), their
128-bit digests are grouped globally, the occurrence in the document of least id (and there the first) stays, and the
bytes of all others are removed. The removed ranges come back as byte offsets of the original text.

Lines alone would miss a passage that was pasted into a line, so windows are units too. Of the windows of a text those
are taken whose digest is the least of 16 successive ones (winnowing): two texts that share 31 words or more share a
taken window, wherever the words stand, for two units in 17 words. Ranges that touch are joined, and only joined ranges
of at least ``MIN_WORDS`` words are removed, so that short common phrases and lines stay (operator 7 is the one for those). A repeated passage of more
than 50 words always has such a range; up to 15 words at either end of it may stay.

Occurrences of a digest are counted before the shuffle, only digests of more than one occurrence are written, and the
join back is split over tasks where one digest has very many occurrences.

Defined results: a null text gives a null text and nothing removed; an empty one is unchanged; rows that share an id are
one document, and no later one of another; a row without an id is left as it is; repeats inside a document go as well;
texts are taken whole; an empty table gives an empty result; other columns are kept by ``remove_repeats``, but for one
named ``removed``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .runtime import Scratch, table, tune

WINDOW = 16
WINNOW = 16
MIN_WORDS = 20


def _digests(words_a: np.ndarray, words_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of all windows of ``width`` words, by doubling."""
    with np.errstate(over="ignore"):
        out = []
        for w, c in ((words_a, 0x9E3779B97F4A7C15), (words_b, 0xC2B2AE3D27D4EB4F)):
            step = 1
            while step < width:
                w = K.mix(w[:-step] * np.uint64(c) + w[step:]) if len(w) > step else w[:0]
                step *= 2
            out.append(w)
        return out[0], out[1]


def winnowed(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of the values that are least of WINNOW successive ones of their row (of all, where a row has fewer); the
    first one of equals."""
    if not len(values):
        return np.zeros(0, np.int64)
    least, index, step = values, np.arange(len(values)), 1
    while step < WINNOW:
        if len(least) <= step:
            least = index = index[:0]
            break
        earlier = least[:-step] <= least[step:]
        index = np.where(earlier, index[:-step], index[step:])
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    chosen = np.zeros(len(values), bool)
    row = np.repeat(np.arange(len(first)), count)
    if len(least):
        inside = row[: len(least)] == row[WINNOW - 1 :]
        chosen[index[inside]] = True
    few = np.flatnonzero((count > 0) & (count < WINNOW))
    if len(few):
        at = K.ragged(first[few], count[few])
        bounds = np.cumsum(count[few]) - count[few]
        is_least = np.flatnonzero(values[at] == np.repeat(np.minimum.reduceat(values[at], bounds), count[few]))
        chosen[at[is_least[np.unique(np.searchsorted(bounds, is_least, "right"), return_index=True)[1]]]] = True
    return np.flatnonzero(chosen)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, digest high, low, byte start, byte end, seen before in the row?) of the lines and taken windows."""
    starts, ends = K.spans_of_words(data, offsets)
    first = K.rows_of(starts, offsets)
    a = K.hash_spans(data, starts, ends, K.LOWER_TABLE)
    table_b = K.BYTE_TABLE_2.copy()
    table_b[65:91] = K.BYTE_TABLE_2[97:123]
    b = K.hash_spans(data, starts, ends, table_b)
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(first))
    # Windows.
    hi, lo = _digests(a, b, WINDOW)
    count = np.maximum(np.diff(first) - WINDOW + 1, 0)
    at = K.ragged(first[:-1], count)
    packed_first = np.cumsum(count) - count
    picked = at[winnowed(hi[at], packed_first, count)] if len(at) else at
    # Lines of at least MIN_WORDS words: running sums of mixed words, so that equal sequences have equal digests.
    newline = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=newline[1:])
    line = newline[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    tails = np.concatenate([heads[1:], [len(starts)]]).astype(np.int64)
    long = tails - heads >= MIN_WORDS
    heads, tails = heads[long], tails[long]
    line_hi, line_lo = np.zeros(len(heads), np.uint64), np.zeros(len(heads), np.uint64)
    if len(heads):
        inside = K.ragged(heads, tails - heads)
        place = (inside - np.repeat(heads, tails - heads)).astype(np.uint64)
        cuts = np.cumsum(tails - heads) - (tails - heads)
        with np.errstate(over="ignore"):
            line_hi = K.mix(np.add.reduceat(K.mix(a[inside] + place * np.uint64(0x9E3779B97F4A7C15)), cuts) + np.uint64(1))
            line_lo = K.mix(np.add.reduceat(K.mix(b[inside] + place * np.uint64(0xC2B2AE3D27D4EB4F)), cuts) + np.uint64(1))
    out_row = np.concatenate([row[picked], row[heads]])
    out_hi, out_lo = np.concatenate([hi[picked], line_hi]), np.concatenate([lo[picked], line_lo])
    out_start = np.concatenate([starts[picked], starts[heads]])
    out_end = np.concatenate([ends[picked + WINDOW - 1], ends[tails - 1]])
    with np.errstate(over="ignore"):
        key = K.mix(out_hi + K.mix(out_lo + out_row.astype(np.uint64)))
    order = np.lexsort((out_start, key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return out_row, out_hi, out_lo, out_start - offsets[out_row], out_end - offsets[out_row], again


def _units(documents: DataFrame, id_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in K.chunks(batch.column(1)):
                row, hi, lo, start, end, again = units(data, offsets)
                ids = batch.column(0).take(pa.array(row + a))
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), ids, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(again)], ["hi", "lo", "id", "start", "end", "again"])

    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, "text").mapInArrow(run, f"hi long, lo long, id {kind}, start int, end int, again boolean")


def repeated_ranges(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id") -> DataFrame:
    """(__ranges_id, __ranges array<struct<start,end>>): byte ranges of units that occur before, by document."""
    found = _units(documents, id_column)
    shared = scratch.keep(found.groupBy("hi", "lo").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "keeper"))
    later = found.join(shared, ["hi", "lo"]).where("id > keeper or again")
    # The ranges of one document are no more than its text.
    return later.groupBy(F.col("id").alias("__ranges_id")).agg(F.collect_list(F.struct("start", "end")).alias("__ranges"))


def _joined(ranges: list[dict] | None, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined over white space, of MIN_WORDS words at least. starts, ends: the text's words."""
    if not ranges:
        return []
    low = np.array([r["start"] for r in ranges])
    high = np.array([r["end"] for r in ranges])
    flags = np.zeros(len(starts) + 1, np.int64)
    np.add.at(flags, np.searchsorted(starts, low), 1)
    np.add.at(flags, np.searchsorted(ends, high, "left") + 1, -1)
    covered = np.concatenate([[False], np.cumsum(flags)[:-1] > 0, [False]])
    change = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(starts[i]), int(ends[j - 1])) for i, j in zip(change[::2], change[1::2], strict=True) if j - i >= MIN_WORDS]


_REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def remove_repeats(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id") -> DataFrame:
    """documents with the repeats cut out of ``text``, and ``removed``: the byte ranges of the original text that went."""
    ranges = repeated_ranges(documents, scratch, id_column)
    documents = documents.drop("removed")
    joined = documents.join(ranges, F.col(id_column) == F.col("__ranges_id"), "left").drop("__ranges_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            texts, removed = column.cast(pa.binary()).to_pylist(), []  # bytes: what is no UTF-8 stays as it is
            for k, ranges in enumerate(batch.column("__ranges").to_pylist()):
                gone: list[tuple[int, int]] = []
                if ranges and texts[k]:
                    raw = texts[k]
                    gone = _joined(ranges, *K.spans_of_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
                    if gone:
                        at, parts = 0, []
                        for i, j in gone:
                            parts.append(raw[at:i])
                            at = j
                        texts[k] = b"".join([*parts, raw[at:]])
                removed.append([{"start": i, "end": j} for i, j in gone])
            names = [x for x in batch.schema.names if x != "__ranges"]
            made = pa.array(texts, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            made = pa.Array.from_buffers(column.type, len(made), made.buffers(), made.null_count)
            arrays = [made if x == "text" else batch.column(x) for x in names]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, kind)], [*names, "removed"])

    return joined.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("removed", _REMOVED)]))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op9"))
    return out.withColumn("changed", F.size("removed") > 0)
