"""Fuzzy line dedup by MinHash (operator 7).

A line is the text between two line feeds. It is normalised (A-Z lower-cased, runs of white space as one space, none at
the ends); a line without words is blank and always stays. Equal normalised lines are one line. A line's set holds its
shingles of eight characters; a shorter one is a shingle itself. Signatures, banding, exact verification (Jaccard
similarity of 0.8 or more on the full sets) and the grouping of links into components are those of ``neardup``. Of each
component the line that comes first stays (least document id, then least line number); the others are removed with
their line feeds, and their numbers come back.

The sets are shingles of characters, so the threshold for word shingles doesn't apply; with 10 bands of 4 slots a pair
at 0.8 meets with a probability of 0.995, at 0.9 of 0.9999.

Defined results: a null text stays null; an empty one has one blank line; rows that share an id are one document, and
equal lines at the same place of them stay or go together; a row without an id keeps all its lines, and they rank first,
so that no other line of their groups stays; lines are taken whole; what is no UTF-8 reads as U+FFFD and stays as it is; an empty table gives an empty result; other columns are kept by ``dedup_lines``, but for one named
``removed_lines``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .neardup import Fetch, Method, band_names, bands_of, links
from .runtime import Scratch, table, tune

SHINGLE = 8
#: Normalised characters: white space is one, A-Z are a-z. Characters beyond 255 are kept beside the bytes.
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[[0x20, *range(0x09, 0x0E)]] = 32
_NORMAL[65:91] += 32
#: Bytes of text handled at once: few enough for a cache, enough to outweigh what an array operation costs by itself.
CHUNK = 1 << 18
#: Rounds of signatures that a chunk's lines get at once. Lines that need more (short ones as a rule) wait until they have
#: HELD shingles or more, as a round costs some array operations however few lines are in it.
ROUNDS, HELD = 2, 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Lines:
    """Normalised lines of some rows, those without words left out. ``text``: one byte a character, with eight more at the
    end; ``start`` and ``size`` in characters; ``row``; ``number`` in the row, from 0. Characters beyond 255 are 255 in
    ``text``; ``wide`` has their lines, places in the line, and code points."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    number: np.ndarray
    wide: tuple[np.ndarray, np.ndarray, np.ndarray] | None

    @property
    def eights(self) -> np.ndarray:
        """The eight characters from each place on as one number."""
        return np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,))


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    data, offsets, text = K.valid_text(data, offsets)
    points = None
    if text.isascii():
        chars = data
    else:
        offsets = offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        try:
            chars = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            chars = np.minimum(points, 255).astype(np.uint8)
    n = len(chars)
    white = (chars == 32) | (chars - np.uint8(9) < 5)
    drop = white.copy()
    drop[1:] &= white[:-1]  # one space for each run between words, and at an end
    heads = offsets[:-1][offsets[:-1] < n]
    drop[heads] = white[heads]
    gone = np.flatnonzero(drop)
    feeds = np.flatnonzero(chars == 10)
    starts = np.sort(np.concatenate([heads, feeds + 1]))
    starts = starts[(starts < n) & np.concatenate([np.ones(min(1, len(starts)), bool), starts[1:] != starts[:-1]])]
    ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
    marked = np.where(white, np.uint8(32), chars)
    marked[gone] = 9  # no other tab is left
    out = np.frombuffer(marked.tobytes().translate(_NORMAL.tobytes(), b"\t") + bytes(SHINGLE), np.uint8)
    start, end = starts - np.searchsorted(gone, starts), ends - np.searchsorted(gone, ends)
    size = end - start
    size -= (size > 0) & (out[end - 1] == 32)
    row = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[row])
    full = size > 0
    start, size, row, number = start[full], size[full], row[full], number[full]
    wide = None
    if points is not None:
        found = np.flatnonzero(points > 255)
        places = found - np.searchsorted(gone, found)
        line = np.searchsorted(start, places, "right") - 1
        wide = line, places - start[line], points[found].astype(np.uint64)
    return Lines(out, start, size, row, number, wide)


def line_shingles(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of SHINGLE characters as they stand in the lines, repeats included, and their bounds by line.

    Eight characters up to 255 are their own hash; one beyond adds a random number for its code point and place."""
    made = np.maximum(lines.size - SHINGLE + 1, 1)
    bounds = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=bounds[1:])
    inside = np.zeros(len(lines.text) - SHINGLE + 1, np.int8)  # the ends of lines are no starts of shingles
    inside[lines.start] += 1
    inside[lines.start + made] -= 1
    values = lines.eights[np.cumsum(inside, dtype=np.int8).view(bool)]
    short = np.flatnonzero(lines.size < SHINGLE)
    values[bounds[short]] &= _ALL >> (np.uint64(64) - np.uint64(8) * lines.size[short].astype(np.uint64))
    with np.errstate(over="ignore"):
        if lines.wide is not None:
            line, place, point = lines.wide
            for k in range(SHINGLE):  # the character is the k-th of its window
                inside = (place >= k) & (place - k < made[line])
                values[bounds[line[inside]] + place[inside] - k] += K.mix(point[inside] * np.uint64(SHINGLE) + np.uint64(k))
        values[bounds[short]] = K.mix(values[bounds[short]] + lines.size[short].astype(np.uint64))
    return values, bounds


def line_digests(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line, as two columns: sums over its blocks of eight characters, with their places."""
    blocks = (lines.size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    values = lines.eights[np.repeat(lines.start, blocks) + 8 * place]
    values[first + blocks - 1] &= _ALL >> ((8 * blocks - lines.size) * 8).astype(np.uint64)
    place, size, out = place.astype(np.uint64), lines.size.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for factor, c in ((1, 0x9E3779B97F4A7C15), (0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F)):
            sums = np.add.reduceat(K.mix(values * np.uint64(factor) + place * np.uint64(c)), first) if len(first) else np.zeros(0, np.uint64)
            if lines.wide is not None:
                line, at, point = lines.wide
                np.add.at(sums, line, K.mix(point * np.uint64(factor) + K.mix((at + 1).astype(np.uint64) * np.uint64(c))))
            out.append(K.mix(sums + size).view(np.int64))
    return out[0], out[1]


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of rows that hold one line each: sorted hashes of 48 bits, and their bounds."""
    return described(data, offsets)[:2]


def described(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and what their signatures are made from: the shingles with repeats, and their bounds."""
    lines = read_lines(data, offsets)
    values, bounds = line_shingles(lines)
    by_row = _by_row(lines, bounds, len(offsets) - 1)
    return *K.distinct_short(K.mix(values), by_row), values, by_row


def _by_row(lines: Lines, bounds: np.ndarray, rows: int) -> np.ndarray:
    return bounds[np.searchsorted(lines.row, np.arange(rows + 1))]


METHOD = Method(sets=line_sets, part=80, bands=10, sketch_slots=32, described=described, short=True)


def _lines(documents: DataFrame, id_column: str) -> DataFrame:
    """(id, line, hi, lo, bands) of all lines that aren't blank; the bands are null for lines that a batch has before."""
    names = ["id", "line", "hi", "lo", *band_names(METHOD)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            columns = [pa.concat_arrays(x) for x in zip(*[h[0] for h in held], strict=True)]
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))])
            bands = bands_of(K.super_minhash(np.concatenate([h[1] for h in held]), bounds, METHOD.slots))
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, bands)], names)

        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for a, _, data, offsets in K.chunks(batch.column(1), CHUNK):
                lines = read_lines(data, offsets)
                hi, lo = line_digests(lines)
                own = zip(hi.tolist(), lo.tolist(), strict=True)
                new = np.array([not (k in seen or seen.add(k)) for k in own], bool)
                columns = [batch.column(0).take(pa.array(lines.row + a)), pa.array(lines.number.astype(np.int32)), pa.array(hi), pa.array(lo)]
                values, bounds = line_shingles(_chosen(lines, new))
                sig, unfinished = K.super_minhash_rounds(values, bounds, METHOD.slots, ROUNDS)
                bands, place = bands_of(sig), np.where(new, np.cumsum(new) - 1, 0)
                if unfinished.any():
                    counts = np.diff(bounds)[unfinished]
                    waits = np.zeros(len(new), bool)
                    waits[new] = unfinished
                    held.append(([x.filter(pa.array(waits)) for x in columns], values[K.ragged(bounds[:-1][unfinished], counts)], counts))
                    columns = [x.filter(pa.array(~waits)) for x in columns]
                    new, place = new[~waits], place[~waits]
                columns += [pa.array(b[place] if len(b) else np.zeros(len(place), np.int64), mask=~new) for b in bands]
                yield pa.RecordBatch.from_arrays(columns, names)
                if sum(len(h[1]) for h in held) >= HELD:
                    yield close()
        if held:
            yield close()

    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, "text").mapInArrow(run, f"id {kind}, line int, " + ", ".join(f"{k} long" for k in names[2:]))


def _chosen(lines: Lines, chosen: np.ndarray) -> Lines:
    return Lines(lines.text, lines.start[chosen], lines.size[chosen], lines.row[chosen], lines.number[chosen], _of(lines.wide, chosen))


def _of(wide: tuple[np.ndarray, np.ndarray, np.ndarray] | None, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The characters beyond 255 of the chosen lines."""
    if wide is None:
        return None
    inside = chosen[wide[0]]
    return (np.cumsum(chosen) - 1)[wide[0][inside]], wide[1][inside], wide[2][inside]


def _place(kind: T.DataType) -> tuple[Column, Callable[[str], tuple[Column, Column]]]:
    """A value that orders places by id and line (null without id), and how to get both back from it.

    For integers it is one number, which Spark aggregates by hash."""
    if not isinstance(kind, T.IntegralType):
        return F.when(F.col("id").isNotNull(), F.struct("id", "line")), lambda c: (F.col(f"{c}.id"), F.col(f"{c}.line"))
    size = F.lit(1 << 32).cast("decimal(10,0)")
    line = lambda c: F.pmod(F.col(c), size)
    return F.col("id").cast("decimal(20,0)") * size + F.col("line"), lambda c: (((F.col(c) - line(c)) / size).cast(kind), line(c).cast("int"))


def _fetch(scratch: Scratch, units: DataFrame, documents: DataFrame, id_column: str, named: list[DataFrame]) -> Fetch:
    """Texts of lines, cut from the documents of their first occurrences; a document is read once for all its lines. What
    units say of the wanted lines is left in ``named``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = [], []
            for wanted, text in zip(batch.column(0).to_pylist(), K.strings(batch.column(1)), strict=True):
                lines = (text or "").split("\n")
                for x in wanted:
                    if x["line"] < len(lines):
                        uids.append(x["uid"])
                        texts.append(lines[x["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(texts, pa.string())], ["uid", "text"])

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(0), CHUNK):
                lines = read_lines(data, offsets)
                whole = [(x or "").split("\n") for x in K.strings(batch.column(0).slice(a, b - a))]
                texts = [whole[r][k] for r, k in zip(lines.row.tolist(), lines.number.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, line_digests(lines)), pa.array(texts, pa.string())], ["hi", "lo", "text"])

    def fetch(wanted: DataFrame) -> DataFrame:
        named.append(scratch.keep(wanted.join(units.select("uid", "hi", "lo", "place", "nameless", "n"), "uid")))
        places = named[0].where("place is not null")
        of_place = _place(documents.schema[id_column].dataType)[1]
        by_document = places.select("uid", of_place("place")[0].alias("__id"), of_place("place")[1].alias("line")).groupBy("__id").agg(F.collect_list(F.struct("uid", "line")).alias("wanted"))
        whole = documents.select(F.col(id_column).alias("__id"), "text").join(by_document.hint("shuffle_hash"), "__id")  # one row a document: texts needn't be sorted
        out = whole.select("wanted", "text").mapInArrow(run, "uid long, text string")
        lost = named[0].where("place is null")
        if lost.isEmpty():
            return out
        # Lines of rows without id only: those rows are read again and told by their digests.
        found = documents.where(F.col(id_column).isNull()).select("text").mapInArrow(nameless, "hi long, lo long, text string")
        found = found.join(lost.select("hi", "lo", "uid"), ["hi", "lo"])
        return out.unionByName(found.select("uid", "text").dropDuplicates(["uid"]))

    return fetch


def removed_lines(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id") -> DataFrame:
    """(id, lines array<int>): numbers of the lines to remove, by document that has any."""
    place, _ = _place(documents.schema[id_column].dataType)
    found, bands = scratch.keep(_lines(documents, id_column)), band_names(METHOD)
    units = found.groupBy("hi", "lo").agg(
        F.min(place).alias("place"), F.max(F.col("id").isNull()).alias("nameless"), F.count("*").alias("n"), *[F.first(k, ignorenulls=True).alias(k) for k in bands]
    )
    units = scratch.keep(units.withColumn("uid", F.monotonically_increasing_id()))
    named: list[DataFrame] = []
    component = links(scratch, units.select("uid", *bands), _fetch(scratch, units, documents, id_column, named), METHOD)
    # A line that occurs once and links with nothing has nothing to remove; who links is among the wanted lines.
    columns = ["uid", "hi", "lo", "place", "nameless", "n"]
    several = units.where("n > 1").select(columns).unionByName(named[0].where("n = 1").select(columns))
    placed = several.join(component, "uid", "left").where("n > 1 or component is not null")
    placed = scratch.keep(placed.withColumn("component", F.coalesce("component", "uid")))
    scratch.free(units)
    # Rows without id rank first: beside a line of theirs, no other stays.
    keeper = F.when(~F.max("nameless"), F.min("place"))
    least = scratch.keep(placed.groupBy("component").agg(keeper.alias("keeper")))
    keeper = scratch.keep(placed.join(least, "component").select("hi", "lo", "keeper"))
    places = found.select("id", "line", "hi", "lo").where("id is not null").join(keeper, ["hi", "lo"]).where(~place.eqNullSafe(F.col("keeper")))
    return places.groupBy(F.col("id").alias("__lines_id")).agg(F.collect_list("line").alias("__lines"))


def dedup_lines(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id", report: bool = True) -> DataFrame:
    """documents without the removed lines; with ``report`` also ``removed_lines``: their numbers in the original text, from 0."""
    removed = removed_lines(documents, scratch, id_column)
    documents = documents.drop("removed_lines") if report else documents
    joined = documents.join(removed.hint("shuffle_hash"), F.col(id_column) == F.col("__lines_id"), "left").drop("__lines_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            gone = [sorted(set(numbers)) if numbers else [] for numbers in batch.column("__lines").to_pylist()]
            changed = [k for k, out in enumerate(gone) if out]
            texts = column
            if changed:
                new = []
                # As bytes: what is no UTF-8 stays as it is.
                for k, text in zip(changed, column.take(pa.array(changed)).cast(pa.binary()).to_pylist(), strict=True):
                    drop = set(gone[k])
                    new.append(b"\n".join([x for j, x in enumerate((text or b"").split(b"\n")) if j not in drop]))
                mask = np.zeros(len(gone), bool)
                mask[changed] = True
                new = pa.Array.from_buffers(column.type, len(new), pa.array(new, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).buffers())
                texts = pc.replace_with_mask(column, pa.array(mask), new)
            names = [x for x in batch.schema.names if x != "__lines"]
            arrays = [texts if x == "text" else batch.column(x) for x in names]
            if report:
                names, arrays = [*names, "removed_lines"], [*arrays, pa.array(gone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [*documents.schema.fields, *([T.StructField("removed_lines", T.ArrayType(T.IntegerType()))] if report else [])]
    return joined.mapInArrow(run, T.StructType(fields))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op7"))
