"""Cross-tokenizer alignment (operator 13).

Two tokenizers cut the same bytes differently. A transducer reads both token sequences: its state is the side that leads
and the bytes by which it does; the next token is always the lagging side's, and where nothing is left over the tokens
since the last such place are a group. Steps are memoised by state and token.

Texts are cut where both sides must have a boundary whatever stands around it (``cuts``): before a space or a line feed
after something that is no white space, and after a single line feed. So the transducer is empty there, and what it makes
of such a segment depends on the segment alone: distinct segments are encoded by the two libraries and aligned once a
worker, and rows are gathered from a table of them.

Every pair of ids that a group links is counted by the documents that hold it: a document's distinct pairs are written
once, with their number, and counted by partial sums. The counts go back in two tiers. The ``FREQUENT`` most frequent
pairs are broadcast (13 bytes each, so at most 7 MB) and looked up where the documents are, which leaves no pair of a
large share of the documents; the others are joined by a shuffle on the pair, of which none is hot any more.

Defined results: null and empty texts, and texts whose tokens don't give back a space and the text (those that hold the
piece vocabulary's sign for a space), have zeros and an empty digest; special strings are plain text; what is no UTF-8
reads as U+FFFD; very long texts are taken whole, a text without any cut is one segment; rows are documents, whatever
their ids, so repeated rows count twice; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .bpe import vocabulary_path
from .pieces import PieceTable
from .runtime import Scratch, table, tune

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Entries of the broadcast tier.
FREQUENT = 1 << 19
#: Counts from here on rank alike.
TOP = 100_000
#: Segments and steps that a worker remembers before it starts anew, and segments that the libraries get at once.
SEGMENTS, STEPS, BATCH = 1 << 18, 1 << 18, 1 << 12
#: ASCII marks that end a run of letters on both sides; an apostrophe may belong to a contraction.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: No cut is after a byte up to this one: ASCII white space and control characters.
_LOW = 0x20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """A byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet, names = byte_alphabet(), self.library.get_vocab(with_added_tokens=False)
        self.bytes = {k: bytes(alphabet[c] for c in name) for name, k in names.items() if all(c in alphabet for c in name)}
        self.size = self.library.get_vocab_size()

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(segments, add_special_tokens=False)]


class PieceSide:
    """A piece vocabulary of the ``sentencepiece`` library, which puts a space before what it encodes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        names = [self.library.id_to_piece(k) for k in range(self.size)]
        if any("▁" in name.lstrip("▁") or "\n" in name for name in names):
            raise ValueError("a piece spans a space or a line feed, so texts can't be aligned by segments")
        if any(x.isalpha() and y in PUNCTUATION for name in names for x, y in zip(name, name[1:], strict=False) if not name.startswith("<")):
            raise ValueError("a piece joins a letter with a punctuation mark, so texts can't be aligned by segments")
        self.bytes = {k: bytes([int(name[3:-1], 16)]) if self.library.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)}

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of what follows a place where a boundary is: the library's space and a line feed stand before it, and go."""
        return [x[2:] for x in self.library.encode(["\n" + s for s in segments], num_threads=1)]


class Transducer:
    """Groups of two token sequences. A state is the leading side (0 or 1) and the bytes that the other has still to give."""

    def __init__(self, first: dict[int, bytes], second: dict[int, bytes]) -> None:
        self.bytes = (first, second)
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # nothing left over: the first side is next
        self.known = {(1, b""): 0, (0, b""): 0}
        self.first_next = [True]
        self.steps: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after the lagging side's token; -1 if its bytes differ from those that are due."""
        lead, due = self.states[state]
        got = self.bytes[1 - lead].get(token)
        if got is None or not (due.startswith(got) or got.startswith(due)):
            return -1
        to = (lead, due[len(got) :]) if len(due) >= len(got) else (1 - lead, got[len(due) :])
        if to not in self.known:
            self.known[to] = len(self.states)
            self.states.append(to)
            self.first_next.append(bool(to[0]))
        return self.known[to]

    def ends(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end in both sequences, places at which nothing is left over; None if they aren't the same bytes."""
        if len(self.steps) > STEPS:
            self.restart()
        steps, first_next, out = self.steps, self.first_next, []
        state, i, j, na, nb = 0, 0, 0, len(a), len(b)
        while i < na or j < nb:
            if first_next[state]:
                if i == na:
                    return None
                key = state << 24 | a[i]
                i += 1
            else:
                if j == nb:
                    return None
                key = state << 24 | b[j]
                j += 1
            to = steps.get(key)
            if to is None:
                to = steps[key] = self._step(state, key & 0xFFFFFF)
            if to < 0:
                return None
            state = to
            if not state:
                out.append((i, j))
        return None if state else out

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The tokens of both sides in each group."""
        ends = self.ends(a, b)
        return None if ends is None else [(a[i:m], b[j:n]) for (i, j), (m, n) in zip([(0, 0), *ends], ends, strict=False)]


def linked(groups: list[tuple[list[int], list[int]]], size: int) -> dict[int, int]:
    """How often each pair of ids, as a * size + b, is linked. Repeated ids of a large group are multiplied, not gone through."""
    found: dict[int, int] = {}
    for a, b in groups:
        if len(a) * len(b) <= 64:
            for x in a:
                for y in b:
                    pair = x * size + y
                    found[pair] = found.get(pair, 0) + 1
        else:
            right = Counter(b).items()
            for (x, m), (y, n) in itertools.product(Counter(a).items(), right):
                found[x * size + y] = found.get(x * size + y, 0) + m * n
    return found


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(PUNCTUATION.encode())] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of segments of rows that begin with a space each: rows' starts, and places at which both sides have a
    boundary that doesn't depend on more than the segment.

    Spaces and line feeds after a character that is no white space, what follows a single line feed, and punctuation after
    an ASCII letter. Where a byte alone doesn't tell, there is no cut, which only makes a longer segment."""
    n = len(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~row[at]]
    before = data[at - 1]
    solid = before > _LOW
    high = np.flatnonzero(before >= 0x80)
    if len(high):  # U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
        b1, b2, b3 = before[high], data[at[high] - 2], data[np.maximum(at[high] - 3, 0)]
        two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        wide = (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
        rest = ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) | ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
        solid[high[two | wide | rest]] = False
    at = at[solid]
    after = at[data[at] == 0x0A] + 1
    after = after[after < n]
    after = after[~row[after]]
    follows = data[after]
    after = after[(follows > _LOW) & (follows != 0xC2) & ((follows < 0xE1) | (follows > 0xE3))]
    marks = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1  # a row begins with a space, so never a row's start
    row[at] = True
    row[after] = True
    row[marks] = True
    return np.flatnonzero(row[:-1])


class Aligner:
    """Aligned segments of one pair of vocabularies, for each worker."""

    def __init__(self, first: str, second: str) -> None:
        self.a, self.b = ByteSide(first), PieceSide(second)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.restart()

    def restart(self) -> None:
        self.numbers, self.texts = array("q"), []  # by segment: tokens, groups, links, is it broken
        self.pairs, self.times, self.bounds = array("q", [0]), array("q", [0]), array("q", [1])
        self.table = PieceTable(lambda piece: self._make_all([piece])[0], limit=SEGMENTS, make_all=self._make_all)

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[list[int], list[int]]] | None]]:
        """Numbers of tokens and groups of each text that begins with a space, or of a segment."""
        for a, b in zip(self.a.encode(texts), self.b.encode(texts), strict=True):
            yield len(a), len(b), self.transducer.groups(a, b)

    def _make_all(self, segments: list[bytes]) -> list[int]:
        size, at = self.b.size, len(self.texts)
        some = [[s.decode() for s in segments[k : k + BATCH]] for k in range(0, len(segments), BATCH)]
        for n_a, n_b, groups in itertools.chain.from_iterable(map(self.align, some)):
            if groups is None:
                self.numbers.extend((0, 0, 0, 0, 1))
                self.texts.append("")
            else:
                found = linked(groups, size)
                self.numbers.extend((n_a, n_b, len(groups), sum(found.values()), 0))
                self.texts.append(";".join([f"{str(a)[1:-1]}|{str(b)[1:-1]}" for a, b in groups]).replace(" ", ""))
                self.pairs.extend(found)
                self.times.extend(found.values())
            self.bounds.append(len(self.pairs))
        return [*range(at, len(self.texts))]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of each row, digests, and the distinct pairs with their times and bounds by row."""
        if len(self.texts) > SEGMENTS:
            self.restart()
        n, full = len(offsets) - 1, np.diff(offsets) > 0
        shifted = offsets + np.arange(n + 1)
        spaced = np.insert(data, offsets[:-1], 0x20)
        starts = cuts(spaced, shifted)
        rows = self.table.rows(spaced, starts, np.concatenate([starts[1:], [len(spaced)]]).astype(np.int64)[: len(starts)])
        first = np.searchsorted(starts, shifted, "left")
        # Views of the growing arrays; they are gone before the next segment is added.
        numbers = np.frombuffer(self.numbers, np.int64).reshape(-1, 5)[rows]
        counts = np.stack([K.row_sums(np.ascontiguousarray(numbers[:, k]), first) for k in range(5)], axis=1)
        good = full & (counts[:, 4] == 0)
        texts, at = self.texts, rows.tolist()
        digests = [hashlib.sha256(";".join([texts[k] for k in at[i:j]]).encode()).hexdigest() if ok else "" for ok, i, j in zip(good.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
        bounds = np.frombuffer(self.bounds, np.int64)
        low, length = bounds[rows], bounds[rows + 1] - bounds[rows]
        owner = np.repeat(np.arange(n), np.diff(first))
        length = np.where(good[owner], length, 0)
        places = K.ragged(low, length)
        space = self.a.size * self.b.size
        key = np.repeat(owner, length) * space + np.frombuffer(self.pairs, np.int64)[places]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.add.reduceat(np.frombuffer(self.times, np.int64)[places][order], heads) if len(heads) else np.zeros(0, np.int64)
        key = key[heads]
        return np.where(good[:, None], counts[:, :4], 0), digests, key % space, times, np.searchsorted(key, np.arange(n + 1) * space)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _aligners:
        _aligners.clear()
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def groups(documents: DataFrame, first: str | None = None, second: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, groups array<struct<a array<int>, b array<int>>>): the aligned tokens of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(first or vocabulary_path(BYTE_VOCABULARY), second or vocabulary_path(PIECE_VOCABULARY))
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            out = []
            for text in K.strings(batch.column(1)):
                ((_, _, whole),) = own.align([" " + text]) if text else ((0, 0, None),)
                out.append([{"a": a, "b": b} for a, b in whole or []])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [id_column, "groups"])

    return documents.select(id_column, "text").mapInArrow(run, f"{id_column} {dict(documents.dtypes)[id_column]}, groups array<struct<a: array<int>, b: array<int>>>")


def aligned(documents: DataFrame, first: str | None = None, second: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): numbers of each document, and its distinct linked
    pairs, as one number each, with how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(first or vocabulary_path(BYTE_VOCABULARY), second or vocabulary_path(PIECE_VOCABULARY))
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                counts, digests, pairs, times, bounds = own.rows(*K.valid_text(data, offsets)[:2])
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (pairs, times)]
                columns = [batch.column(0).slice(i, j - i), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4)], pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = f"{id_column} {dict(documents.dtypes)[id_column]}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return documents.select(id_column, "text").mapInArrow(run, schema)


def most_frequent(counts: DataFrame, entries: int, top: int = TOP) -> pa.Table:
    """At most so many rows of (pair, n, best), of the largest n; which of equal ones are in doesn't matter to the result."""
    level = F.least("n", F.lit(top))
    bound, held = top + 1, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("entries")).collect(), key=lambda r: -r.level):
        if held + r.entries > entries:  # this level fits in part only
            whole, part = counts.where(level >= bound).toArrow(), counts.where(level == r.level).limit(entries - held).toArrow()
            return pa.concat_tables([whole, part])
        held, bound = held + r.entries, r.level
    return counts.where(level >= bound).toArrow()


def align(documents: DataFrame, scratch: Scratch, first: str | None = None, second: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of documents."""
    size = PieceSide(second or vocabulary_path(PIECE_VOCABULARY)).size
    each = scratch.keep(aligned(documents, first, second, id_column))
    counts = scratch.keep(each.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    # One row for an id of the first vocabulary at most.
    of_a = F.expr(f"pair div {size}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    counts = scratch.keep(counts.join(F.broadcast(most), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    top = most_frequent(counts, FREQUENT).sort_by("pair")
    known = documents.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    carried = [id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            if len(pair):
                at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                hit = pair[at] == own
                sums = [K.row_sums(times * (hit & best[at]), bounds), K.row_sums(times * np.where(hit, n[at], 0), bounds)]
            else:
                hit, sums = np.zeros(len(own), bool), [np.zeros(batch.num_rows, np.int64)] * 2
            misses = np.concatenate([[0], np.cumsum(~hit)])[bounds]
            rest = [pa.ListArray.from_arrays(pa.array(misses, pa.int32()), pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *map(pa.array, sums), *rest], [*carried, "n_best", "count_sum", "pairs", "times"])

    kinds = dict(each.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", n_best long, count_sum long, pairs array<long>, times array<long>"
    looked = scratch.keep(each.mapInArrow(look, schema).withColumn("uid", F.monotonically_increasing_id()))
    missed = looked.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = missed.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    more = [(F.col(c) + F.coalesce(f"more_{k}", zero)).alias(c) for c, k in (("n_best", "best"), ("count_sum", "sum"))]
    return looked.drop("pairs", "times").join(rest, "uid", "left").select(id_column, "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return align(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))
