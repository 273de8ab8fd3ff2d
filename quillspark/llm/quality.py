"""Quality rules as a short-circuit cascade (operator 8).

Rules are cheap predicates over features of a whole text. On a bounded sample (``sample_rows``, the only use of a
sample) the rule with the most rejections per second is chosen first, then the best one on the rows that it leaves, with
the features that are known by then, and so on; rules run in this order, and a row that one rule rejects is not seen by
later ones. The order changes only the cost; a row is kept when no
rule rejects it, so the verdict is the same for any order and any sample.

Defined results: a null text is an empty one; an empty text has no words and fails the base rule; the features are of
the whole text whatever its length; equal rows give equal rows; other columns are carried or ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as K
from .runtime import table, tune

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
IS_ASCII_LETTER = np.zeros(256, bool)
IS_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_ASCII_LETTER[128:] = True  # letters beyond ASCII: any byte of a longer sequence counts as one


class Features:
    """Features of a run of rows, each computed at first use, for the rows that are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.have = data, offsets, {}
        self.n = len(offsets) - 1

    def get(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have[name] = getattr(self, f"_{name}")()
        return self.have[name]

    def subset(self, rows: np.ndarray) -> Features:
        """The same for some rows; what is known already is kept."""
        if len(rows) == self.n:
            return self
        lengths = np.diff(self.offsets)[rows]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        out = Features(self.data[K.ragged(self.offsets[rows], lengths)], offsets)
        out.have = {k: v[rows] for k, v in self.have.items() if k[0] != "_"}
        return out

    def _per_row(self, flags: np.ndarray) -> np.ndarray:
        return K.row_sums(flags.astype(np.int64), self.offsets)

    def _spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "_spans" not in self.have:
            starts, ends = K.spans_of_words(self.data, self.offsets)
            self.have["_spans"] = starts, ends, K.rows_of(starts, self.offsets)
        return self.have["_spans"]

    def _n_words(self) -> np.ndarray:
        return np.diff(self._spans()[2])

    def _word_chars(self) -> np.ndarray:
        return self._per_row(~K.IS_SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._per_row(IS_SYMBOL[self.data])

    def _n_letter_words(self) -> np.ndarray:
        starts, ends, first = self._spans()
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(IS_ASCII_LETTER[self.data], out=sums[1:])
        return K.row_sums((sums[ends] > sums[starts]).astype(np.int64), first)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of the lines that hold a word, in order."""
        if "_lines" not in self.have:
            edge = np.union1d(self.offsets[:-1], np.flatnonzero(self.data == 10) + 1)
            starts = edge[edge < len(self.data)] if len(self.data) else edge[:0]
            ends = np.concatenate([starts[1:], [len(self.data)]]) if len(starts) else starts
            ends = ends - (self.data[ends - 1] == 10) if len(starts) else ends
            sums = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(~K.IS_SPACE[self.data], out=sums[1:])
            full = sums[ends] > sums[starts]
            starts, ends = starts[full], ends[full]
            row = np.searchsorted(self.offsets, starts, "right") - 1
            self.have["_lines"] = row, K.hash_spans(self.data, starts, ends)
        return self.have["_lines"]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self._lines()[0], minlength=self.n)

    def _n_dup_lines(self) -> np.ndarray:
        row, value = self._lines()
        with np.errstate(over="ignore"):
            key = K.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return np.bincount(row[~first], minlength=self.n)

    def _n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self._spans()
        n = len(starts)
        if n < 3:
            return np.zeros(self.n, np.int64)
        w = K.hash_spans(self.data, starts, ends)
        row = np.repeat(np.arange(self.n), np.diff(first))
        with np.errstate(over="ignore"):
            key = K.mix(w[:-2] + np.uint64(0x9E3779B97F4A7C15) * K.mix(w[1:-1] + np.uint64(0xD1B54A32D192ED03) * K.mix(w[2:] + row[2:].astype(np.uint64))))
        at = np.flatnonzero(row[:-2] == row[2:])
        key = key[at]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[at[twice] + k] = True
        return np.bincount(row[covered], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    """``rejects``: from features, which rows go."""

    name: str
    rejects: Callable[[Features], np.ndarray]


def too_short(f: Features) -> np.ndarray:
    return f.get("n_words") < 50


def too_repetitive(f: Features) -> np.ndarray:
    return 100 * f.get("n_repeat_words") > 50 * f.get("n_words")


def too_many_symbols(f: Features) -> np.ndarray:
    return 10 * f.get("n_symbols") > f.get("n_words")


def too_many_equal_lines(f: Features) -> np.ndarray:
    return 2 * f.get("n_dup_lines") > f.get("n_lines")


def odd_word_length(f: Features) -> np.ndarray:
    chars, words = f.get("word_chars"), f.get("n_words")
    return (chars < 2 * words) | (chars > 40 * words)


def too_few_letters(f: Features) -> np.ndarray:
    return 10 * f.get("n_letter_words") < 7 * f.get("n_words")


BASE = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))
RULES = (
    Rule("too_many_symbols", too_many_symbols),
    Rule("too_many_equal_lines", too_many_equal_lines),
    Rule("odd_word_length", odd_word_length),
    Rule("too_few_letters", too_few_letters),
)


def cascade(f: Features, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which rows no rule rejects; each rule sees only what the ones before it have kept."""
    alive = np.arange(f.n)
    for rule in rules:
        if not len(alive):
            break
        part = f.subset(alive)
        stays = ~rule.rejects(part)
        alive, f = alive[stays], part.subset(np.flatnonzero(stays))
    return alive


def greedy_order(f: Features, rules: tuple[Rule, ...]) -> list[tuple[int, float, int, int]]:
    """(rule, seconds, rejected, seen): one after the other, the rule with the most rejections per second on the rows that
    the chosen ones leave, with the features that these have computed already: the state that it will meet."""
    left, order = list(range(len(rules))), []
    while left:
        tried = []
        for k in left:
            own = Features(f.data, f.offsets)
            own.have = dict(f.have)
            began = time.thread_time()
            gone = rules[k].rejects(own)
            spent = time.thread_time() - began
            # Laplace's rule keeps a rule that rejects nothing in the sample comparable by cost.
            tried.append(((int(gone.sum()) + 1) / (f.n + 2) / (spent + 1e-6), -k, spent, gone, own))
        _, k, spent, gone, own = max(tried, key=lambda x: x[:2])
        order.append((-k, spent, int(gone.sum()), f.n))
        left.remove(-k)
        f = own.subset(np.flatnonzero(~gone))
    return order


def order_rules(documents: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 1000, computed: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules in the order of ``greedy_order`` on at most ``sample_rows`` rows, those that the first task with rows reads
    first. ``computed``: features that all rows have before the cascade.

    No more tasks run than it takes to find some rows, and only some numbers a rule reach the driver.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in batches:
            texts.append(batch.column(0).slice(0, sample_rows - sum(map(len, texts))))
            if sum(map(len, texts)) >= sample_rows:
                break
        if not sum(map(len, texts)):
            return
        f = Features(*K.flat(pa.chunked_array(texts)))
        for name in computed:
            f.get(name)
        order = greedy_order(f, rules)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array([k for k, *_ in order], pa.int32())], ["place", "rule"])

    got = documents.select("text").mapInArrow(measure, "place int, rule int").take(len(rules))
    order = [r.rule for r in sorted(got, key=lambda r: r.place)]
    return tuple(rules[k] for k in order) if len(order) == len(rules) else rules


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = BASE + RULES) -> DataFrame:
    """The rows of documents that no rule rejects, all columns unchanged. Rejected rows cost only the rules up to the first that rejects."""
    rules = order_rules(documents, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                yield batch.slice(a, b - a).take(pa.array(cascade(Features(data, offsets), rules)))

    return documents.mapInArrow(run, documents.schema)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(documents: DataFrame, id_column: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics and verdict of each row of documents."""
    rules = order_rules(documents, rules, computed=METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                f = Features(data, offsets)
                metrics = {k: f.get(k).astype(np.int64) for k in METRICS}
                failed = BASE[0].rejects(f) | BASE[1].rejects(f)
                kept = np.zeros(f.n, bool)
                good = np.flatnonzero(~failed)
                kept[good[cascade(f.subset(good), rules)]] = True
                yield pa.RecordBatch.from_pydict({id_column: batch.column(0).slice(a, b - a), **metrics, "base_failed": failed, "kept": kept})

    schema = f"{id_column} {dict(documents.dtypes)[id_column]}, " + ", ".join(f"{k} long" for k in METRICS) + ", base_failed boolean, kept boolean"
    return documents.select(id_column, "text").mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return judge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM named) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (2 * n_dup_lines > n_lines) AND NOT (word_chars < 2 * n_words OR word_chars > 40 * n_words)
  AND NOT (10 * n_letter_words < 7 * n_words) AS kept
FROM b
"""
