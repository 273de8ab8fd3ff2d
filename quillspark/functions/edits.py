"""Edit distance on characters and on words, with unit costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of the table of two texts up to which the built-in distance fills it; beyond, a column at a time costs less.
CELLS = 4_000_000


def char_edits(ref: Column, hyp: Column) -> Column:
    """Edits between code points; spaces count. Equal texts aren't compared, and very long ones not cell by cell."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    long = F.length(r).cast("long") * F.length(h) > CELLS
    far = _char_edits(F.when(long & (r != h), r), F.when(long & (r != h), h))
    return F.when(r == h, F.lit(0).cast("long")).when(long, far).otherwise(F.levenshtein(r, h).cast("long"))


def distance(a: list[str], b: list[str]) -> int:
    """Edits between token lists, bit-parallel: a column of the table is two integers of one bit a token of ``a``, which say
    where it rises and where it falls; a token of ``b`` moves to the next column in a few operations on whole integers."""
    if len(a) > len(b):
        a, b = b, a
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a:
        return len(b)
    places: dict[str, list[int]] = {}
    for k, token in enumerate(a):
        places.setdefault(token, []).append(k)
    shared = {token: sum(1 << k for k in places[token]) for token in set(b) & places.keys()}
    all_bits, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, score = all_bits, 0, len(a)
    for token in b:
        equal = shared.get(token, 0)
        diagonal = (((equal & rises) + rises) ^ rises) | equal | falls
        up, down = (falls | ~(diagonal | rises)) & all_bits, rises & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & all_bits, down << 1 & all_bits
        rises, falls = (down | ~(diagonal | up)) & all_bits, up & diagonal
    return score


@F.pandas_udf(T.LongType())
def _word_edits(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    return pd.Series([distance((a or "").split(), (b or "").split()) for a, b in zip(refs, hyps, strict=True)], index=refs.index, dtype="int64")


@F.pandas_udf(T.LongType())
def _char_edits(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    return pd.Series([0 if a is None or b is None else distance(list(a), list(b)) for a, b in zip(refs, hyps, strict=True)], index=refs.index, dtype="int64")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edits between words, for texts of any length (Arrow UDF: the built-in distance knows characters only)."""
    return _word_edits(ref, hyp)
