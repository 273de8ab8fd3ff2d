"""Scalar functions on text, names and sizes, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All 29 code points that count as white space in transcripts; Java's own class holds fewer.
WS = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda t: t != "")


def characters(text: Column) -> Column:
    """Code points, spaces included."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def has_digits(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"[\p{Nd}\p{Nl}\p{No}]"))


def count_arabic_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[ؐ-ًؚ-ٰٟۖ-ۭـ]", ""))


def zero_width(text: Column, to: str = "") -> Column:
    return F.regexp_replace(text, "[​‌‍­﻿‎‏؜]", to)


def eastern_digits_to_ascii(text: Column) -> Column:
    return F.translate(text, "".join(chr(b + k) for b in (0x0660, 0x06F0) for k in range(10)), "0123456789" * 2)


def unify_apostrophes(text: Column) -> Column:
    return F.translate(text, "’‘‛ʼʹ՚", "'" * 6)


def openslr_speaker(file_id: Column) -> Column:
    """prefix_speaker of prefix_speaker_utterance; null for any other shape."""
    parts = F.split(file_id, "_")
    whole = (F.size(parts) == 3) & F.forall(parts, lambda x: x != "")
    return F.when(whole, F.concat_ws("_", parts[0], parts[1]))


def speaker_before(name: Column, mark: str) -> Column:
    """What stands before the first ``mark``; null if that is nothing, or if there is no mark and it is longer than one character."""
    head = F.substring_index(name, mark, 1)
    found = head != "" if len(mark) == 1 else F.contains(name, F.lit(mark)) & (head != "")
    return F.when(found, head)


def base_locale(locale: Column) -> Column:
    return F.split_part(locale, F.lit("-"), F.lit(1))


#: Kernels and strides of the seven convolutions before the encoder (fixed values).
KERNELS, STRIDES = (10, 3, 3, 3, 3, 2, 2), (5, 2, 2, 2, 2, 2, 2)


def frame_budget(samples: Column) -> Column:
    """Frames that a waveform of so many samples gives: floor((n - k) / s) + 1 at each layer, never below 0."""
    layer = lambda n, ks: F.greatest(F.lit(0).cast("long"), F.floor((n - ks[0]) / F.lit(float(ks[1]))).cast("long") + 1)
    return reduce(layer, zip(KERNELS, STRIDES, strict=True), samples.cast("long"))


def clamp_segment(start: Column, end: Column, rate: Column, frames: Column) -> tuple[Column, Column]:
    """First and last frame of a segment, no later than the recording's end."""
    return tuple(F.least((t * rate).cast("long"), frames) for t in (start, end))


def milliseconds_id(seconds: Column) -> Column:
    """Whole milliseconds, half to even, in nine digits."""
    return F.lpad(F.rint(seconds * 1000).cast("long").cast("string"), 9, "0")


def safe_component(name: Column, most: int = 200, kept: int = 184) -> Column:
    """A file name of at most ``most`` bytes: a longer one is cut (at a whole character) and ends in a digest of the whole."""
    # No more characters than bytes are looked at, each once.
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))

    def step(x: Column, c: Column) -> Column:
        n = x["n"] + F.octet_length(c)
        return F.struct(n.alias("n"), F.when(n <= kept, F.concat(x["t"], c)).otherwise(x["t"]).alias("t"))

    prefix = F.aggregate(F.split(F.substring(name, 1, kept), ""), start, step)["t"]
    cut = F.concat(prefix, F.lit("-"), F.substring(F.sha1(name.cast("binary")), 1, 8))
    return F.when(F.octet_length(name) <= most, name).otherwise(cut)


def learning_rate_factor(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then linear decay to 0."""
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - warmup)))))
