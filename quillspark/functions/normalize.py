"""Transcript normalization under a policy.

A policy is compiled once into a list of steps. A step looks at the distinct characters of a text, not at each position:
it decides for every distinct character what becomes of it, counts it with one scan, and rewrites the text with one
``str.translate``. Unicode forms, case folding and categories are Python's (15.1 for 3.13), since Java's tables are
older and Spark has no normal forms; so the general path is an Arrow UDF. For ASCII text there is a native expression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .policies import BASIC, SCRIPT, Policy, policy

Tally = dict[str, int]
Step = Callable[[str, Tally], str]

# Fixed values.
TALLIED = ("M", "P", "S", "arabic_marks", "Cc", "Cf", "Cn", "Co", "Cs")
APOSTROPHES = "’‘‛ʼʹ՚"
ZWNJ = "‌"
ZERO_WIDTH = "​‌‍­﻿‎‏؜"
ARABIC_MARKS = [(0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED)]
HEBREW_MARKS = [(0x0591, 0x05C7)]
ARMENIAN_MARKS = [(0x055B, 0x055F)]
TATWEEL = "ـ"
CHILLU = {"ണ്‍": "ൺ", "ന്‍": "ൻ", "ര്‍": "ർ", "ല്‍": "ൽ", "ള്‍": "ൾ", "ക്‍": "ൿ"}
ARABIC_LETTERS = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ؤ": "و", "ئ": "ي", "پ": "ب", "ڤ": "ف", "ء": "", "ـ": ""}
PERSIAN_LETTERS = {"ي": "ی", "ك": "ک", "ة": "ه", "ـ": ""}
ALEF_MAKSURA, FARSI_YEH = "ى", "ی"
DIACRITICS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
BRACKETED = r"[<\[][^>\]]*[>\]]"
PARENTHESIZED = r"\(([^)]+?)\)"

_SPACES = re.compile(r"\s+")
_LOOSE_APOSTROPHE = re.compile(r"(?<!\w)'|'(?!\w)")
_SPANS = (re.compile(BRACKETED), re.compile(PARENTHESIZED))


@lru_cache(1 << 16)
def category(c: str) -> str:
    return unicodedata.category(c)


@lru_cache(1 << 16)
def _folds(c: str) -> bool:
    return c.casefold() != c


def _within(ranges: list[tuple[int, int]]) -> Callable[[str], bool]:
    return lambda c: any(a <= ord(c) <= b for a, b in ranges)


def each(decide: Callable[[str], tuple[str | None, str | None]]) -> Step:
    """A step from ``decide``: for a character, what replaces it (None: nothing does) and where that is counted (None: nowhere)."""
    known: dict[str, tuple[str | None, str | None]] = {}

    def step(text: str, tally: Tally) -> str:
        table = {}
        for c in set(text):
            what = known.get(c)
            if what is None:
                what = known[c] = decide(c)
            if what[0] is not None:
                table[ord(c)] = what[0]
                if what[1]:
                    tally[what[1]] += text.count(c)
        return text.translate(table) if table else text

    return step


def swap(pairs: dict[str, str]) -> Step:
    """Replaces sequences, in the order given."""

    def step(text: str, tally: Tally) -> str:
        for a, b in pairs.items():
            if a in text:
                text = text.replace(a, b)
        return text

    return step


def form(name: str) -> Step:
    return lambda text, tally: text if text.isascii() else unicodedata.normalize(name, text)


def case(rule: str) -> Step:
    return {"casefold": lambda text, tally: text.casefold(), "lower": lambda text, tally: text.lower(), "none": lambda text, tally: text}[rule]


def drop_spans(text: str, tally: Tally) -> str:
    for span in _SPANS:
        text = span.sub("", text)
    return text


def spaces(text: str, tally: Tally) -> str:
    return _SPACES.sub(" ", text)


def trimmed(text: str, tally: Tally) -> str:
    return _SPACES.sub(" ", text).strip()


def punctuation(replacement: str, p: bool, s: bool, letter: bool) -> list[Step]:
    """Categories P and S become ``replacement``. An apostrophe is P unless it stands between word characters."""
    hide = "﷐"  # a noncharacter holds the place of apostrophes that stay

    def protect(text: str, tally: Tally) -> str:
        if "'" not in text:
            return text
        if letter or not p:
            return text.replace("'", hide)
        loose = "﷑"
        return _LOOSE_APOSTROPHE.sub(loose, text).replace("'", hide).replace(loose, "'")

    def decide(c: str) -> tuple[str | None, str | None]:
        group = category(c)[0]
        return (replacement, group) if (group == "P" and p) or (group == "S" and s) else (None, None)

    return [protect, each(decide), lambda text, tally: text.replace(hide, "'") if hide in text else text]


def _classic(p: Policy) -> list[Step]:
    steps = [form(p.form)]
    if p.malayalam_chillu == "atomic":
        steps.append(swap(CHILLU))
    if p.strip_invisibles:
        steps.append(each(lambda c: ("", category(c)) if category(c)[0] == "C" else (None, None)))
    if p.strip_arabic_marks:
        mark = _within(ARABIC_MARKS)
        steps.append(each(lambda c: ("", "arabic_marks") if c == TATWEEL or mark(c) else (None, None)))
    if p.case != "none":
        steps += [case(p.case), form(p.form)]
    if p.turkish_dotted_i:
        steps.append(swap({"i̇": "i"}))
    if p.unify_apostrophes:
        steps.append(swap(dict.fromkeys(APOSTROPHES, "'")))
    if p.strip_punctuation or p.strip_symbols:
        steps += punctuation(" ", p.strip_punctuation, p.strip_symbols, p.apostrophe_is_letter)
    return [*steps, trimmed]


def _basic(p: Policy) -> list[Step]:
    gone = {"M": p.strip_marks, "S": p.strip_symbols, "P": p.strip_punctuation}

    def decide(c: str) -> tuple[str | None, str | None]:
        if p.diacritics == "drop":
            if c in DIACRITICS:
                return DIACRITICS[c], None
            if category(c) == "Mn":
                return "", "M"
        group = category(c)[0]
        return (" ", group) if gone.get(group) else (None, None)

    spans = [drop_spans] if p.drop_bracketed_spans else []
    return [case(p.case), *spans, form(p.form), each(decide), case(p.case), trimmed if p.strip_whitespace else spaces]


def _script(p: Policy) -> list[Step]:
    steps = [form(p.form)]
    if p.bracket_spans == "delete":
        steps.append(drop_spans)
    if p.script_map == "malayalam":  # reached through a joiner, so before joiners go
        steps.append(swap(CHILLU))
    if p.zero_width != "keep":
        gone = ZERO_WIDTH.replace(ZWNJ, "") if p.zero_width == "keep_zwnj" else ZERO_WIDTH
        to = " " if p.zero_width == "space" else ""
        steps.append(each(lambda c: (to, "Cf") if c in gone else (None, None)))
    if p.marks == "space":
        steps.append(each(lambda c: (" ", "M") if category(c)[0] == "M" else (None, None)))
    elif p.marks != "keep":
        mark = _within(ARABIC_MARKS if p.marks == "arabic" else HEBREW_MARKS)
        steps.append(each(lambda c: ("", "M") if mark(c) else (None, None)))
    if p.locale_case == "tr":
        steps.append(swap({"İ": "i", "I": "ı"}))
    if p.script_map == "arabic_msa":
        steps.append(swap(ARABIC_LETTERS))
    elif p.script_map == "perso":
        steps.append(swap(PERSIAN_LETTERS | ({ALEF_MAKSURA: FARSI_YEH} if p.fold_alef_maksura else {})))
    elif p.script_map == "armenian":
        inside = _within(ARMENIAN_MARKS)
        steps.append(each(lambda c: ("", None) if inside(c) else (None, None)))
    if p.delete_quotes:
        steps.append(swap({'"': "", "'": ""}))
    steps += [case(p.case), form(p.form)]
    if p.turkish_dotted_i:
        steps.append(swap({"i̇": "i"}))
    if p.cyrillic_yo:
        steps.append(swap({"ё": "е", "Ё": "Е"}))
    if p.unify_apostrophes:
        steps.append(swap(dict.fromkeys(APOSTROPHES, "'")))
    if p.punct_action != "keep" or p.strip_symbols:
        steps += punctuation("" if p.punct_action == "delete" else " " if p.punct_action == "space" else "", p.punct_action != "keep", p.strip_symbols, p.apostrophe_is_letter)
    if p.arabic_digits == "to_ascii":
        steps.append(swap({chr(base + k): str(k) for base in (0x0660, 0x06F0) for k in range(10)}))
    return [*steps, trimmed]


@lru_cache(64)
def compiled(p: Policy) -> tuple[Step, ...]:
    return tuple({BASIC: _basic, SCRIPT: _script}.get(p.pipeline, _classic)(p))


def empty_tally() -> Tally:
    """Every category that a rule can remove, so that a zero is seen as a zero."""
    return dict.fromkeys(TALLIED, 0)


def normalize_with_counts(text: str | None, p: Policy) -> tuple[str, Tally]:
    """The normalized text and what the rules removed; ``case_changed`` counts characters of the input that fold."""
    tally = empty_tally() | {"case_changed": 0}
    if not text:
        return "", tally
    if p.case != "none":
        tally["case_changed"] = sum(text.count(c) for c in set(text) if _folds(c))
    for step in compiled(p):
        text = step(text, tally)
    return text, tally


def normalize_text(text: str | None, p: Policy) -> str:
    return normalize_with_counts(text, p)[0]


def normalize_batch(texts: Iterable[str | None], p: Policy) -> list[str]:
    return [normalize_text(x, p) for x in texts]


def has_digits_py(text: str) -> bool:
    return any(category(c) in ("Nd", "Nl", "No") for c in set(text))


def normalized(text: Column, p: Policy | str) -> Column:
    """The text under a policy, for any Unicode text: ASCII by built-in functions, the rest by an Arrow UDF, which gets nothing
    of the ASCII rows but a null."""
    p = policy(p) if isinstance(p, str) else p

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else normalize_text(x, p) for x in texts], index=texts.index)

    value = F.coalesce(text, F.lit(""))
    return F.when(is_ascii(value), normalized_ascii(value, p)).otherwise(run(F.when(~is_ascii(value), value)))


COUNTS = "struct<text:string,counts:struct<" + ",".join(f"{k}:bigint" for k in (*TALLIED, "case_changed")) + ">>"


def normalized_with_counts(text: Column, p: Policy | str) -> Column:
    """struct(text, counts) under a policy (Arrow UDF)."""
    p = policy(p) if isinstance(p, str) else p

    @F.pandas_udf(COUNTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [normalize_with_counts(x, p) for x in texts]
        return pd.DataFrame({"text": [x for x, _ in done], "counts": [c for _, c in done]}, index=texts.index)

    return run(text)


def is_ascii(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))


def normalized_ascii(text: Column, p: Policy | str) -> Column:
    """The same for text that is known to be ASCII, as built-in functions inside code generation."""
    p = policy(p) if isinstance(p, str) else p
    text = F.coalesce(text, F.lit(""))
    blank = r"[\t-\r\x1c-\x1f ]+"
    if p.pipeline == BASIC:
        out = F.lower(text)
        if p.drop_bracketed_spans:
            out = F.regexp_replace(F.regexp_replace(out, BRACKETED, ""), PARENTHESIZED, "")
        out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]", " ") if p.strip_punctuation and p.strip_symbols else out
        out = F.regexp_replace(out, blank, " ")
        return F.trim(out) if p.strip_whitespace else out
    out = text
    if p.pipeline == SCRIPT and p.bracket_spans == "delete":
        out = F.regexp_replace(F.regexp_replace(out, BRACKETED, ""), PARENTHESIZED, "")
    if p.pipeline != SCRIPT and p.strip_invisibles:
        out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    if p.pipeline == SCRIPT and p.locale_case == "tr":
        out = F.replace(out, F.lit("I"), F.lit("ı"))
    if p.pipeline == SCRIPT and p.delete_quotes:
        out = F.regexp_replace(out, "[\"']", "")
    out = F.lower(out) if p.case != "none" else out
    to = "" if p.pipeline == SCRIPT and p.punct_action != "space" else " "
    strip_p = p.strip_punctuation if p.pipeline != SCRIPT else p.punct_action != "keep"
    if strip_p and not p.apostrophe_is_letter:
        out = F.regexp_replace(out, r"(?<![0-9A-Za-z_ı])'|'(?![0-9A-Za-z_ı])", to)
    removed = ("!-#%&(-*,\\-./:;?@\\[-\\]_{}" if strip_p else "") + ("$+<=>^`|~" if p.strip_symbols else "")
    if removed:
        out = F.regexp_replace(out, f"[{removed}]", to)
    return F.trim(F.regexp_replace(out, blank, " "))
