"""Normalization policies: named sets of rules, their digests, and which language is normalized under which.

A policy runs one of three pipelines. Its digest covers only the rules that its pipeline reads, so that a rule added to
one pipeline leaves the digests of the others alone; a rule that a pipeline doesn't read can't be set.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import sys
import warnings
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSIC, BASIC, SCRIPT = "classic", "whisper", "script"

# Which rules each pipeline reads (fixed values).
READS = {
    CLASSIC: ("version", "form", "case", "malayalam_chillu", "strip_invisibles", "strip_arabic_marks", "turkish_dotted_i", "unify_apostrophes", "strip_punctuation", "strip_symbols", "apostrophe_is_letter", "digits"),
    BASIC: ("version", "pipeline", "form", "case", "drop_bracketed_spans", "strip_marks", "strip_punctuation", "strip_symbols", "diacritics", "strip_whitespace"),
    SCRIPT: ("version", "pipeline", "form", "case", "bracket_spans", "zero_width", "marks", "script_map", "locale_case", "cyrillic_yo", "delete_quotes", "fold_alef_maksura", "unify_apostrophes", "apostrophe_is_letter", "turkish_dotted_i", "punct_action", "strip_symbols", "arabic_digits"),
}


@dataclass(frozen=True)
class Policy:
    version: str = "norm-1"
    pipeline: str = CLASSIC
    form: str = "NFKC"
    case: str = "casefold"
    malayalam_chillu: str = "atomic"
    strip_invisibles: bool = True
    strip_arabic_marks: bool = True
    turkish_dotted_i: bool = True
    unify_apostrophes: bool = True
    strip_punctuation: bool = True
    strip_symbols: bool = True
    apostrophe_is_letter: bool = False
    digits: str = "keep"
    drop_bracketed_spans: bool = False
    strip_marks: bool = False
    diacritics: str = "keep"
    strip_whitespace: bool = True
    bracket_spans: str = "keep"
    zero_width: str = "delete"
    marks: str = "keep"
    script_map: str = "none"
    locale_case: str = "none"
    cyrillic_yo: bool = False
    delete_quotes: bool = False
    fold_alef_maksura: bool = True
    punct_action: str = "space"
    arabic_digits: str = "keep"

    def __post_init__(self) -> None:
        read = READS[self.pipeline]
        for f in fields(self):
            if f.name not in (*read, "pipeline") and getattr(self, f.name) != f.default:
                raise ValueError(f"pipeline {self.pipeline!r} has no rule {f.name!r}: leave it at {f.default!r}")

    def rules(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in READS[self.pipeline]}

    def digest(self) -> str:
        return _digest(self.rules())


def _digest(what: Any) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


# The named policies and what each sets (fixed values).
_MARKS = Policy(version="whisper-marks", pipeline=SCRIPT, case="lower", bracket_spans="delete", turkish_dotted_i=True)
_ARABIC = Policy(version="arabic-ouaal", pipeline=SCRIPT, case="lower", marks="arabic", script_map="arabic_msa", arabic_digits="to_ascii")
_BASIC = Policy(version="whisper-basic", pipeline=BASIC, case="lower", drop_bracketed_spans=True, strip_marks=True, strip_whitespace=False)
_PERSO = replace(_ARABIC, version="perso-arabic", script_map="perso", zero_width="keep_zwnj")

PRESETS = (
    Policy(),
    _BASIC,
    replace(_BASIC, version="whisper-basic-nodiacritics", form="NFKD", diacritics="drop"),
    _MARKS,
    replace(_MARKS, version="cyrillic-yo", cyrillic_yo=True),
    replace(_MARKS, version="turkic-tr", locale_case="tr"),
    replace(_MARKS, version="latin-marks", form="NFC"),
    Policy(version="indic-vistaar", pipeline=SCRIPT, form="NFC", case="lower", script_map="malayalam", punct_action="delete"),
    _ARABIC,
    _PERSO,
    replace(_PERSO, version="uyghur-ug", fold_alef_maksura=False),
    replace(_MARKS, version="ja-cer"),
    replace(_MARKS, version="thai-cer", form="NFC", zero_width="space"),
    replace(_MARKS, version="han-mer"),
    replace(_MARKS, version="armenian-hy", script_map="armenian"),
    replace(_MARKS, version="ko-kspon", form="NFC"),
    replace(_MARKS, version="tibetan-syllable", form="NFC"),
)
POLICIES: dict[str, Policy] = {p.version: p for p in PRESETS}

#: What vocabularies were built with before policies existed: the composed form and nothing else. Not in the registry (fixed values).
LEGACY = Policy("norm-0", form="NFC", case="none", malayalam_chillu="keep", strip_invisibles=False, strip_arabic_marks=False, turkish_dotted_i=False, unify_apostrophes=False, strip_punctuation=False, strip_symbols=False)

DEFAULT = "whisper-basic"
#: Policies of languages written without spaces, which are scored on characters.
UNSPACED = frozenset({"ja-cer", "thai-cer", "han-mer", "tibetan-syllable"})

# Script of each language (fixed values).
SCRIPTS = {
    "Latn": ("en", "de", "fr", "es", "it", "nl", "pl", "fi", "ca", "eo", "eu", "hu", "gl", "pt", "cs", "sk", "ro", "sv-SE", "da", "et", "is", "hr", "lt", "lv", "cy", "fy-NL", "tr", "az", "uz", "sw", "rw", "lg", "kab", "kmr", "vi", "yo", "ig", "ha", "id", "ms", "jv", "su", "zu", "xh", "nso", "ts", "ve"),
    "Cyrl": ("ru", "uk", "be", "ab", "ba", "mhr", "bg", "sr", "mn", "tt", "kk", "ky", "kbd", "ady"),
    "Geor": ("ka",),
    "Grek": ("el",),
    "Armn": ("hy-AM", "hy"),
    "Deva": ("hi", "mr", "ne-NP", "ne", "marathi"),
    "Beng": ("bn",),
    "Guru": ("pa-IN",),
    "Gujr": ("gu", "gujarati"),
    "Orya": ("or", "odia"),
    "Taml": ("ta",),
    "Telu": ("te", "telugu"),
    "Knda": ("kn",),
    "Mlym": ("ml", "malayalam"),
    "Sinh": ("si",),
    "Arab": ("ar", "fa", "ur", "ps", "ug", "ckb"),
    "Jpan": ("ja",),
    "Hans": ("zh-CN",),
    "Hant": ("zh-TW", "yue"),
    "Thai": ("th",),
    "Tibt": ("bo",),
    "Kore": ("ko",),
}
SCRIPT_OF = {code: script for script, codes in SCRIPTS.items() for code in codes}
# Policies by script and by language, where they differ from the default (fixed values).
BY_SCRIPT = dict.fromkeys(("Deva", "Beng", "Guru", "Gujr", "Orya", "Taml", "Telu", "Knda", "Mlym", "Sinh"), "indic-vistaar") | {
    "Thai": "thai-cer",
    "Tibt": "tibetan-syllable",
    "Kore": "ko-kspon",
    "Armn": "armenian-hy",
    "Hans": "han-mer",
    "Hant": "han-mer",
    "Jpan": "ja-cer",
}
BY_LANGUAGE = {"tr": "turkic-tr", "az": "turkic-tr", "ar": "arabic-ouaal", "ug": "uyghur-ug"} | dict.fromkeys(("fa", "ur", "ckb", "ps"), "perso-arabic") | dict.fromkeys(("sw", "rw", "yo", "ig"), "latin-marks")


def policy(name: str) -> Policy:
    if name not in POLICIES:
        raise KeyError(f"no policy {name!r}; there are {', '.join(POLICIES)}")
    return POLICIES[name]


def name_of(p: Policy) -> str:
    """The registry's name of a policy; one that isn't in it goes by its version and digest."""
    return next((k for k, v in POLICIES.items() if v == p), f"{p.version}@{p.digest()}")


def script(code: str) -> str:
    if code not in SCRIPT_OF:
        raise KeyError(f"no script is recorded for language {code!r}")
    return SCRIPT_OF[code]


def policy_for(code: str, explicit: str | None = None) -> Policy:
    """Explicit name, else the language's, else its script's, else the default (with a warning if the script is unknown)."""
    if explicit is None and code not in BY_LANGUAGE and code not in SCRIPT_OF:
        warnings.warn(f"no script is recorded for {code!r}: it is normalized under {DEFAULT!r}", stacklevel=2)
    return policy(explicit or BY_LANGUAGE.get(code) or BY_SCRIPT.get(SCRIPT_OF.get(code, ""), DEFAULT))


def registry_digest() -> str:
    return _digest({name: p.rules() for name, p in POLICIES.items()})


def module_digest() -> str:
    """Digest of the code that normalizes: with the registry's, all that a normalized text depends on."""
    from . import normalize

    digest = hashlib.sha256()
    for module in (normalize, sys.modules[__name__]):
        digest.update(inspect.getsource(module).encode())
    return digest.hexdigest()


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def with_policy(specs: DataFrame, code: str = "code", explicit: str = "normalizer", override: str | None = None) -> DataFrame:
    """specs with ``policy``: the same precedence as ``policy_for``, as literal maps, so no join is needed."""
    named = F.coalesce(F.lit(override), F.col(explicit)) if override else F.col(explicit)
    by_language = F.try_element_at(_map(BY_LANGUAGE), F.col(code))
    by_script = F.try_element_at(_map(BY_SCRIPT), F.try_element_at(_map(SCRIPT_OF), F.col(code)))
    return specs.withColumn("policy", F.coalesce(named, by_language, by_script, F.lit(DEFAULT)))


def policy_table(spark: SparkSession) -> DataFrame:
    """(name, digest, pipeline, rules map): the registry as a table."""
    rows = [(k, p.digest(), p.pipeline, {f: json.dumps(v) for f, v in p.rules().items()}) for k, p in POLICIES.items()]
    return spark.createDataFrame(rows, "name string, digest string, pipeline string, rules map<string,string>")
