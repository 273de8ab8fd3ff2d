"""Presets of languages and the registry of corpora, from YAML documents to validated tables.

What a document may hold is stated as tables: names with defaults, allowed values, and what each source needs.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policies import POLICIES, policy_for

REQUIRED = object()
LANGUAGE = {"code": REQUIRED, "source": REQUIRED, "word_boundary": True, "normalizer": None, "corpus": "", "hf_dataset": "", "hf_config": "", "text_column": "sentence", "slr": None, "archives": (), "index_files": (), "license": ""}
NEEDS = {"commonvoice": ("hf_config",), "manifest": ("corpus", "hf_config"), "openslr": ("slr", "archives")}
CORPUS = dict.fromkeys("id name languages source_page licence_name licence_url downloads audio_format transcripts speaker_ids ships_split preparer citation".split(), REQUIRED) | {
    "sample_rate_hz": None, "total_hours": None, "train_hours": None, "dev_hours": None, "test_hours": None, "speakers": "", "notes": "", "checksums": {}, "unverified": [],
}
CORPUS_VALUES = {"ships_split": ("full", "partial", "none"), "speaker_ids": ("column", "file_id", "path", "per-recording", "unconfirmed", "absent")}


def parsed(text: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML documents needs PyYAML") from e
    return yaml.safe_load(text) or {}


def document(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return parsed(f.read())


def entry(raw: Mapping[str, Any], shape: Mapping[str, Any], what: str) -> dict[str, Any]:
    """An entry with its defaults; unknown and missing names are refused."""
    unknown, missing = sorted(set(raw) - set(shape)), sorted(k for k, v in shape.items() if v is REQUIRED and k not in raw)
    if unknown or missing:
        raise ValueError(f"{what}: " + "; ".join(x for x in (f"unknown keys {unknown}" if unknown else "", f"missing keys {missing}" if missing else "") if x))
    return {k: raw.get(k, v) for k, v in shape.items()}


def language(raw: Mapping[str, Any]) -> dict[str, Any]:
    spec = entry(raw, LANGUAGE, f"language {raw.get('code', '?')!r}")
    code, source = spec["code"], spec["source"]
    if source not in NEEDS:
        raise ValueError(f"{code}: unknown source {source!r}; there are {', '.join(NEEDS)}")
    if spec["normalizer"] is not None and spec["normalizer"] not in POLICIES:
        raise ValueError(f"{code}: unknown normalizer {spec['normalizer']!r}")
    lacking = [k for k in NEEDS[source] if spec[k] in (None, "", (), [])]
    if lacking:
        raise ValueError(f"{code}: {source} needs {', '.join(lacking)}")
    if source == "openslr" and len(spec["index_files"]) != len(spec["archives"]):
        raise ValueError(f"{code}: {len(spec['index_files'])} index files for {len(spec['archives'])} archives")
    return spec | {"archives": list(spec["archives"]), "index_files": list(spec["index_files"])}


LANGUAGE_SCHEMA = "ord int, code string, source string, word_boundary boolean, normalizer string, corpus string, hf_dataset string, hf_config string, text_column string, slr int, archives array<string>, index_files array<string>, license string"
CORPUS_SCHEMA = "ord int, id string, name string, languages array<string>, licence_name string, ships_split string, speaker_ids string, total_hours double, train_hours double, dev_hours double, test_hours double"


def preset(spark: SparkSession, path: str) -> DataFrame:
    """The languages of a preset in their order; an empty one is refused."""
    return preset_of(spark, document(path), path)


def preset_of(spark: SparkSession, found: Mapping[str, Any], what: str = "the preset") -> DataFrame:
    specs = [language(x) for x in found.get("languages") or []]
    if not specs:
        raise ValueError(f"{what} lists no languages")
    return spark.createDataFrame([(k, *(s[c] for c in LANGUAGE)) for k, s in enumerate(specs)], LANGUAGE_SCHEMA)


def corpora(spark: SparkSession, path: str) -> DataFrame:
    return corpora_of(spark, document(path))


def corpora_of(spark: SparkSession, found: Mapping[str, Any]) -> DataFrame:
    rows = []
    for k, raw in enumerate(found.get("corpora") or []):
        spec = entry(raw, CORPUS, f"corpus {raw.get('id', '?')!r}")
        for name, allowed in CORPUS_VALUES.items():
            if spec[name] not in allowed:
                raise ValueError(f"corpus {spec['id']}: {name} is {spec[name]!r}, not one of {', '.join(allowed)}")
        hours = [None if spec[f"{p}_hours"] is None else float(spec[f"{p}_hours"]) for p in ("total", "train", "dev", "test")]
        rows.append((k, spec["id"], spec["name"], list(spec["languages"]), spec["licence_name"], spec["ships_split"], spec["speaker_ids"], *hours))
    return spark.createDataFrame(rows, CORPUS_SCHEMA)


def corpus_by_language(registry: DataFrame) -> DataFrame:
    """(code, corpus): of several corpora of a language the last one."""
    return registry.select("ord", "id", F.explode("languages").alias("code")).groupBy("code").agg(F.max_by("id", "ord").alias("corpus"))


def in_scope(presets: Iterable[DataFrame]) -> DataFrame:
    """The languages of several presets, each source and code once, in order."""
    from ..operators.splits import first_of

    out = None
    for k, p in enumerate(presets):
        p = p.withColumn("preset", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return first_of(out, ["source", "code"], [F.col("preset"), F.col("ord")])


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with others laid over them, level by level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def results_root(flag: str | None = None, variable: str = "RESULTS_ROOT") -> str:
    """Flag, else environment, else ./results."""
    return flag or os.environ.get(variable) or "results"


#: Names that a written configuration holds for its readers, worked out from the rest.
DERIVED = {"text": ("policies",)}


def resolved(settings: Mapping[str, Any], specs: Iterable[Mapping[str, Any]], override: str | None = None) -> dict[str, Any]:
    """Settings with the policy that each language runs under, by name and digest."""
    policies = {}
    for spec in sorted(specs, key=lambda x: x["code"]):
        p = policy_for(spec["code"], override or spec.get("normalizer"))
        policies[spec["code"]] = {"name": p.version, "hash": p.digest()}
    return merged(settings, {"text": {"policies": policies}})


def settings(defaults: Mapping[str, Any], path: str | None = None, over: Mapping[str, Any] | None = None, environment: Mapping[str, tuple[str, ...]] | None = None) -> dict[str, Any]:
    """Defaults, then environment variables (name: where it goes), then a document, then overrides. Names that a written
    configuration adds are taken off again; unknown ones and unknown policies are refused."""
    out = dict(defaults)
    for name, place in (environment or {}).items():
        if name in os.environ:
            value: Any = os.environ[name]
            for key in reversed(place):
                value = {key: value}
            out = merged(out, value)
    read = document(path) if path else {}
    for section, names in DERIVED.items():
        if isinstance(read.get(section), Mapping):
            read[section] = {k: v for k, v in read[section].items() if k not in names}
    for layer, what in ((read, path), (over or {}, "overrides")):
        _known(layer, defaults, str(what))
        out = merged(out, layer)
    chosen = (out.get("text") or {}).get("override")
    if chosen is not None and chosen not in POLICIES:
        raise ValueError(f"unknown policy {chosen!r}")
    return out


def _known(layer: Mapping[str, Any], defaults: Mapping[str, Any], what: str) -> None:
    unknown = sorted(set(layer) - set(defaults))
    if unknown:
        raise ValueError(f"{what}: unknown keys {unknown}")
    for k, v in layer.items():
        if isinstance(v, Mapping) and isinstance(defaults[k], Mapping) and defaults[k]:
            _known(v, defaults[k], f"{what}: {k}")
