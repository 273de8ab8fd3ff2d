"""Tables and documents on the way out."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Iterable, Mapping
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.scoring import edit_counts, rate
from ..scratch import file_system, new_folder, write_file
from .readers import MANIFEST


def write_manifest(rows: DataFrame, path: str) -> None:
    """Parquet, one folder for each corpus and language: the form that scans well."""
    rows.write.partitionBy("corpus", "lang").mode("overwrite").parquet(path)


def export_manifest(rows: DataFrame, path: str) -> None:
    """One sorted, minimally quoted table with a header, for other tools."""
    out = rows.select(*MANIFEST, *[c for c in ("dialect",) if c in rows.columns]).orderBy("utt_id").coalesce(1)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def sidecar_documents(pairs: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """(by, document): predictions of a group as JSON: rates, rows, blank references left out of them, pairs in order. A
    test set fits one row."""
    scored = edit_counts(pairs).withColumn("__blank", is_blank(F.col("ref")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(~F.col("__blank"), F.struct(position, "ref", "hyp")))), lambda x: F.array(x["ref"], x["hyp"]))
    kept = lambda c: F.when(~F.col("__blank"), F.col(c)).otherwise(0)
    columns = [rate(kept("word_edits"), kept("word_len")).alias("wer"), rate(kept("char_edits"), kept("char_len")).alias("cer"), F.count_if(~F.col("__blank")).alias("n"), F.count_if("__blank").alias("n_empty_refs"), ordered.alias("pairs")]
    return scored.groupBy(*by).agg(*columns).select(*by, F.to_json(F.struct("wer", "cer", "n", "n_empty_refs", "pairs")).alias("document"))


def write_sidecars(spark: SparkSession, pairs: DataFrame, run_dir: str, lang: str = "lang", position: str = "pos") -> None:
    """The same documents as ``predictions/<language>.json``, written by the executors line after line: a row of a language is
    never in memory with the others. Names are set when all are written."""
    held = pairs.select(lang, position, "ref", "hyp")
    scored = edit_counts(held).withColumn("__blank", is_blank(F.col("ref")))
    kept = lambda c: F.when(~F.col("__blank"), F.col(c)).otherwise(0)
    head = scored.groupBy(lang).agg(rate(kept("word_edits"), kept("word_len")).alias("wer"), rate(kept("char_edits"), kept("char_len")).alias("cer"), F.count_if(~F.col("__blank")).alias("n"), F.count_if("__blank").alias("n_empty_refs"), F.min(F.when(~F.col("__blank"), F.col(position))).alias("__first"))
    start = F.concat(F.regexp_replace(F.to_json(F.struct("wer", "cer", "n", "n_empty_refs")), r"\}$", ""), F.lit(',"pairs":['))
    none = F.lit(None).cast(pairs.schema[position].dataType)
    body = held.where(~is_blank(F.col("ref"))).join(head.select(lang, "__first"), lang)
    line = F.concat(F.when(F.col(position) > F.col("__first"), ",").otherwise(""), F.to_json(F.array(F.coalesce("ref", F.lit("")), F.coalesce("hyp", F.lit("")))))
    lines = head.select(lang, F.lit(0).alias("__part"), none.alias("__at"), start.alias("value")).unionByName(body.select(lang, F.lit(1).alias("__part"), F.col(position).alias("__at"), line.alias("value"))).unionByName(head.select(lang, F.lit(2).alias("__part"), none.alias("__at"), F.lit("]}").alias("value")))
    folder = new_folder(spark, "sidecars") + "/lines"
    ordered = lines.withColumn("__lang", F.col(lang)).repartition("__lang").sortWithinPartitions("__lang", "__part", "__at")
    ordered.select("__lang", "value").write.partitionBy("__lang").text(folder)
    store, where = file_system(spark, folder)
    to, out = file_system(spark, f"{run_dir}/predictions")
    to.mkdirs(out)
    jvm = spark.sparkContext._jvm
    for own in store.listStatus(where):  # one folder for each language
        name = own.getPath().getName()
        if name.startswith("__lang="):
            (part,) = [f.getPath() for f in store.listStatus(own.getPath()) if f.getPath().getName().startswith("part-")]
            to.rename(part, jvm.org.apache.hadoop.fs.Path(out, unquote(name.removeprefix("__lang=")) + ".json"))


def results_document(arm: str, scale: str, seed: int, rates: DataFrame, languages: Iterable[str], heldout: Iterable[str] = ()) -> dict[str, Any]:
    """results.json of a run from (section, lang, wer, cer, n, n_empty_refs), a row a language."""
    out: dict[str, Any] = {"arm": arm, "scale": scale, "seed": seed, "languages": list(languages), "heldout_langs": list(heldout), "in_distribution": {}, "transfer": {}}
    for r in rates.orderBy("section", "lang").collect():
        out[r.section][r.lang] = {k: r[k] for k in ("wer", "cer", "n", "n_empty_refs")}
    return out


#: Columns of text statistics by language and split, as documents have them.
_STATISTICS = ("n_utts", "n_chars_raw", "n_chars_normalized", "n_utts_with_digits", "n_utts_empty_after_norm", "median_tokens_per_utt", "unk_chars", "unk_rate", "looks_unspaced")


def text_stats_document(stats: DataFrame, languages: Iterable[Mapping[str, Any]], evicted: Mapping[str, int], evicted_by_language: Mapping[str, Mapping[str, int]] | None = None, **settings: Any) -> dict[str, Any]:
    """text_stats.json from (lang, split, statistics, removed_*): what each policy did to its language, split by split.

    ``languages``: code, word_boundary, heldout, policy, policy_hash of each; held-out ones may have characters that the
    floor left out of their own vocabularies."""
    of: dict[str, dict[str, Any]] = {}
    for r in stats.orderBy("lang", "split").collect():  # a row a language and split
        row = r.asDict()
        own = {k: row[k] for k in _STATISTICS if k in row}
        own["removed"] = {k.removeprefix("removed_"): v for k, v in sorted(row.items()) if k.startswith("removed_") and v}
        own["evicted_by_floor"] = dict((evicted_by_language or {}).get(r.lang, {})) if r.split == "train" else {}
        of.setdefault(r.lang, {})[r.split] = own
    named = {x["code"]: {k: x[k] for k in ("heldout", "word_boundary", "policy", "policy_hash")} | {"splits": of.get(x["code"], {})} for x in languages}
    return {**settings, "training_vocab_evicted": dict(evicted), "languages": named}


def fetch_document(corpus: str, licence: str, files: Iterable[Mapping[str, Any]], when: str) -> dict[str, Any]:
    """fetch_manifest.json: what was fetched, from where, how large it is, and its digests."""
    listed = [{k: f.get(k) for k in ("name", "url", "bytes", "sha256", "md5")} for f in files]
    return {"corpus": corpus, "licence": licence, "downloaded_utc": when, "files": sorted(listed, key=lambda f: str(f["name"]))}


def write_yaml(document: Mapping[str, Any], path: str) -> None:
    """resolved_config.yaml and its like: names in the order they come in."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("writing YAML documents needs PyYAML") from e
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dict(document), f, sort_keys=False, allow_unicode=True)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_json(document: Mapping[str, Any], path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")


def save_vocabulary(vocabulary: DataFrame, policies: Mapping[str, Mapping[str, Any]], path: str) -> None:
    """The vocabulary as one document, in whatever store the path names."""
    chars = [r.char for r in vocabulary.orderBy("id").collect()]  # code points of the scripts in use
    write_file(vocabulary.sparkSession, path, json.dumps({"id_to_char": chars, "policies": dict(policies)}, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """(char, id) and policies; older files are a bare list, or have one policy for all languages."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    chars = found if isinstance(found, list) else found["id_to_char"]
    policies = {} if isinstance(found, list) else found.get("policies") or ({"*": found["policy"]} if "policy" in found else {})
    return spark.createDataFrame(list(zip(chars, range(len(chars)), strict=True)), "char string, id int"), policies


def environment(spark: SparkSession) -> dict[str, Any]:
    """What a run ran on; never raises."""
    out: dict[str, Any] = {"python": platform.python_version(), "platform": platform.platform()}
    for name, probe in (("spark", lambda: spark.version), ("java", lambda: spark.sparkContext._jvm.System.getProperty("java.version")), ("unicode", lambda: __import__("unicodedata").unidata_version), ("shuffle_partitions", lambda: spark.conf.get("spark.sql.shuffle.partitions"))):
        try:
            out[name] = probe()
        except Exception as e:
            out[name] = f"unknown ({type(e).__name__})"
    return out
