"""python -m quillspark aggregate | analyze | data-stats | check-data"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.text import openslr_speaker
from .operators import comparing, durations, leakguard, resampling, scoring, seeds, splits
from .plans import report
from .shipping import ship
from .sources import readers, sinks, specs, sweeps


def aggregate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Mean and deviation over seeds, and the macro-averages."""
    results = readers.run_results(spark, specs.results_root(a.results_root), a.arm, a.scale)
    languages, macro = seeds.by_language(results, carried=("policy",)), seeds.macro(seeds.primary_values(results))
    if a.json:
        return json.dumps({"languages": [r.asDict(True) for r in languages.orderBy("section", "lang").collect()], "macro": [r.asDict(True) for r in macro.orderBy("section").collect()]}, ensure_ascii=False)
    return report.language_table(languages) + "\n" + report.macro_table(macro)


def analyze(spark: SparkSession, a: argparse.Namespace) -> str:
    """Intervals of each run, and tests against another arm, seed by seed: one table a metric, as .md and .json."""
    root = specs.results_root(a.results_root)
    results = readers.run_results(spark, root, a.arm, a.scale)
    found = {r.seed for r in results.select("seed").distinct().collect()}
    wanted = sorted(found & set(a.seed) if a.seed else found)
    if not wanted:
        raise FileNotFoundError(f"no runs of {a.arm}/{a.scale} with seeds {sorted(a.seed)} under {root}")
    paired: list[int] = []
    if a.compare_to:
        # Before any sidecar is read: rates under different policies can't be compared, whatever their references.
        other = readers.run_results(spark, root, a.compare_to, a.scale)
        theirs = {r.seed for r in other.select("seed").distinct().collect()}
        paired = [seed for seed in wanted if seed in theirs]
        policies = lambda df, seed: df.where((F.col("seed") == seed) & F.col("policy").isNotNull()).select("lang", "policy").distinct()
        for seed in paired:
            comparing.require_same_policies(policies(results, seed), policies(other, seed))
    by = ["section", "lang", "metric"]
    spaced = {(r.section, r.lang): r.word_boundary for r in results.select("section", "lang", "word_boundary").distinct().collect()}
    intervals, comparisons, text = [], [], []
    for seed in wanted:
        run = lambda arm, seed=seed: scoring.scoreable(readers.sidecars(spark, f"{root}/{arm}/{a.scale}/seed{seed}"))
        rows = scoring.long_form(scoring.edit_counts(run(a.arm)), ["section", "lang", "pos"])
        name = f"{a.arm}/{a.scale}/seed{seed}"
        got = [r.asDict() for r in resampling.intervals_exact(rows, by, "pos", draws=a.resamples).orderBy(*by).collect()]
        intervals += [{"run": name, **r, "is_primary": spaced.get((r["section"], r["lang"]), True) == (r["metric"] == "wer")} for r in got]
        lines = [(r["section"], r["lang"], r["metric"].upper(), report.number(r["point"]), f"[{report.number(r['low'])}, {report.number(r['high'])}]") for r in got]
        text.append(f"{name}\n\n" + report.table(["section", "language", "metric", "rate", "interval"], lines))
        if seed in paired:
            edits = comparing.paired_edits(run(a.arm), run(a.compare_to), ["section", "lang"])
            both = comparing.deltas(edits, by).join(resampling.permutation_exact(edits, by, "pos", draws=a.resamples), by).orderBy(*by)
            both = [r.asDict() for r in both.collect()]
            comparisons += [{"run": name, "against": a.compare_to, **r} for r in both]
            text.append(report.table(["section", "language", "metric", "delta", "p"], [(r["section"], r["lang"], r["metric"].upper(), report.number(r["delta"]), report.number(r["p"], 4)) for r in both]))
    for metric in scoring.METRICS:
        of = lambda rows, metric=metric: [r for r in rows if r["metric"] == metric]
        markdown, doc = report.metric_tables(a.scale, metric, of(intervals), of(comparisons), a.resamples, resampling.SEED)
        sinks.write_text(markdown, os.path.join(a.tables_dir, f"{a.scale}_{metric}.md"))
        sinks.write_json(doc, os.path.join(a.tables_dir, f"{a.scale}_{metric}.json"))
    return "\n".join(text)


def _voice(spark: SparkSession, root: str, spec: Row, train_source: str, known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(split, path) of a Common Voice language, and what the guard removes if the training rows are those validated."""
    read = lambda split: readers.common_voice(spark, root, split, spec.text_column)
    evaluation = read("validation").unionByName(read("test"))
    if train_source == "train":
        return read("train").unionByName(evaluation).select("split", "path"), None
    validated = readers.common_voice_file(spark, f"{root}/validated.tsv", spec.text_column)
    leakguard.require_speakers(validated, evaluation)
    marked = leakguard.dispositions(validated, evaluation)
    leakguard.require_empty(leakguard.not_covered(read("train"), marked.where(F.col("disposition") == leakguard.KEPT)), f"{spec.code}: training rows of the release that the guard removes")
    train = marked.where(F.col("disposition") == leakguard.KEPT).select(F.lit("train").alias("split"), "path")
    seconds = known.select(F.col("clip").alias("path"), "seconds")
    counted = leakguard.accounting(marked.join(seconds, "path", "left"), seconds="seconds")
    return train.unionByName(evaluation.select("split", "path")), counted


def _rows(spark: SparkSession, spec: Row, corpora_root: str, train_source: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(split, path), (path, seconds) and the guard's accounting of a language, whatever its source."""
    root = f"{corpora_root}/{spec.corpus or spec.code}"
    if spec.source == "commonvoice":
        known = readers.clip_durations(spark, f"{root}/clip_durations.tsv")
        rows, guard = _voice(spark, root, spec, train_source, known)
        return rows, known.withColumnRenamed("clip", "path"), guard
    name = lambda df: df.select(paths.stem(F.col("path")).alias("path"), "seconds")
    if spec.source == "openslr":
        index = readers.openslr_index(spark, [f"{root}/{f}" for f in spec.index_files]).withColumn("lang", F.lit(spec.code))
        rows = splits.derive(index, ["lang"], openslr_speaker(F.col("file_id")), F.col("file_id")).select("split", F.col("file_id").alias("path"))
        return rows, name(readers.audio_headers(spark, f"{root}/*.wav")), None
    listed = readers.manifest(spark, f"{root}/{spec.hf_config}.tsv").withColumn("lang", F.lit(spec.code))
    rows = splits.partition_manifest(listed, ["lang"]).select("split", paths.stem(F.col("path")).alias("path"))
    return rows, name(readers.audio_headers(spark, f"{root}/audio/*")), None


def data_stats(spark: SparkSession, a: argparse.Namespace) -> str:
    """Hours and rows by language and what the guard removed; a language that can't be read says why."""
    languages = {r.code: r for r in specs.preset(spark, a.preset).collect()}
    guards: dict[str, dict[str, object]] = {}

    def measure(code: str):  # noqa: ANN202
        rows, seconds, guard = _rows(spark, languages[code], a.corpora_root, a.train_source)
        if guard is not None:
            guards[code] = guard.first().asDict()
        return durations.split_durations(rows, seconds, ["split"], "path")

    # All releases of the main source in one job; the others, which each have a shape of their own, one after the other.
    voices = {code: f"{a.corpora_root}/{x.corpus or x.code}" for code, x in languages.items() if x.source == "commonvoice"}
    parts = durations.sweep(spark, [code for code in languages if code not in voices], measure)
    if voices:
        swept, guarded = sweeps.voice(spark, voices, {code: languages[code].text_column for code in voices}, a.train_source)
        parts = parts.unionByName(swept)
        guards |= {r.lang: {k: v for k, v in r.asDict().items() if k != "lang"} for r in guarded.join(swept.where("error is not null"), "lang", "left_anti").collect()}
    total = durations.hours(parts, ["lang"]).withColumn("below", durations.below(F.col("train_hours"), a.min_train_hours))
    rows = parts.groupBy("lang").agg(F.sum("n_utts").alias("n"), F.sum("n_missing").alias("missing"), F.first("error", ignorenulls=True).alias("error")).join(total, "lang").orderBy("lang").collect()
    lines = [(r.lang, languages[r.lang].source, r.n or 0, r.missing or 0, report.number(r.total_hours, 1), report.number(r.train_hours, 1), "yes" if r.below else "", r.error or "") for r in rows]
    text = report.table(["language", "source", "rows", "missing", "hours", "train hours", "below", "error"], lines)
    if guards:
        text += "\n" + report.table(["language", "validated", "in evaluation", "speaker in evaluation", "speakers", "hours removed"], [(code, g["n_validated"], g["n_in_eval_splits"], g["n_eval_speaker_clips"], g["n_leaked_speakers"], report.number(g["seconds_removed_by_guard"] / 3600.0, 1)) for code, g in sorted(guards.items())])
    sinks.write_json({"train_source": a.train_source, "languages": [r.asDict() | {"guard": guards.get(r.lang)} for r in rows]}, os.path.join(a.tables_dir, "data_durations.json"))
    sinks.write_text(text, os.path.join(a.tables_dir, "data_durations.md"))
    return text


def check_data(spark: SparkSession, a: argparse.Namespace) -> str:
    """Which languages of a preset can be read, and how many rows each split has; nothing is read but text."""
    lines = []
    for spec in specs.preset(spark, a.preset).orderBy("ord").collect():
        try:
            rows, _, _ = _rows(spark, spec, a.corpora_root, "train")
            n = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
            lines.append(("yes", spec.code, spec.source, sum(n.values()), " ".join(f"{k}={n.get(k, 0)}" for k in splits.PARTS)))
        except Exception as e:
            lines.append(("no", spec.code, spec.source, 0, f"{type(e).__name__}: {e}"[:200].replace("\n", " ")))
    return report.table(["readable", "language", "source", "rows", "splits"], lines)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, run in (("aggregate", aggregate), ("analyze", analyze)):
        c = commands.add_parser(name, help=run.__doc__)
        c.add_argument("--arm", required=True)
        c.add_argument("--scale", required=True)
        c.add_argument("--results-root")
        c.set_defaults(run=run)
        if name == "aggregate":
            c.add_argument("--json", action="store_true")
        else:
            c.add_argument("--seed", type=int, action="append", default=[])
            c.add_argument("--compare-to")
            c.add_argument("--tables-dir", default="tables")
            c.add_argument("--resamples", type=int, default=resampling.DRAWS)
    for name, run in (("data-stats", data_stats), ("check-data", check_data)):
        c = commands.add_parser(name, help=run.__doc__)
        c.add_argument("--preset", required=True)
        c.add_argument("--corpora-root", required=True)
        c.set_defaults(run=run)
        if name == "data-stats":
            c.add_argument("--tables-dir", default="tables")
            c.add_argument("--min-train-hours", type=float, default=0.0)
            c.add_argument("--train-source", choices=("train", "validated_minus_eval"), default="train")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    ship(spark)
    return a.run(spark, a)


if __name__ == "__main__":
    print(main())
