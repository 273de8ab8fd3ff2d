"""Markdown tables of aggregates. Numbers are formatted in Python: half to even on the binary value, as in the published tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

NONE = "—"


def number(value: float | None, digits: int = 2) -> str:
    return NONE if value is None or math.isnan(value) else f"{value:.{digits}f}"


def mean_std(mean: float | None, std: float | None, digits: int = 2) -> str:
    return NONE if mean is None or math.isnan(mean) else f"{number(mean, digits)} ± {number(std, digits)}"


def table(header: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A table; bars in cells are escaped, a row of another width is refused."""
    cell = lambda x: str(x).replace("|", "\\|")
    lines = [header, ["---"] * len(header)]
    for row in rows:
        if len(row) != len(header):
            raise ValueError(f"{len(row)} cells under {len(header)} headings")
        lines.append(row)
    return "\n".join("| " + " | ".join(map(cell, x)) + " |" for x in lines) + "\n"


def language_table(by_language: DataFrame) -> str:
    """One line a language. These are aggregates, a few hundred rows."""
    rows = by_language.orderBy("section", "lang").collect()
    named = "policy" in by_language.columns
    cells = lambda r: (r.section, r.lang, r.kind.upper(), mean_std(r.wer_mean, r.wer_std), mean_std(r.cer_mean, r.cer_std), max(r.wer_n, r.cer_n), *([r.policy or NONE] if named else []))
    return table(["section", "language", "metric", "WER", "CER", "seeds", *(["policy"] if named else [])], map(cells, rows))


def macro_table(macro: DataFrame) -> str:
    rows = macro.orderBy("section").collect()
    return table(["section", "metric", "macro", "languages", "spread across languages", "excluded"], [(r.section, r.label, mean_std(r.mean, r.std), r.n_languages, number(r.spread_across_languages), ", ".join(r.excluded) or NONE) for r in rows])


def decision_table(decisions: DataFrame) -> str:
    rows = decisions.orderBy(decisions["trainable_hours"].desc(), "locale").collect()
    return table(["locale", "trainable h", "in", "why"], [(r.locale, number(r.trainable_hours, 1), "yes" if r.included else "no", r.reason) for r in rows])


def preset_block(decisions: DataFrame, release: str, boundaries: Mapping[str, bool], normalizers: Mapping[str, str]) -> str:
    """The languages that a selection includes, as the YAML block of a preset. One without a policy has no ``normalizer``
    and is listed above, since a run would stop at it."""
    lines, waiting = ["languages:"], []
    for r in decisions.where("included").orderBy(decisions["trainable_hours"].desc(), "locale").collect():
        own = ["source: manifest", f"corpus: {r.corpus}"] if r.source == "manifest" else ["source: commonvoice", f"hf_dataset: {release}"]
        own = [f"code: {r.locale}", *own, f"hf_config: {r.locale}", *(["text_column: sentence"] if r.source == "commonvoice" else [])]
        own += [] if boundaries.get(r.locale, True) else ["word_boundary: false"]
        if r.locale in normalizers:
            own.append(f"normalizer: {normalizers[r.locale]}")
        else:
            waiting.append(r.locale)
        lines.append("  - { " + ", ".join(own) + " }")
    head = ["# Without a policy so far:", *[f"#   {code}" for code in sorted(waiting)]] if waiting else []
    return "\n".join([*head, *lines]) + "\n"


def metric_tables(scale: str, metric: str, intervals: Sequence[Mapping[str, object]], comparisons: Sequence[Mapping[str, object]], resamples: int, seed: int) -> tuple[str, dict[str, object]]:
    """A metric's intervals and comparisons as Markdown and as a document."""
    text = [f"# {metric.upper()}, scale {scale}\n", f"{resamples} resamples, seed {seed}\n"]
    text.append(table(["run", "section", "language", "rate", "interval", "primary"], [(r["run"], r["section"], r["lang"], number(r["point"]), f"[{number(r['low'])}, {number(r['high'])}]", "yes" if r["is_primary"] else "") for r in intervals]))
    if comparisons:
        text.append(table(["run", "against", "section", "language", "A", "B", "delta", "p", "n"], [(r["run"], r["against"], r["section"], r["lang"], number(r["point_a"]), number(r["point_b"]), number(r["delta"]), number(r["p"], 4), r["n"]) for r in comparisons]))
    return "\n".join(text), {"scale": scale, "metric": metric, "n_resamples": resamples, "seed": seed, "intervals": list(intervals), "comparisons": list(comparisons)}
