"""Secret scans with multipart credential linking (operator 12).

Three kinds of spans stand by themselves (``STRONG``): assignments of a value of 12 or more characters to a name like
``token``, access identifiers, and runs of 16 or more lower-case hex digits. Others are only part of a credential: a short
assigned value, a bare run of mixed characters, an assigned user or client, an endpoint. Most of these are harmless alone,
so such a weak candidate is reported only where a complementary part stands near it in the same scope: an identifier or an
endpoint beside a secret, a secret beside an identifier or an endpoint (``NEEDS``). A scope is a block of lines without a
blank one, near is a gap of at most ``REACH`` code points.

All parts of a scope come from one text, so the interval join needs no shuffle: a batch's candidates are sorted by (row,
scope, start), the spans of the complementary kinds that end last before and start first after a place are found by binary
search (spans of one kind don't overlap, so both ends rise together), and one of these is near or none is. That costs
n log n for n parts however many stand in a scope. Patterns are of ASCII only and run over the bytes of many rows at once;
offsets are code points.

Defined results: null and empty texts have no spans; texts are scanned whole, however long; a match that fails its length
is dropped with the text it covers; equal texts have equal spans; rows may repeat and lack ids; bytes that are no UTF-8
read as U+FFFD; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .runtime import table, tune

REACH = 200


def either_case(names: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
SECRET_NAMES = either_case("(password|passwd|secret|token|api_?key)")
OWNER_NAMES = either_case("(user_?name|user_?id|client_?id|account_?id|login)")
HOST_NAMES = either_case("(endpoint|host_?name|server)")
_VALUE = "([A-Za-z0-9+/_.=-]+)"
_OWNER_VALUE = "([A-Za-z0-9@/_.-]+)"
#: Kind: pattern, the group whose length counts (0 for the match), its least and most characters.
PATTERNS: dict[str, tuple[str, int, int, int | None]] = {
    "assign": (SECRET_NAMES + _SET + _VALUE, 2, 12, None),
    "access": ("AKIA[A-Z0-9]+", 0, 18, None),
    "hex": ("[0-9a-f]{16,}", 0, 16, None),  # runs are maximal, so those of fewer digits needn't be seen
    "short": (SECRET_NAMES + _SET + _VALUE, 2, 6, 11),
    "bare": ("[A-Za-z0-9+/_=-]{20,}", 0, 20, None),
    "owner": (OWNER_NAMES + _SET + _OWNER_VALUE, 2, 3, None),
    "url": (r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 0, None),
    "host": (HOST_NAMES + _SET + _OWNER_VALUE, 2, 4, None),
}
KINDS = tuple(PATTERNS)
STRONG = KINDS[:3]
#: What a weak candidate needs near it. A hex run counts if it holds a letter and a digit, as numbers are hex digits too.
NEEDS: dict[str, tuple[str, ...]] = {
    "short": ("access", "owner", "url", "host"),
    "bare": ("access", "owner"),
    "owner": ("assign", "hex", "short", "bare"),
    "url": ("assign", "short"),
    "host": ("assign", "short"),
}
#: A bare run needs an upper-case and a lower-case letter and a digit, and lies in no span of these kinds.
HIDES_BARE = ("assign", "access", "hex", "short", "owner", "url", "host")
_COMPILED = {kind: re.compile(p[0].encode()) for kind, p in PATTERNS.items() if kind != "short"}
_BLANK = re.compile(rb"\n[\x20\t\r]*\n")
#: What stands between rows: no pattern runs across it, and no text that is given by Spark's readers needs it.
_BETWEEN = b"\x00\n"


def matches(raw: bytes) -> dict[str, np.ndarray]:
    """Byte starts and ends of each kind's spans in rows put together, whatever stands near them."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    for kind, pattern in _COMPILED.items():
        if kind == "url" and b"://" not in raw:
            continue
        _, group, least, most = PATTERNS[kind]
        for m in pattern.finditer(raw):
            start, end = m.span(group)
            if end - start >= least:
                out[kind].append(m.span())
            elif kind == "assign" and PATTERNS["short"][2] <= end - start <= PATTERNS["short"][3]:
                out["short"].append(m.span())
    mixed = lambda b: re.search(rb"[A-Z]", b) and re.search(rb"[a-z]", b) and re.search(rb"[0-9]", b)
    out["bare"] = [(i, j) for i, j in out["bare"] if mixed(raw[i:j])]
    return {kind: np.array(spans, np.int64).reshape(-1, 2) for kind, spans in out.items()}


def near(own: np.ndarray, others: np.ndarray, reach: int) -> np.ndarray:
    """For each span of ``own`` (key, start, end): the index of a span of ``others`` with the same key at most ``reach``
    away, or -1. The others are sorted and don't overlap; keys are made so far apart that spans of two keys never are near."""
    out = np.full(len(own), -1, np.int64)
    if len(others):
        after = np.searchsorted(others[:, 1], own[:, 1], "left")  # the first that starts where this one does, or later
        for at in (after - 1, after):
            k = np.clip(at, 0, len(others) - 1)
            gap = np.maximum(others[k, 1], own[:, 1]) - np.minimum(others[k, 2], own[:, 2])
            found = (at >= 0) & (at < len(others)) & (others[k, 0] == own[:, 0]) & (gap <= reach) & (out < 0)
            out[found] = k[found]
    return out


def linked(spans: dict[str, np.ndarray], usable_hex: np.ndarray, reach: int = REACH) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each weak kind: the spans (scope, start, end) that have a complementary part near them, and that part's start."""
    parts = {kind: (x[usable_hex] if kind == "hex" else x) for kind, x in spans.items()}
    hidden = np.zeros(len(parts["bare"]), bool)
    for kind in HIDES_BARE:
        found = near(parts["bare"], spans[kind], -1)  # a gap of less than nothing: they overlap
        hidden |= found >= 0
    parts["bare"] = parts["bare"][~hidden]
    out = {}
    for kind, needs in NEEDS.items():
        own = parts[kind]
        partner = np.full(len(own), -1, np.int64)
        for other in needs:
            at = near(own, parts[other], reach)
            new = (at >= 0) & (partner < 0)
            partner[new] = parts[other][at[new], 1]
        out[kind] = own[partner >= 0], partner[partner >= 0]
    return out


def scan(documents: DataFrame, id_column: str = "doc_id", reach: int = REACH) -> DataFrame:
    """(id, spans array<struct<kind, start, end, strong, partner>>): by start, then kind as listed; code points, end exclusive.
    ``partner`` is the start of the part for which a weak one is reported."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_()), ("partner", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                data, offsets, _ = K.valid_text(data, offsets)
                raw = _BETWEEN.join([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                first = offsets[:-1] + len(_BETWEEN) * np.arange(j - i)
                found = matches(raw)
                bytes_ = np.frombuffer(raw, np.uint8)
                points = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((bytes_ & 0xC0) != 0x80, out=points[1:])
                # A scope ends with its row or at a blank line; a number for each, and places so far apart by it that two scopes never are near.
                blank = np.array([m.start() for m in _BLANK.finditer(raw)], np.int64)
                breaks = np.sort(np.concatenate([first[1:], blank]))
                step = points[-1] + reach + 1
                placed, usable = {}, np.ones(len(found["hex"]), bool)
                for kind, x in found.items():
                    scope = np.searchsorted(breaks, x[:, 0], "right")
                    placed[kind] = np.stack([scope, points[x[:, 0]] + scope * step, points[x[:, 1]] + scope * step], axis=1)
                for k, (a, b) in enumerate(found["hex"].tolist()):
                    own = raw[a:b]
                    usable[k] = not own.isdigit() and not own.isalpha()
                kept = {kind: (placed[kind], np.full(len(placed[kind]), -1, np.int64)) for kind in STRONG} | linked(placed, usable, reach)
                spans = np.concatenate([np.column_stack([x[:, 1] - x[:, 0] * step, np.full(len(x), KINDS.index(kind)), x[:, 2] - x[:, 0] * step, np.where(p < 0, -1, p - x[:, 0] * step)]) for kind, (x, p) in kept.items()])
                row = np.searchsorted(points[first], spans[:, 0], "right") - 1 if len(spans) else np.zeros(0, np.int64)
                order = np.lexsort((spans[:, 1], spans[:, 0]))
                spans, row = spans[order], row[order]
                zero = points[first][row]
                kinds, partner = spans[:, 1], spans[:, 3]
                values = pa.StructArray.from_arrays([
                    pa.array([KINDS[k] for k in kinds.tolist()], pa.string()), pa.array(spans[:, 0] - zero), pa.array(spans[:, 2] - zero), pa.array(kinds < len(STRONG)),
                    pa.array(np.maximum(partner - zero, 0), mask=partner < 0),
                ], fields=list(span))
                bounds = np.searchsorted(row, np.arange(j - i + 1), "left")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], [id_column, "spans"])

    schema = f"{id_column} {dict(documents.dtypes)[id_column]}, spans array<struct<kind: string, start: long, end: long, strong: boolean, partner: long>>"
    return documents.select(id_column, "text").mapInArrow(run, schema)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, id_column: str = "doc_id", reach: int = REACH) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row of documents."""
    found = scan(documents, id_column, reach)
    strong = F.filter("spans", lambda s: s["strong"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_column, *[count(k) for k in STRONG], F.sha2(written(strong).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return report(table(spark, sf_dir, "documents"))


def _sql_matches(kind: str) -> str:
    """Spans of one pattern: pieces between the matches and the matches, laid end to end."""
    pattern, group, least, most = PATTERNS[kind]
    pattern = pattern.replace("'", "''")
    size = f"len(regexp_extract(m, '{pattern}', {group}))" if group else "len(m)"
    kept = f"{size} >= {least}" + (f" AND {size} <= {most}" if most is not None else "")
    if kind == "bare":
        kept += " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    return f"""SELECT doc_id, rid, '{kind}' AS kind, {KINDS.index(kind)} AS k, m, s, s + len(m) AS e FROM (
    SELECT doc_id, rid, ms[i] AS m, CAST(list_sum(list_transform(ps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d))) WHERE {kept}"""


def _sql_links() -> str:
    near_ = f"b.rid = a.rid AND b.scope = a.scope AND greatest(a.s, b.s) - least(a.e, b.e) <= {REACH}"
    return " UNION ALL ".join(f"SELECT rid, kind, k, s, e FROM p a WHERE kind = '{kind}' AND EXISTS (SELECT 1 FROM p b WHERE b.kind IN ({', '.join(repr(x) for x in needs)}) AND b.usable AND {near_})" for kind, needs in NEEDS.items())


SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
every AS ({' UNION ALL '.join(_sql_matches(kind) for kind in KINDS)}),
scoped AS (SELECT every.*, len(regexp_extract_all(substr(text, 1, s), '\n[\x20\t\r]*\n')) AS scope, kind <> 'hex' OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]')) AS usable FROM every JOIN d USING (rid)),
p AS (SELECT * FROM scoped a WHERE kind <> 'bare' OR NOT EXISTS (SELECT 1 FROM scoped b WHERE b.rid = a.rid AND b.kind <> 'bare' AND b.s < a.e AND a.s < b.e)),
kept AS (SELECT rid, kind, k, s, e FROM p WHERE k < {len(STRONG)} UNION ALL {_sql_links()}),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {len(STRONG)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
