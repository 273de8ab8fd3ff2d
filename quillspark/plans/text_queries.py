"""Text: normalization, statistics, vocabularies, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies as P
from ..functions import text as X
from ..functions.normalize import normalized
from ..operators import scoring, textstats, vocabulary
from ..shipping import ship
from .registry import basic_sql, query, r9, table, words_sql

_SPANS_SQL = r"regexp_replace(regexp_replace(coalesce(text, ''), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+?\)', '', 'g')"
# None of the tables' words holds an apostrophe between letters, so the rule for it shows in the unit tests only.
_MARKS_SQL = rf"trim(regexp_replace(regexp_replace(lower({_SPANS_SQL}), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+', ' ', 'g'))"
_DELETE_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g'))"
_CLASSIC_SQL = r"trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g')), 'ß', 'ss'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE_SQL = r"regexp_replace(regexp_replace(replace(strip_accents(lower(" + _SPANS_SQL + r")), 'ß', 'ss'), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g')"


def _normalize(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text"), policy).alias("normalized"))


@query(f"SELECT doc_id, {basic_sql("coalesce(text, '')")} AS normalized FROM documents")
def normalize_whisper_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalize(spark, sf_dir, "whisper-basic")


@query(f"SELECT doc_id, {_BARE_SQL} AS normalized FROM documents")
def normalize_whisper_basic_nodiacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalize(spark, sf_dir, "whisper-basic-nodiacritics")


@query(f"SELECT doc_id, {_CLASSIC_SQL} AS normalized FROM documents")
def normalize_norm_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalize(spark, sf_dir, "norm-1")


def _register_script_policies() -> None:
    for name in P.POLICIES:
        if name in ("whisper-basic", "whisper-basic-nodiacritics", "norm-1", "turkic-tr", "arabic-ouaal", "perso-arabic", "uyghur-ug"):
            continue

        def run(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            return _normalize(spark, sf_dir, name)

        run.__name__ = "normalize_" + name.replace("-", "_")
        query(f"SELECT doc_id, {_DELETE_SQL if name == 'indic-vistaar' else _MARKS_SQL} AS normalized FROM documents")(run)
    for name, sql in (("turkic-tr", _MARKS_SQL.replace("lower(", "lower(replace(").replace("'g')), '[", "'g'), 'I', 'ı')), '[")), ("arabic-ouaal", _MARKS_SQL.replace(_SPANS_SQL, "coalesce(text, '')")), ("perso-arabic", _MARKS_SQL.replace(_SPANS_SQL, "coalesce(text, '')")), ("uyghur-ug", _MARKS_SQL.replace(_SPANS_SQL, "coalesce(text, '')"))):

        def run(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            return _normalize(spark, sf_dir, name)

        run.__name__ = "normalize_" + name.replace("-", "_")
        query(f"SELECT doc_id, {sql} AS normalized FROM documents")(run)


_register_script_policies()


@query(rf"""WITH n AS (SELECT lang, coalesce(text, '') AS t, {basic_sql("coalesce(text, '')")} AS x, lower({_SPANS_SQL}) AS cut FROM documents),
w AS (SELECT *, trim(x) = '' AS blank, len({words_sql("x")}) AS tokens FROM n)
SELECT lang, count(*) AS n_utts, CAST(sum(length(t)) AS BIGINT) AS n_chars_raw, CAST(sum(length(x)) AS BIGINT) AS n_chars_normalized, count(*) FILTER (WHERE regexp_matches(t, '[\p{{Nd}}\p{{Nl}}\p{{No}}]')) AS n_utts_with_digits,
  count(*) FILTER (WHERE blank) AS n_utts_empty_after_norm, CAST(coalesce(median(CAST(tokens AS DOUBLE)) FILTER (WHERE NOT blank), 0) AS DOUBLE) AS median_tokens_per_utt,
  count(*) > 0 AND coalesce(median(CAST(tokens AS DOUBLE)) FILTER (WHERE NOT blank), 0) <= 1 AS looks_unspaced,
  CAST(sum(length(cut) - length(regexp_replace(cut, '\p{{P}}', '', 'g'))) AS BIGINT) AS removed_p, CAST(sum(length(cut) - length(regexp_replace(cut, '\p{{S}}', '', 'g'))) AS BIGINT) AS removed_s FROM w GROUP BY lang""")
def text_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of whole texts, with what the policy removed."""
    ship(spark)
    rows = textstats.prepared(table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")), "whisper-basic")
    out = textstats.text_stats(rows, ["lang"], counts="counts")
    return out.select("lang", "n_utts", "n_chars_raw", "n_chars_normalized", "n_utts_with_digits", "n_utts_empty_after_norm", "median_tokens_per_utt", "looks_unspaced", F.col("removed_P").alias("removed_p"), F.col("removed_S").alias("removed_s"))


def bench_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "benchmark").select("item_id", normalized(F.col("text"), "whisper-basic").alias("normalized"))


def bench_vocabulary(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    return vocabulary.build(spark, vocabulary.character_counts(bench_text(spark, sf_dir)), least)


_CHARS_SQL = f"chars AS (SELECT unnest(string_split({basic_sql('text')}, '')) AS char FROM benchmark), counts AS (SELECT char, count(*) AS n FROM chars WHERE char <> '' GROUP BY char)"
_VOCAB_SQL = f"{_CHARS_SQL}, vocab AS (SELECT '<blank>' AS char, 0 AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT char, CAST(1 + row_number() OVER (ORDER BY char) AS INTEGER) FROM counts WHERE n >= 5)"


@query(f"WITH {_VOCAB_SQL} SELECT * FROM vocab")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_vocabulary(spark, sf_dir)


#: A floor that leaves some letters of the benchmark out.
FLOOR = 15


@query(f"WITH {_CHARS_SQL} SELECT char, n, n < {FLOOR} AS evicted FROM counts")
def vocab_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the floor keeps, and what it evicts."""
    kept, evicted = vocabulary.floored(vocabulary.character_counts(bench_text(spark, sf_dir)), FLOOR)
    return kept.withColumn("evicted", F.lit(False)).unionByName(evicted.withColumn("evicted", F.lit(True)))


@query(f"""WITH {_VOCAB_SQL}, n AS (SELECT lang, {basic_sql("coalesce(text, '')")} AS x FROM documents), c AS (SELECT lang, x, unnest(string_split(x, '')) AS char FROM n WHERE trim(x) <> ''),
u AS (SELECT lang, count(*) AS unk FROM c WHERE char <> '' AND char NOT IN (SELECT char FROM vocab) GROUP BY lang), t AS (SELECT lang, sum(length(x)) AS total FROM n GROUP BY lang)
SELECT lang, coalesce(unk, 0) AS unk_chars, round(coalesce(unk, 0) / total, 9) AS unk_rate, coalesce(unk, 0) / total > 0.001 AS warned FROM t LEFT JOIN u USING (lang)""")
def unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"), normalized(F.col("text"), "whisper-basic").alias("normalized"))
    marked = textstats.unknown_characters(rows, bench_vocabulary(spark, sf_dir))
    out = textstats.text_stats(marked, ["lang"], unknown="unknown")
    return out.select("lang", "unk_chars", r9("unk_rate").alias("unk_rate"), (F.col("unk_rate") > textstats.UNKNOWN_WARNING).alias("warned"))


@query(f"""WITH {_VOCAB_SQL}, c AS (SELECT unnest(string_split({basic_sql("coalesce(text, '')")}, '')) AS char FROM documents), f AS (SELECT char, count(*) AS n FROM c WHERE char <> '' AND char NOT IN (SELECT char FROM vocab) GROUP BY char)
SELECT * FROM vocab UNION ALL SELECT char, CAST((SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY char) AS INTEGER) FROM f WHERE n >= 20""")
def vocab_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    known = bench_vocabulary(spark, sf_dir)
    fresh = vocabulary.character_counts(table(spark, sf_dir, "documents").select(normalized(F.col("text"), "whisper-basic").alias("normalized")))
    return vocabulary.expand(known, fresh, 20)


@query(f"""WITH {_VOCAB_SQL}, n AS (SELECT item_id, {basic_sql('text')} AS x FROM benchmark), c AS (SELECT item_id, unnest(range(1, length(x) + 1)) AS i, x FROM n)
SELECT item_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY i) AS ids FROM c LEFT JOIN vocab ON char = x[i] GROUP BY item_id""")
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vocabulary.encode(bench_text(spark, sf_dir), bench_vocabulary(spark, sf_dir))
    return out.select("item_id", F.array_join(F.transform("ids", lambda k: k.cast("string")), " ").alias("ids"))


@query("""WITH t AS (SELECT lang, median(CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS DOUBLE)) <= 1 AS unspaced FROM documents GROUP BY lang)
SELECT lang, CASE WHEN lang <> 'de' AND unspaced THEN 'declared spaced, looks unspaced' WHEN lang = 'de' AND NOT unspaced THEN 'declared unspaced, looks spaced' END AS warning FROM t""")
def boundary_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language is declared unspaced: the transcripts contradict it."""
    texts = table(spark, sf_dir, "documents")
    seen = texts.groupBy("lang").agg((F.median(F.size(X.words(F.col("text")))) <= 1).alias("unspaced"))
    return seen.select("lang", scoring.boundary_contradiction(F.col("lang") != "de", F.col("unspaced")).alias("warning"))


#: Languages and the policy that each must get, one or more for every rule, written out apart from the tables under test.
EXPECTED_POLICIES = (
    ("de", "whisper-basic"), ("vi", "whisper-basic"), ("ru", "whisper-basic"), ("ka", "whisper-basic"), ("el", "whisper-basic"), ("zu", "whisper-basic"),
    ("tr", "turkic-tr"), ("az", "turkic-tr"), ("ar", "arabic-ouaal"), ("fa", "perso-arabic"), ("ur", "perso-arabic"), ("ckb", "perso-arabic"), ("ps", "perso-arabic"), ("ug", "uyghur-ug"),
    ("sw", "latin-marks"), ("rw", "latin-marks"), ("yo", "latin-marks"), ("ig", "latin-marks"),
    ("hi", "indic-vistaar"), ("marathi", "indic-vistaar"), ("bn", "indic-vistaar"), ("pa-IN", "indic-vistaar"), ("gu", "indic-vistaar"), ("odia", "indic-vistaar"), ("ta", "indic-vistaar"), ("te", "indic-vistaar"), ("kn", "indic-vistaar"), ("ml", "indic-vistaar"), ("si", "indic-vistaar"),
    ("th", "thai-cer"), ("bo", "tibetan-syllable"), ("ko", "ko-kspon"), ("hy-AM", "armenian-hy"), ("hy", "armenian-hy"), ("zh-CN", "han-mer"), ("yue", "han-mer"), ("ja", "ja-cer"),
    ("xx", "whisper-basic"), ("tlh", "whisper-basic"),
)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of a preset: each has a language, every eleventh names its policy itself."""
    codes = F.array(*[F.lit(c) for c, _ in EXPECTED_POLICIES])
    named = F.when(F.col("c_custkey") % 11 == 0, "cyrillic-yo")
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(codes, (F.col("c_custkey") % len(EXPECTED_POLICIES) + 1).cast("int")).alias("code"), named.alias("normalizer"))


_CODED_SQL = f"SELECT c_custkey, {[c for c, _ in EXPECTED_POLICIES]}[c_custkey % {len(EXPECTED_POLICIES)} + 1] AS code, {[p for _, p in EXPECTED_POLICIES]}[c_custkey % {len(EXPECTED_POLICIES)} + 1] AS policy FROM customer"


@query(f"SELECT c_custkey, code, CASE WHEN c_custkey % 11 = 0 THEN 'cyrillic-yo' ELSE policy END AS policy FROM ({_CODED_SQL})")
def policy_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit name over language over script over default."""
    return P.with_policy(_coded(spark, sf_dir)).select("c_custkey", "code", "policy")


@query(f"SELECT policy, count(*) AS n, count(DISTINCT code) AS n_languages, 'latin-marks' AS overridden FROM ({_CODED_SQL}) WHERE c_custkey % 11 <> 0 GROUP BY policy")
def policies_of_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and languages by policy; an override of the whole preset replaces every one of them."""
    rows = _coded(spark, sf_dir).where("normalizer is null")
    both = P.with_policy(rows).join(P.with_policy(rows, override="latin-marks").select("c_custkey", F.col("policy").alias("overridden")), "c_custkey")
    return both.groupBy("policy").agg(F.count("*").alias("n"), F.count_distinct("code").alias("n_languages"), F.max("overridden").alias("overridden"))


_LITERALS = ["كِتَابٌ", "a\u200bb\u200cc\u200dd\u00ade", "x\u200ey\u200fz\u061cw", "١٢٣ ۴۵۶", "it’s ‘ok’ ʼnʹ", "قـال", "  plain \t text\n", "½ cup", ""]
_SQL_LITERALS = ", ".join("''" if not x else " || ".join(f"chr({ord(c)})" for c in x) for x in _LITERALS)


@query(rf"""WITH v AS (SELECT doc_id AS k, coalesce(text, '') || [{_SQL_LITERALS}][doc_id % {len(_LITERALS)} + 1] AS x FROM documents)
SELECT k, length(x) - length(regexp_replace(x, '[\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06ED}}\x{{0640}}]', '', 'g')) AS arabic_marks,
  sha1(regexp_replace(x, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{00AD}}\x{{FEFF}}\x{{200E}}\x{{200F}}\x{{061C}}]', '', 'g')) AS visible, sha1(translate(x, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) AS digits,
  sha1(translate(x, '’‘‛ʼʹ՚', '''''''''''''')) AS apostrophes, sha1(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS collapsed FROM v""")
def character_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, invisible characters, digits, apostrophes and white space, in every document and what is put at its end."""
    x, odd = F.col("x"), F.array(*[F.lit(t) for t in _LITERALS])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.concat(F.coalesce("text", F.lit("")), F.element_at(odd, (F.col("doc_id") % len(_LITERALS) + 1).cast("int"))).alias("x"))
    sha = lambda c: F.sha1(c.cast("binary"))
    return rows.select("k", X.count_arabic_marks(x).cast("long").alias("arabic_marks"), sha(X.zero_width(x)).alias("visible"), sha(X.eastern_digits_to_ascii(x)).alias("digits"), sha(X.unify_apostrophes(x)).alias("apostrophes"), sha(X.collapse(x)).alias("collapsed"))


#: Put at the end of texts, so that every kind of character that a rule counts is there: format, control, private use,
#: unassigned, Arabic vowel signs.
_ODD = ["\u200b\u200e", "\x07\x01", "\ue000", "\u0378", "\u064b\u0640\u0650", "$+", "", "É!"]
_SQL_ODD = ", ".join("''" if not x else " || ".join(f"chr({ord(c)})" for c in x) for x in _ODD)
_COUNT_SQL = lambda sign: f"CAST(sum(length(x) - length(regexp_replace(x, '{sign}', '', 'g'))) AS BIGINT)"


@query(rf"""WITH t AS (SELECT lang, coalesce(text, '') || [{_SQL_ODD}][doc_id % {len(_ODD)} + 1] AS x FROM documents)
SELECT lang, 0::BIGINT AS m, {_COUNT_SQL(r'[\p{P}]')} AS p, {_COUNT_SQL(r'[\p{S}]')} AS s, {_COUNT_SQL(r'[\x{064B}-\x{0652}\x{0640}]')} AS arabic_marks, {_COUNT_SQL(r'[\x00-\x1f\x7f]')} AS cc, {_COUNT_SQL(r'\p{Cf}')} AS cf,
  {_COUNT_SQL(r'\x{0378}')} AS cn, {_COUNT_SQL(r'\p{Co}')} AS co, 0::BIGINT AS cs, {_COUNT_SQL(r'[\p{Lu}\p{Lt}ß]')} AS case_changed FROM t GROUP BY lang""")
def removal_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default rules of one pipeline remove, by every kind that is counted; those that never occur are 0."""
    ship(spark)
    odd = F.array(*[F.lit(t) for t in _ODD])
    rows = table(spark, sf_dir, "documents").select("lang", F.concat(F.coalesce("text", F.lit("")), F.element_at(odd, (F.col("doc_id") % len(_ODD) + 1).cast("int"))).alias("text"))
    out = textstats.text_stats(textstats.prepared(rows, "norm-1"), ["lang"], counts="counts")
    return out.select("lang", *[F.col(f"removed_{k}").alias(k.lower()) for k in ("M", "P", "S", "arabic_marks", "Cc", "Cf", "Cn", "Co", "Cs")], F.col("case_changed_chars").alias("case_changed"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS collapsed, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS n_words FROM documents")
def collapse_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse(text).alias("collapsed"), F.size(X.words(text)).cast("long").alias("n_words"))


def _frames_sql(n: str) -> str:
    for k, s in zip(X.KERNELS, X.STRIDES, strict=True):
        n = f"greatest(0, CAST(floor(({n} - {k}) / {s}.0) AS BIGINT) + 1)"
    return n


@query(f"SELECT doc_id, {_frames_sql('n_chars * 400')} AS frames, CASE WHEN trim(x) = '' THEN 'blank' WHEN length(x) > {_frames_sql('n_chars * 400')} THEN 'unalignable' ELSE 'usable' END AS disposition, n_chars * 400 >= 200000 AS at_guard FROM (SELECT *, {basic_sql("coalesce(text, '')")} AS x FROM documents)")
def alignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame budget and what training would do to each row."""
    from ..operators import frames

    ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 400).alias("samples"), normalized(F.col("text"), "whisper-basic").alias("normalized"))
    return frames.alignment(rows, "normalized", "samples").select("doc_id", "frames", "disposition", "at_guard")


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'utt' || c_custkey ELSE 'ml_' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '_' || c_custkey END AS file_id FROM customer)
SELECT c_custkey, CASE WHEN len(string_split(file_id, '_')) = 3 THEN string_split(file_id, '_')[1] || '_' || string_split(file_id, '_')[2] END AS speaker, string_split(file_id, '_')[1] AS prefix FROM f""")
def speaker_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("ml_"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("_"), F.col("c_custkey").cast("string"))
    ids = c.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("utt"), F.col("c_custkey").cast("string"))).otherwise(name).alias("file_id"))
    return ids.select("c_custkey", X.openslr_speaker(F.col("file_id")).alias("speaker"), X.speaker_before(F.col("file_id"), "_").alias("prefix"))


@query("SELECT event_id, least(CAST(floor(value * 16000) AS BIGINT), 100000) AS first, least(CAST(floor((value + 1.5) * 16000) AS BIGINT), 100000) AS last, lpad(CAST(CAST(round_even(value * 1000, 0) AS BIGINT) AS VARCHAR), 9, '0') AS stamp FROM events WHERE value >= 0")
def segment_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last frame of segments no later than the recording's end, and their millisecond stamps."""
    e = table(spark, sf_dir, "events").where("value >= 0")
    first, last = X.clamp_segment(F.col("value"), F.col("value") + 1.5, F.lit(16000), F.lit(100000).cast("long"))
    return e.select("event_id", first.alias("first"), last.alias("last"), X.milliseconds_id(F.col("value")).alias("stamp"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey < 500 THEN o_orderkey / 500.0 ELSE greatest(0.0, (10000 - o_orderkey) / 9500.0) END, 9) AS factor FROM orders")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", r9(X.learning_rate_factor(F.col("o_orderkey"), 500, 10_000)).alias("factor"))
