"""Readers: tables written in the shapes in which corpora are published, and read again.

Each query writes rows of the test tables, odd ones among them (blank texts, missing paths, repeats), as such files under
the shared folder and returns what the reader makes of them. The SQL says which rows and values that must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import comparing, corpora, leakguard, merging, scoring, splits, textstats, vocabulary
from ..scratch import new_folder, write_file, write_lines, write_table
from ..shipping import ship
from ..sources import readers, sinks, specs
from .corpus_queries import _split_sql
from .registry import query, r9, table
from .scoring_queries import RESULTS_SQL, results
from .text_queries import _VOCAB_SQL, bench_vocabulary

def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clips: some without a sentence, some without a path; some sentences begin with a quotation mark."""
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    path = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".mp3")))
    return c.select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("client_id"), path.alias("path"), text.alias("sentence"), F.col("c_custkey").alias("k"))


_CLIPS_SQL = """clips AS (SELECT 's' || c_nationkey AS client_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_custkey || '.mp3' END AS path,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '"' || c_name ELSE c_name END AS text, c_custkey AS k FROM customer),
good AS (SELECT * FROM clips WHERE path <> '' AND text <> '')"""


def _voice(spark: SparkSession, sf_dir: str) -> str:
    """A release: train, dev and test files."""
    root, clips = new_folder(spark, "voice"), _clips(spark, sf_dir)
    for name, rest in (("train", "k % 10 > 1"), ("dev", "k % 10 = 0"), ("test", "k % 10 = 1")):
        write_table(clips.where(rest).drop("k"), f"{root}/{name}.tsv")
    return root


@query(f"WITH {_CLIPS_SQL} SELECT path, text, client_id, 'train' AS split FROM good WHERE k % 10 > 1")
def read_common_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.common_voice(spark, _voice(spark, sf_dir), "train")


@query(f"WITH {_CLIPS_SQL} SELECT path, text, client_id, CASE k % 10 WHEN 0 THEN 'validation' ELSE 'test' END AS split FROM good WHERE k % 10 < 2")
def read_evaluation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.common_voice_evaluation(spark, _voice(spark, sf_dir))


@query(f"WITH {_CLIPS_SQL} SELECT text FROM good WHERE k % 10 = 1")
def load_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's texts by the name of its kind."""
    return readers.load_texts(spark, "commonvoice", _voice(spark, sf_dir), "test")


@query("SELECT c_custkey || '.mp3' AS clip, CAST(c_custkey % 5000 AS DOUBLE) / 1000.0 AS seconds FROM customer WHERE c_custkey % 9 <> 0")
def read_clip_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds by clip; rows without a number are left out."""
    c = table(spark, sf_dir, "customer")
    ms = F.when(F.col("c_custkey") % 9 == 0, "none").otherwise((F.col("c_custkey") % 5000).cast("string"))
    rows = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".mp3")).alias("clip"), ms.alias("duration[ms]"))
    return readers.clip_durations(spark, write_table(rows, f"{new_folder(spark, 'durations')}/clip_durations.tsv"))


@query(rf"""SELECT 'f_' || s_nationkey || '_' || s_suppkey AS file_id, s_name || chr(9) || s_suppkey AS text FROM supplier WHERE s_suppkey % 6 <> 0
UNION ALL SELECT 'm_' || c_nationkey || '_' || c_custkey, c_name FROM customer WHERE c_custkey % 6 <> 0""")
def read_line_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indices of one corpus; the first tab cuts, rows without a text are left out."""
    root = new_folder(spark, "index")
    one, two = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    name = lambda kind, nation, key: F.concat_ws("_", F.lit(kind), F.col(nation).cast("string"), F.col(key).cast("string"))
    female = one.select(F.concat_ws("\t", name("f", "s_nationkey", "s_suppkey"), F.when(F.col("s_suppkey") % 6 == 0, " ").otherwise(F.concat_ws("\t", "s_name", F.col("s_suppkey").cast("string")))).alias("value"))
    male = two.select(F.when(F.col("c_custkey") % 6 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", name("m", "c_nationkey", "c_custkey"), "c_name")).alias("value"))
    return readers.openslr_index(spark, [write_lines(female, f"{root}/line_index_female.tsv"), write_lines(male, f"{root}/line_index_male.tsv")])


@query("SELECT CAST(c_custkey AS VARCHAR) AS utt_id, 'n' || c_nationkey AS speaker, c_name AS text FROM customer WHERE c_custkey % 8 <> 0")
def read_crowdsourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 8 == 0, "").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), "c_name")
    return readers.crowdsourced_index(spark, write_table(rows, f"{new_folder(spark, 'crowd')}/index.tsv", header=False))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 13 == 0, " ").otherwise(F.concat(F.lit('says "'), "c_name", F.lit('"\tand more')))
    split = F.when(F.col("c_custkey") % 10 == 0, "validation").when(F.col("c_custkey") % 10 == 1, "test").otherwise("train")
    rows = c.select(F.col("c_custkey").cast("string").alias("utt_id"), F.concat(F.lit("audio/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"), text.alias("text"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("speaker"), split.alias("split"), F.lit("dropped").alias("more"))
    return readers.manifest(spark, write_table(rows, f"{new_folder(spark, 'manifest')}/manifest.tsv", quoted=True))


_MANIFEST_SQL = """manifest AS (SELECT CAST(c_custkey AS VARCHAR) AS utt_id, 'audio/' || c_custkey || '.wav' AS path, 'says "' || c_name || '"' || chr(9) || 'and more' AS text, 'n' || c_nationkey AS speaker,
  CASE c_custkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 13 <> 0)"""


@query(f"WITH {_MANIFEST_SQL} SELECT * FROM manifest")
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


@query(f"WITH {_MANIFEST_SQL} SELECT * FROM manifest")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest exported for other tools and read again."""
    path = f"{new_folder(spark, 'export')}/manifest.tsv"
    sinks.export_manifest(_manifest(spark, sf_dir), path)
    return readers.manifest(spark, path)


@query(f"WITH {_MANIFEST_SQL} SELECT utt_id, split, 'shipped' AS split_policy FROM manifest")
def manifest_splits_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest whose rows all have a split keeps it."""
    ship(spark)
    rows = _manifest(spark, sf_dir).withColumn("corpus", F.lit("c"))
    return splits.partition_manifest(rows, ["corpus"]).select("utt_id", "split", "split_policy")


_DERIVED = _split_sql("SELECT 'c' AS lang, speaker AS k, count(*) AS n FROM manifest GROUP BY speaker")


@query(f"WITH RECURSIVE {_MANIFEST_SQL}, {_DERIVED} SELECT utt_id, parts.split AS split, 'speaker' AS split_policy FROM manifest JOIN parts ON k = speaker")
def manifest_splits_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One without splits is divided by speaker."""
    ship(spark)
    rows = _manifest(spark, sf_dir).withColumn("corpus", F.lit("c")).withColumn("split", F.lit(""))
    return splits.partition_manifest(rows, ["corpus"]).select("utt_id", "split", "split_policy")


_SIDES = _split_sql("SELECT 'c' AS lang, speaker AS k, count(*) AS n FROM manifest WHERE CAST(substr(speaker, 2) AS INTEGER) % 5 <> 0 GROUP BY speaker")


@query(f"""WITH RECURSIVE {_MANIFEST_SQL}, {_SIDES} SELECT utt_id, CASE WHEN k IS NULL THEN 'test' WHEN parts.split = 'validation' THEN 'validation' ELSE 'train' END AS split FROM manifest LEFT JOIN parts ON k = speaker""")
def splits_with_published_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published test side stays; validation is derived from the training side."""
    ship(spark)
    side = F.when(F.substring("speaker", 2, 9).cast("int") % 5 == 0, "test").otherwise("train")
    rows = _manifest(spark, sf_dir).drop("split").withColumn("corpus", F.lit("c")).withColumn("side", side)
    return splits.partition_with_test(rows, ["corpus"]).select("utt_id", "split")


_OPENSLR = _split_sql("SELECT 'c' AS lang, 'ml_' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS k, count(*) AS n FROM customer GROUP BY c_nationkey")


@query(f"WITH RECURSIVE {_OPENSLR} SELECT 'ml_' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '_' || c_custkey AS file_id, split FROM customer JOIN parts ON k = 'ml_' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0')")
def openslr_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the speakers that file ids name."""
    ship(spark)
    name = F.concat(F.lit("ml_"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("_"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(name.alias("file_id"), F.lit("c").alias("corpus"))
    return splits.derive(rows, ["corpus"], X.openslr_speaker(F.col("file_id")), F.col("file_id")).select("file_id", "split")


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("SPEAKERID"), F.col("s_name").alias(" NAME"), F.concat(F.lit(" part_"), (F.col("s_nationkey") % 4).cast("string")).alias("DATASET "))
    return readers.audio_info(spark, write_table(rows, f"{new_folder(spark, 'info')}/AUDIO_INFO", sep="|"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS speaker, 'part_' || s_nationkey % 4 AS dataset FROM supplier")
def read_audio_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(spark, sf_dir)


@query("SELECT 'part_' || s_nationkey % 4 AS dataset, count(*) AS n FROM supplier GROUP BY 1")
def shipped_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers that a corpus lists for each of its parts."""
    return corpora.shipped_speakers(_info(spark, sf_dir))


@query("SELECT 'u' || p_partkey AS utt_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS text FROM part WHERE p_partkey % 9 <> 0")
def read_trans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a line is its id; lines of an id alone are left out."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.lit(" u"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   ")))).alias("value"))
    return readers.trans_files(spark, write_lines(rows, f"{new_folder(spark, 'trans')}/1.trans.txt"))


@query("SELECT 'n.' || n_nationkey AS utt_id, n_name || ' x' AS text FROM nation")
def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file an utterance, named by its stem. Nations are a few rows."""
    root = new_folder(spark, "texts")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        write_file(spark, f"{root}/n.{r.n_nationkey}.txt", f" {r.n_name}\n x\n")
    return readers.text_files(spark, f"{root}/*.txt")


@query("SELECT 'n.' || n_nationkey || '.txt' AS name, sha256(n_name) AS sha256, md5(n_name) AS md5 FROM nation")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "sums")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        write_file(spark, f"{root}/n.{r.n_nationkey}.txt", r.n_name)
    return readers.checksums(spark, f"{root}/*.txt").select(P.part(F.col("path"), -1).alias("name"), "sha256", "md5")


@query("SELECT ['tab', 'comma', 'space'][c_custkey % 3 + 1] AS file, CAST(c_custkey AS VARCHAR) AS uttID, CASE c_custkey % 3 WHEN 2 THEN replace(c_name, ' ', '_') ELSE c_name END AS transcription, 'n' || c_nationkey AS speaker FROM customer")
def read_sniffed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables cut by tabs, commas and spaces, which their headers tell."""
    root, parts = new_folder(spark, "sniffed"), []
    for k, (name, sep) in enumerate((("tab", "\t"), ("comma", ","), ("space", " "))):
        text = F.replace("c_name", F.lit(" "), F.lit("_")) if name == "space" else F.col("c_name")
        rows = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == k).select(F.col("c_custkey").cast("string").alias("uttID"), text.alias("transcription"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("speaker"))
        parts.append(readers.sniffed_table(spark, write_table(rows, f"{root}/{name}.csv", sep=sep)).withColumn("file", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS utt_id, s_name AS text, 'n' || s_nationkey AS speaker FROM supplier), b AS (SELECT CAST(c_custkey AS VARCHAR) AS utt_id, c_name AS text, '' AS speaker FROM customer)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE utt_id NOT IN (SELECT utt_id FROM a)""")
def read_discovered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that have an id and a text are merged; the first one seen of an id counts."""
    root = new_folder(spark, "metadata")
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("Audio_ID"), F.col("s_name").alias("sentence"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("speaker_id"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"))
    none = table(spark, sf_dir, "region").select(F.col("r_name").alias("other"))
    files = [write_table(a, f"{root}/a.tsv"), write_table(none, f"{root}/n.tsv"), write_table(b, f"{root}/b.csv", sep=",")]
    return readers.discovered_metadata(spark, files, ["audio_id", "id"], ["sentence", "text"])


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS speaker, 'audio/' || c_custkey || '.wav' AS path, c_name AS text FROM customer WHERE c_custkey % 6 <> 0")
def read_corpus_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers with recordings and what was said; ids keep their zeros."""
    c = table(spark, sf_dir, "customer")
    one = F.concat(F.lit('<recording audio="audio/'), F.col("c_custkey").cast("string"), F.lit('.wav" duration="1.0"><orth> '), F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name")), F.lit(" </orth></recording>"))
    by = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(one), "").alias("recordings"))
    lines = by.select(F.concat(F.lit('<speaker id="'), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit('" age="-1">'), "recordings", F.lit("</speaker>")).alias("value"))
    return readers.corpus_xml(spark, write_lines(lines, f"{new_folder(spark, 'xml')}/corpus.xml", 1))


@query("""SELECT o_orderkey || '.wav' AS path, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority || ' ' || o_orderstatus END AS text, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'c' || o_custkey END AS speaker,
  CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'dev' ELSE '' END AS split,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unassigned' WHEN o_orderkey % 11 = 0 THEN 'no_speaker' WHEN o_orderkey % 7 = 0 THEN 'no_text' END AS skipped FROM orders""")
def read_parliament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records, and why one isn't used."""
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", F.lit(" "), "o_orderstatus"))
    speaker = F.struct(F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("Speaker_name"))
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "dev")
    rows = o.select(F.to_json(F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"), said.alias("words"), speaker.alias("speaker_info"), split.alias("split"))).alias("value"))
    return readers.parliament(spark, write_lines(rows, f"{new_folder(spark, 'parliament')}/corpus.jsonl")).select("path", "text", "speaker", "split", "skipped")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcripts with times: comments, gaps, unscored and empty segments among them."""
    root, e = new_folder(spark, "stm"), table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5).alias("k"))
    start, end = F.format_string("%d.%d", F.col("event_id") % 1000, F.col("event_id") % 10), F.format_string("%d.%d", F.col("event_id") % 1000 + 1 - (F.col("event_id") % 17 == 0).cast("int"), F.col("event_id") % 10)
    who = F.when(F.col("event_id") % 13 == 0, "inter_segment_gap").otherwise(F.concat(F.lit("spk"), F.col("k").cast("string")))
    said = F.when(F.col("event_id") % 19 == 0, "").when(F.col("event_id") % 23 == 0, "IGNORE_TIME_SEGMENT_IN_SCORING").otherwise(F.concat(F.lit("utterance  "), F.col("event_id").cast("string")))
    line = F.concat(F.lit("rec"), (F.col("user_id") % 50).cast("string"), F.lit(" 1 "), who, F.lit(" "), start, F.lit(" "), end, F.when(F.col("event_id") % 2 == 0, "<o,f0>").otherwise(" <o> "), F.lit(" "), said)
    value = F.when(F.col("event_id") % 29 == 0, F.concat(F.lit(";; "), line)).otherwise(line).alias("value")
    write_lines(e.where("event_id % 4 > 0").select(value), f"{root}/train/news/a.stm")
    write_lines(e.where("event_id % 4 = 0").select(value), f"{root}/dev/talk/b.stm")
    return readers.stm_tree(spark, root, {"train": ["news"], "dev": ["talk"]})


_SEGMENTS_SQL = """e AS (SELECT *, event_id % 1000 + event_id % 10 / 10.0 AS s, event_id % 1000 + event_id % 10 / 10.0 + 1 AS t, CASE WHEN event_id % 4 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN event_id % 4 = 0 THEN 'talk' ELSE 'news' END AS subset FROM events
  WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0),
segments AS (SELECT subset || '_rec' || user_id % 50 || '_' || lpad(CAST(CAST(round_even(s * 1000, 0) AS BIGINT) AS VARCHAR), 9, '0') || '-' || lpad(CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR), 9, '0') AS utt_id,
  split, subset, 'rec' || user_id % 50 AS recording, 'spk' || event_id % 5 AS speaker, 'utterance ' || event_id AS text, user_id, CAST(s AS DOUBLE) AS start, CAST(t AS DOUBLE) AS "end" FROM e)"""


@query(f"WITH {_SEGMENTS_SQL} SELECT utt_id, split, subset, recording, speaker, text FROM segments")
def read_stm_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("utt_id", "split", "subset", "recording", "speaker", "text")


@query(f"""WITH {_SEGMENTS_SQL} SELECT utt_id, text, 'audio/' || split || '/' || subset || '/' || recording || '/' || substr(utt_id, length(subset) + length(recording) + 3) || '.wav' AS path
FROM segments WHERE user_id % 50 % 3 <> 0""")
def recorded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of recordings that are there, and where each one's audio goes."""
    segments = _segments(spark, sf_dir)
    names = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k")).distinct().where("k % 3 <> 0").select(F.concat(F.lit("rec"), F.col("k").cast("string")).alias("recording"))
    files = names.select(F.explode(F.array(F.struct(F.lit("train").alias("split"), F.lit("news").alias("subset")), F.struct(F.lit("dev").alias("split"), F.lit("talk").alias("subset")))).alias("s"), "recording").select("s.*", "recording")
    there = corpora.recorded_segments(segments, files)
    return there.select("utt_id", "text", P.segment_path(F.col("split"), F.col("subset"), F.col("recording"), F.col("start"), F.col("end")).alias("path"))


@query("SELECT o_orderkey || '.wav' AS path, o_orderpriority AS text FROM orders WHERE o_orderkey % 6 <> 0")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the last part of their path; lines that aren't records are left out."""
    o = table(spark, sf_dir, "orders")
    record = F.to_json(F.struct(F.concat(F.lit("/data/x/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("audio_filepath"), F.concat(F.lit(" "), "o_orderpriority").alias("text")))
    rows = o.select(F.when(F.col("o_orderkey") % 6 == 0, F.lit("{broken")).otherwise(record).alias("value"))
    return readers.json_lines(spark, write_lines(rows, f"{new_folder(spark, 'jsonl')}/manifest.json"))


@query("SELECT p_brand AS locale, sum(p_size) AS train, sum(p_size % 7) AS dev, 0 AS test, round(avg(p_retailprice), 6) AS avg_secs, CAST(count(*) AS DOUBLE) AS valid_hours FROM part GROUP BY p_brand")
def read_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release statistics; a missing bucket is 0."""
    by = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("train"), F.sum(F.col("p_size") % 7).alias("dev"), F.avg("p_retailprice").alias("a"), F.count("*").cast("double").alias("v"))
    one = F.struct(F.create_map(F.lit("train"), "train", F.lit("dev"), "dev").alias("buckets"), F.col("a").alias("avgDurationSecs"), F.col("v").alias("validHrs"))
    doc = by.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_brand", one))).alias("locales"))).alias("value"))
    found = readers.release(spark, write_lines(doc.coalesce(1), f"{new_folder(spark, 'release')}/release.json"))
    return found.where("locale is not null").withColumn("avg_secs", F.round("avg_secs", 6))


def _run(spark: SparkSession, sf_dir: str) -> str:
    """A tree of runs, a folder a seed: aggregates of line items, some hundred rows."""
    root = new_folder(spark, "runs")
    rows = results(spark, sf_dir).where("section <> 'N'")
    one = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("section") == s, F.struct("lang", F.struct("wer", "cer")))))
    bounds = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("lang", F.struct("word_boundary", F.lit("whisper-basic").alias("policy"))))))
    docs = rows.groupBy("seed").agg(F.to_json(F.struct(one("A").alias("in_distribution"), one("R").alias("transfer"))).alias("results"), F.to_json(F.struct(bounds.alias("languages"))).alias("stats"))
    for r in docs.collect():
        write_file(spark, f"{root}/base/s/seed{r.seed}/results.json", r.results)
        write_file(spark, f"{root}/base/s/seed{r.seed}/text_stats.json", r.stats)
    return root


@query(f"WITH {RESULTS_SQL} SELECT CASE section WHEN 'A' THEN 'in_distribution' ELSE 'transfer' END AS section, lang, seed, word_boundary, 'whisper-basic' AS policy, round(wer, 9) AS wer, round(cer, 9) AS cer FROM results WHERE section <> 'N'")
def read_run_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and word boundaries of all seeds of a run."""
    got = readers.run_results(spark, _run(spark, sf_dir), "base", "s")
    return got.select("section", "lang", "seed", "word_boundary", "policy", r9("wer").alias("wer"), r9("cer").alias("cer"))


def _names(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Part names as references of their brand, each with the next one as a hypothesis; ``key`` changes some of these."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lang"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("ref"))
    return p.withColumn("hyp", F.when(F.expr(key), F.concat(F.lit("x"), "ref")).otherwise(F.col("ref")))


def _sidecars(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    root = new_folder(spark, "sidecars")
    sinks.write_sidecars(spark, pairs, root)
    return readers.sidecars(spark, root)


_PAIRS_SQL = "p AS (SELECT p_brand AS lang, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey, p_name AS ref FROM part)"


@query(f"WITH {_PAIRS_SQL} SELECT 'in_distribution' AS section, lang, CAST(pos AS INTEGER) AS pos, ref, CASE WHEN p_partkey % 3 = 0 THEN 'x' || ref ELSE ref END AS hyp FROM p")
def read_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as documents and read by position."""
    return _sidecars(spark, _names(spark, sf_dir, "pos % 3 = 0"))


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT lang, count(*) AS n, sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS b, sum(len(string_split(ref, ' '))) AS w, sum(length(ref)) AS c FROM p GROUP BY lang),
m AS (SELECT lang, n, 'wer' AS metric, 100.0 * a / w AS point_a, 100.0 * b / w AS point_b FROM s UNION ALL SELECT lang, n, 'cer', 100.0 * a / c, 100.0 * b / c FROM s)
SELECT lang, metric, n, round(point_a, 9) AS point_a, round(point_b, 9) AS point_b, round(point_a - point_b, 9) AS delta, metric = 'wer' AS is_primary FROM m""")
def paired_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same utterances: rates, differences, and which metric is the language's own."""
    ship(spark)
    a, b = _sidecars(spark, _names(spark, sf_dir, "pos % 3 = 0")), _sidecars(spark, _names(spark, sf_dir, "pos % 2 = 0"))
    out = comparing.deltas(comparing.paired_edits(a, b, ["section", "lang"]), ["section", "lang", "metric"])
    return out.select("lang", "metric", "n", *[r9(c).alias(c) for c in ("point_a", "point_b", "delta")], scoring.is_primary(F.lit(True), F.col("metric")).alias("is_primary"))


def _bytes(number: Column, size: int, big: bool = False) -> Column:
    """Hex digits of a number's bytes, least first."""
    whole = F.lpad(F.hex(number), 2 * size, "0")
    return whole if big else F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda k: F.substring(whole, 2 * k + 1, F.lit(2))), "")


@query("SELECT o_orderkey, 2.0 * CAST(o_custkey % 1000 AS DOUBLE) / 32000.0 AS wav, CAST(o_custkey * 1000 AS DOUBLE) / 16000.0 AS flac, NULL::DOUBLE AS neither FROM orders")
def audio_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths from file headers, with and without chunks before the samples; null for anything else."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    text = lambda s: F.lit(s.encode().hex())
    number = lambda n, size: _bytes(F.lit(n), size)
    form = F.concat(text("fmt "), number(16, 4), number(1, 2), number(1, 2), number(16000, 4), number(32000, 4), number(2, 2), number(16, 2))
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(text("LIST"), number(5, 4), F.lit("6162636465"), F.lit("00"))).otherwise("")
    samples = 2 * (F.col("k") % 1000)
    wav = F.concat(text("RIFF"), number(0, 4), text("WAVE"), listed, form, listed, text("data"), _bytes(samples, 4), F.repeat(F.lit("00"), samples.cast("int")))
    packed = F.concat(_bytes(F.lit((16000 << 12) | 15 << 4), 4, big=True), _bytes(F.col("k") * 1000, 4, big=True))
    flac = F.concat(text("fLaC"), F.repeat(F.lit("00"), 14), packed, F.repeat(F.lit("00"), 20))
    made = o.select("o_orderkey", F.unhex(wav).alias("w"), F.unhex(flac).alias("f"), F.lit(b"RIFF none").alias("n"))
    length = lambda c: F.coalesce(readers.wav_seconds(F.col(c)), readers.flac_stream(F.col(c))["seconds"])
    return made.select("o_orderkey", length("w").alias("wav"), length("f").alias("flac"), length("n").alias("neither"))


@query(r"""WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Train' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' ELSE 'other' END AS d, 'c' || o_custkey AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'plain' ELSE 'c' || o_custkey || '-' || o_orderkey || '-x' END AS n FROM orders)
SELECT k, CASE lower(d) WHEN 'train' THEN 'train' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'test' END AS split, s AS speaker, CASE WHEN n = 'plain' THEN n ELSE k || '-x' END AS audio_id, n || '.b' AS stem,
  'U-Tsang_dialect' AS dialect, 'U-Tsang_dialect-speaker_' || k AS numbered, CASE WHEN k % 3 = 0 THEN NULL ELSE 'audio/' || k || '/x.wav' END AS bare FROM f""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits, speakers, ids and dialects that paths name."""
    folder = F.when(F.col("o_orderkey") % 4 == 0, "Train").when(F.col("o_orderkey") % 4 == 1, "dev").when(F.col("o_orderkey") % 4 == 2, "test").otherwise("other")
    key, who = F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    name = F.when(F.col("o_orderkey") % 5 == 0, "plain").otherwise(F.concat(who, F.lit("-"), key, F.lit("-x")))
    files = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.concat_ws("/", F.lit("root"), folder, who, F.concat(name, F.lit(".b.flac"))).alias("a"),
        F.concat_ws("/", F.lit("dialect data"), F.lit("U-Tsang dialect"), F.lit("deep"), F.concat(F.lit("Speaker "), key), F.lit("1.wav")).alias("b"),
        F.concat_ws("/", F.when(F.col("o_orderkey") % 3 == 0, "other").when(F.col("o_orderkey") % 3 == 1, "corp_x"), F.lit("audio"), key, F.lit("x.wav")).alias("c"),
    )
    a, b = F.col("a"), F.col("b")
    return files.select(
        "k", P.folder_split(a).alias("split"), P.speaker_folder(a).alias("speaker"), F.regexp_replace(P.audio_id(a), r"\.b$", "").alias("audio_id"), P.stem(a).alias("stem"),
        P.dialect(b).alias("dialect"), P.numbered_speaker(b).alias("numbered"), P.without_corpus_prefix(F.col("c"), "corp_x").alias("bare"),
    )


@query("""WITH n AS (SELECT doc_id, coalesce(regexp_replace(text, CASE WHEN doc_id % 2 = 0 THEN '[^A-Za-z]' ELSE '[^A-Z]' END, '', 'g'), '') AS name FROM documents)
SELECT doc_id, CASE WHEN length(name) <= 200 THEN name ELSE substr(name, 1, 184) || '-' || substr(sha1(name), 1, 8) END AS safe FROM n""")
def safe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of at most 200 bytes, from the letters or the capitals of whole texts."""
    name = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[^A-Za-z]", "")).otherwise(F.regexp_replace("text", "[^A-Z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_component(F.coalesce(name, F.lit(""))).alias("safe"))


#: Scripts and whether words are delimited in them.
_BOUNDARIES = (("en", "Latn", True), ("ja", "Jpan", False), ("zh-CN", "Hans", False), ("zh-TW", "Hant", False), ("ko", "Kore", True), ("bo", "Tibt", False), ("th", "Thai", False), ("ml", "Mlym", True), ("my-x-y", "Mymr", False))


@query(f"SELECT c_custkey, split_part({[c for c, _, _ in _BOUNDARIES]}[c_custkey % {len(_BOUNDARIES)} + 1], '-', 1) AS base, {[b for _, _, b in _BOUNDARIES]}[c_custkey % {len(_BOUNDARIES)} + 1] AS word_boundary FROM customer")
def word_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as languages: which scripts put spaces between words."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _BOUNDARIES]), (F.col("c_custkey") % len(_BOUNDARIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(0).alias("code"), pick(1).alias("script"))
    return rows.select("c_custkey", X.base_locale(F.col("code")).alias("base"), P.word_boundary(F.col("script")).alias("word_boundary"))


@query("SELECT c_custkey, s_name AS text, c_name AS name FROM customer JOIN supplier ON s_suppkey = c_custkey")
def index_with_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index whose recording is there."""
    index = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return corpora.with_audio(index, files, "c_custkey").select("c_custkey", F.col("s_name").alias("text"), F.col("c_name").alias("name"))


@query("""WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS utt_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS text FROM supplier),
f AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS audio_id, CAST(c_custkey // 2 AS VARCHAR) AS stem FROM customer)
SELECT c_custkey, coalesce(a.text, b.text) AS text FROM f LEFT JOIN t a ON a.utt_id = audio_id AND a.text <> '' LEFT JOIN t b ON b.utt_id = stem AND b.text <> ''""")
def transcripts_by_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's transcript by its id, or by its stem."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("utt_id"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("text"))
    files = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("audio_id"), F.floor(F.col("c_custkey") / 2).cast("long").cast("string").alias("stem"))
    return corpora.by_either_key(files, known, "audio_id", "stem").select("c_custkey", "text")


@query("SELECT lang, doc_id FROM documents WHERE lang IS NOT NULL")
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sets of all languages as one table."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    codes = [r.lang for r in d.select("lang").distinct().collect()]  # a handful
    return corpora.concatenated({code: d.where(F.col("lang") == code).select("doc_id") for code in codes}).select("lang", "doc_id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def shared_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers on both sides of a division."""
    o = table(spark, sf_dir, "orders")
    return leakguard.shared_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query("""WITH r AS (SELECT c_custkey AS ord, 'corpus' || c_custkey AS id, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS code FROM customer) SELECT code, arg_max(id, ord) AS corpus FROM r GROUP BY code""")
def corpus_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several corpora of a language the last one."""
    c = table(spark, sf_dir, "customer")
    return specs.corpus_by_language(c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("corpus"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("languages")))


@query("SELECT l_returnflag AS key, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def merge_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that aren't numbers on which experts disagree."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("expert"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"))
    return merging.disagreeing(entries)


@query(f"""WITH {_VOCAB_SQL} SELECT char, id FROM vocab""")
def vocabulary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary saved and loaded."""
    path = f"{new_folder(spark, 'vocabulary')}/vocab.json"
    sinks.save_vocabulary(bench_vocabulary(spark, sf_dir), {"*": {"version": "whisper-basic"}}, path)
    return sinks.load_vocabulary(spark, path)[0]


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS i, [CAST(l_quantity % 3 AS DOUBLE), CAST(l_partkey % 4 AS DOUBLE), CAST(l_suppkey % 5 AS DOUBLE), CAST(l_linenumber % 3 AS DOUBLE)] AS s FROM lineitem),
b AS (SELECT k, i, s, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS id FROM f), n AS (SELECT k, count(*) AS m FROM b GROUP BY k), g AS (SELECT b.*, lag(id) OVER (PARTITION BY b.k ORDER BY i, s) AS before, row_number() OVER (PARTITION BY b.k ORDER BY i, s) AS r, m FROM b JOIN n USING (k)),
c AS (SELECT k, string_agg(CASE id WHEN 2 THEN 'a' ELSE 'b' END, '' ORDER BY i, s) AS text FROM g WHERE r <= m - 1 AND id > 1 AND id IS DISTINCT FROM before GROUP BY k)
SELECT n.k, coalesce(text, '') AS text FROM n LEFT JOIN c USING (k)""")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best id of each frame up to the valid length, repeats collapsed, as text."""
    score = F.array(*[x.cast("double") for x in (F.col("l_quantity") % 3, F.col("l_partkey") % 4, F.col("l_suppkey") % 5, F.col("l_linenumber") % 3)])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", score.alias("s")))), lambda x: x["s"])
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(ordered.alias("scores"))
    known = spark.createDataFrame([("<blank>", 0), ("<unk>", 1), ("a", 2), ("b", 3)], "char string, id int")
    best = frames.select("k", vocabulary.greedy(F.col("scores"), F.size("scores") - 1).alias("ids"))
    return vocabulary.decode(best, known).select("k", "text")


@query(f"""WITH {_VOCAB_SQL}, d AS (SELECT lang, lower(coalesce(text, '')) AS x FROM documents), c AS (SELECT lang, unnest(string_split(x, '')) AS char FROM d),
u AS (SELECT lang, count(*) FILTER (WHERE char <> '' AND char NOT IN (SELECT char FROM vocab)) AS unk, count(*) FILTER (WHERE char <> '') AS total FROM c GROUP BY lang)
SELECT lang, round(unk / total, 9) AS unk_rate FROM u WHERE unk / total > 0.001""")
def unknown_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of which more than a thousandth can't be produced; here texts keep their punctuation."""
    rows = table(spark, sf_dir, "documents").select("lang", F.lower(F.coalesce("text", F.lit(""))).alias("normalized"))
    marked = textstats.unknown_characters(rows, bench_vocabulary(spark, sf_dir))
    rates = marked.groupBy("lang").agg((F.sum("unknown") / F.sum(F.length("normalized"))).alias("unk_rate"))
    return textstats.warn_unknown(rates).select("lang", r9("unk_rate").alias("unk_rate"))
