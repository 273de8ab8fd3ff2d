from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpora
from quillspark.plans import report
from quillspark.sources import archives, readers, sinks, sweeps
from quillspark.streaming import textstats

from .conftest import rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_common_voice(spark, tmp_path):
    write(tmp_path / "train.tsv", 'client_id\tpath\tsentence\na\tv1.mp3\t"Hi there\nb\tv2.mp3\t  \nc\t\tx\nd\tv3.mp3\t two \n')
    assert rows(readers.common_voice(spark, str(tmp_path), "train")) == [("v1.mp3", '"Hi there', "a", "train"), ("v3.mp3", "two", "d", "train")]
    write(tmp_path / "dev.tsv", "path\tsentence\nv9.mp3\tnine\n")
    assert rows(readers.common_voice(spark, str(tmp_path), "validation")) == [("v9.mp3", "nine", "", "validation")]
    with pytest.raises(FileNotFoundError):
        readers.common_voice(spark, str(tmp_path), "test")


def test_clip_durations(spark, tmp_path):
    path = write(tmp_path / "d.tsv", "clip\tduration[ms]\n1\t1000\n2\tx\n3\t\n1\t1500\n")
    assert rows(readers.clip_durations(spark, path)) == [("1", 1.5)]


def test_indices(spark, tmp_path):
    a = write(tmp_path / "a.tsv", "f_1_1\tone\ttwo\nno tab\n\tx\nf_1_2\t\n")
    assert rows(readers.openslr_index(spark, [a])) == [("f_1_1", "one\ttwo")]
    g = write(tmp_path / "g.tsv", "u1\ts1\thi\nu2\t\thi\n")
    assert rows(readers.crowdsourced_index(spark, g)) == [("u1", "s1", "hi")]
    i = write(tmp_path / "i.txt", "SPEAKERID| NAME|SEX|SCRIPTID|DATASET\n104|Kim|f|1|train_data_01\n|x|m|2|test\n")
    assert rows(readers.audio_info(spark, i)) == [("104", "train_data_01")]
    t = write(tmp_path / "t.trans.txt", "104_1  some  text\n104_2\n")
    assert rows(readers.trans_files(spark, t)) == [("104_1", "some text")]


def test_manifest(spark, tmp_path):
    path = write(tmp_path / "m.tsv", 'utt_id\tpath\ttext\tspeaker\tsplit\textra\nu1\tp1\t"say ""hi"""\ts\ttrain\tz\nu2\tp2\t\ts\ttest\tz\n')
    got = readers.manifest(spark, path)
    assert rows(got) == [("u1", "p1", 'say "hi"', "s", "train")]
    sinks.export_manifest(got, str(tmp_path / "out"))
    assert rows(readers.manifest(spark, str(tmp_path / "out"))) == rows(got)
    with pytest.raises(ValueError, match="unknown splits"):
        readers.manifest(spark, write(tmp_path / "n.tsv", "utt_id\tpath\ttext\tspeaker\tsplit\nu\tp\tt\ts\tdev\n"))
    with pytest.raises(ValueError, match="lacks speaker"):
        readers.manifest(spark, write(tmp_path / "o.tsv", "utt_id\tpath\ttext\tsplit\nu\tp\tt\tdev\n"))


def test_trees(spark, tmp_path):
    xml = '<corpus name="c"><speaker id="001" age="-1"><recording audio="a/1.wav" duration="1.2"><orth> one  two </orth></recording><recording audio="a/2.wav"><orth></orth></recording></speaker></corpus>'
    assert rows(readers.corpus_xml(spark, write(tmp_path / "x.xml", xml))) == [("001", "a/1.wav", "one two")]
    records = [{"path": "a", "words": ["x", "y"], "norm_words": ["z"], "speaker_info": {"Speaker_name": "N"}, "split": "train"}, {"path": "b", "words": ["x"], "speaker_info": {}, "split": "train"}, {"path": "c", "words": [], "speaker_info": {"Speaker_name": "N"}, "split": None}]
    got = readers.parliament(spark, write(tmp_path / "p.jsonl", "\n".join(map(json.dumps, records))))
    assert {r.path: (r.text, r.skipped) for r in got.collect()} == {"a": ("x y", None), "b": ("x", "no_speaker"), "c": ("", "unassigned")}
    j = write(tmp_path / "j.jsonl", '{"audio_filepath": "/q/a.wav", "text": "hi"}\nnot json\n')
    assert rows(readers.json_lines(spark, j)) == [("a.wav", "hi")]


def test_stm(spark, tmp_path):
    body = ";; note\nrec 1 spk 0.0 1.5 <o> hello world\nrec 1 inter_segment_gap 1.5 2.0 <o>\nrec 1 spk 2.0 2.0 <o> none\nrec 1 spk 3.0005 4.25 <o> IGNORE_TIME_SEGMENT_IN_SCORING\nrec 1 spk2 120.0 121.0 <o> last one\n"
    write(tmp_path / "train/news/a.stm", body)
    got = readers.stm_tree(spark, str(tmp_path), {"train": ["news"]}).orderBy("start").collect()
    assert [(r.utt_id, r.speaker, r.text, r.seconds) for r in got] == [("news_rec_000000000-000001500", "spk", "hello world", 1.5), ("news_rec_000120000-000121000", "spk2", "last one", 1.0)]


def test_discovery(spark, tmp_path):
    assert readers.sniff("a,b c,d") == "," and readers.sniff("a\tb") == "\t"
    assert readers.speaker_column(["Speaker-ID", "x"]) == "Speaker-ID"
    a = write(tmp_path / "a.tsv", "id\ttext\nu1\tfirst\n")
    b = write(tmp_path / "b.csv", "id,sentence\nu1,second\nu2,two\n")
    c = write(tmp_path / "c.csv", "q,w\n1,2\n")
    assert rows(readers.discovered_metadata(spark, [a, b, c], ["id"], ["text", "sentence"])) == [("u1", "first", ""), ("u2", "two", "")]
    schema = "utt_id string, text string"
    assert rows(corpora.preferring(spark.createDataFrame([("a", "own")], schema), spark.createDataFrame([("a", "index"), ("b", "index")], schema))) == [("a", "own", False, False), ("b", "index", False, True)]
    write(tmp_path / "t/u7.txt", " hello\nyou ")
    assert rows(readers.text_files(spark, str(tmp_path / "t/*.txt"))) == [("u7", "hello you")]
    r = write(tmp_path / "r.json", json.dumps({"locales": {"xx": {"buckets": {"train": 720, "dev": 72}, "avgDurationSecs": 10, "validHrs": 3.5}}}))
    assert rows(readers.release(spark, r)) == [("xx", 720, 72, 0, 10.0, 3.5)]


def test_runs(spark, tmp_path):
    for seed, bump in ((10, 2.0), (9, 0.0)):
        base = tmp_path / f"res/arm/s/seed{seed}"
        write(base / "results.json", json.dumps({"arm": "arm", "scale": "s", "seed": seed, "in_distribution": {"en": {"wer": 10 + bump, "cer": 4, "n": 3, "n_empty_refs": 0}}, "transfer": {"ja": {"wer": 90, "cer": 20, "n": 1, "n_empty_refs": 0}}}))
        write(base / "text_stats.json", json.dumps({"languages": {"ja": {"word_boundary": False, "policy": "ja-cer"}}}))
        write(base / "predictions/en.json", json.dumps({"wer": 1, "cer": 1, "n": 1, "pairs": [["a b", "a c"], ["d", "d"]]}))
        write(base / "transfer/ja/predictions.json", json.dumps({"pairs": [["x", "y"]]}))
    got = readers.run_results(spark, str(tmp_path / "res"), "arm", "s").orderBy("seed", "section").collect()
    assert [(r.seed, r.section, r.lang, r.wer, r.word_boundary, r.policy) for r in got] == [(9, "in_distribution", "en", 10.0, True, None), (9, "transfer", "ja", 90.0, False, "ja-cer"), (10, "in_distribution", "en", 12.0, True, None), (10, "transfer", "ja", 90.0, False, "ja-cer")]
    pairs = readers.sidecars(spark, str(tmp_path / "res/arm/s/seed9"))
    assert rows(pairs) == [("in_distribution", "en", 0, "a b", "a c"), ("in_distribution", "en", 1, "d", "d"), ("transfer", "ja", 0, "x", "y")]
    doc = json.loads(sinks.sidecar_documents(pairs, ["section", "lang"]).where("lang = 'en'").first().document)
    assert {k: doc[k] for k in ("n", "pairs", "n_empty_refs")} == {"n": 2, "pairs": [["a b", "a c"], ["d", "d"]], "n_empty_refs": 0}


def test_audio_headers(spark, tmp_path):
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 64000) + b"\0" * 10
    (tmp_path / "a.wav").write_bytes(wav)
    packed = (16000 << 44) | (0 << 41) | (15 << 36) | 48000
    (tmp_path / "b.flac").write_bytes(b"fLaC" + b"\0\0\0\x22" + b"\0" * 10 + packed.to_bytes(8, "big") + b"\0" * 16)
    (tmp_path / "c.bin").write_bytes(b"zz")
    got = {r.path.rsplit("/", 1)[1]: r.seconds for r in readers.audio_headers(spark, str(tmp_path / "*")).collect()}
    assert got == {"a.wav": 2.0, "b.flac": 3.0, "c.bin": None}


def test_vocabulary_files(spark, tmp_path):
    vocab = spark.createDataFrame([("<blank>", 0), ("<unk>", 1), ("é", 2)], "char string, id int")
    sinks.save_vocabulary(vocab, {"*": {"version": "v"}}, str(tmp_path / "v.json"))
    back, policies = sinks.load_vocabulary(spark, str(tmp_path / "v.json"))
    assert rows(back) == rows(vocab) and policies == {"*": {"version": "v"}}
    old = write(tmp_path / "o.json", '["<blank>", "<unk>", "a"]')
    assert sinks.load_vocabulary(spark, old)[0].count() == 3
    assert sinks.environment(spark)["spark"] == spark.version


def test_report():
    assert report.number(2.675) == "2.67" and report.number(0.125) == "0.12" and report.number(None) == "—"
    assert report.mean_std(1.0, None) == "1.00 ± —" and report.mean_std(float("nan"), 1.0) == "—"
    assert report.table(["a", "b"], [("x|y", 1)]) == "| a | b |\n| --- | --- |\n| x\\|y | 1 |\n"
    with pytest.raises(ValueError, match="cells under"):
        report.table(["a"], [(1, 2)])


def test_stream_equals_batch(spark, tmp_path):
    data = spark.createDataFrame([("2024-01-01 00:10:00", "en", "a b 1"), ("2024-01-01 00:50:00", "en", " "), ("2024-01-01 05:00:00", "de", "x")], "ts string, lang string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    stats = textstats.running(textstats.from_folder(spark, str(tmp_path / "in")))
    textstats.to_folder(stats, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("lang = 'en'").first()
    assert (got.n_utts, got.n_words, got.n_blank, got.n_with_digits) == (2, 3, 1, 1)


# --- archives ---


def _tar(names, **options):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **options) as t:
        for name, size in names:
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"x" * size))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return out.getvalue()


def test_archives_by_ranges(spark, tmp_path):
    """Headers of large archives are read, their bodies aren't."""
    names = [("a/b.wav", 300_000), ("é" * 90 + ".wav", 5), ("../up.wav", 1), ("a/./b.wav", 2)]
    (tmp_path / "one.tar").write_bytes(_tar(names))
    with zipfile.ZipFile(tmp_path / "two words.zip", "w") as z:
        for name, size in names:
            z.writestr(name, b"x" * size)
    (tmp_path / "cut.tar").write_bytes(_tar(names)[:250_000])
    (tmp_path / "no.zip").write_bytes(b"none")
    (tmp_path / "notes.txt").write_text("x")
    got = archives.scan(spark, str(tmp_path / "*"), verify=True).collect()
    of = lambda end: sorted((r.name, r.size) for r in got if r.archive.endswith(end) and r.error is None)
    assert of("one.tar") == sorted(names) and of("words.zip") == sorted(names)
    assert {r.archive.rsplit("/", 1)[1] for r in got if r.error} == {"cut.tar", "no.zip", "notes.txt"}
    whole = _tar([(f"f{k}", 1 << 20) for k in range(8)])
    file = archives.Ranges(lambda offset, size: whole[offset : offset + size], len(whole))
    assert len(list(archives.listed("tar", file))) == 8 and file.fetched < len(whole) / 8


def test_where_members_land(spark):
    names = ["a/b", "./a//b/", "a/./b", "/a", "//a", "a/../b", "..", ".", "", "a/..", "a/b..c"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.deep, r.flat) for r in df.select("name", archives.landing(F.col("name")).alias("deep"), archives.landing(F.col("name"), True).alias("flat")).collect()}
    for n in names:
        pure = PurePosixPath(n)
        deep = None if pure.is_absolute() or ".." in pure.parts else str(pure)
        assert got[n] == (deep, None if pure.name in ("", "..") else pure.name), n


def test_archives_are_refused(spark):
    table = spark.createDataFrame([("a.tar", "tar", 0, "x/1", 1, None), ("b.tar", "tar", 0, "./x/1", 1, None), ("b.tar", "tar", 1, "y/1", 1, None)], archives.MEMBERS)
    with pytest.raises(ValueError, match="one path"):
        archives.require_safe(table, [])
    archives.require_safe(table.where("archive = 'b.tar'"), [])
    with pytest.raises(ValueError, match="one path"):
        archives.require_safe(table.where("archive = 'b.tar'"), [], flat=True)
    with pytest.raises(ValueError, match="unreadable"):
        archives.require_safe(table.withColumn("error", F.lit("cut off")), [])


# --- sweeps ---


def _release(root, rows, durations="clip\tduration[ms]\na\t1000\nb\t2000\na\t3000\nc\tx\n"):
    for name, lines in rows.items():
        write(root / f"{name}.tsv", lines)
    if durations:
        write(root / "clip_durations.tsv", durations)


def test_sweep_over_releases(spark, tmp_path):
    """One job over all languages; each broken one says why."""
    head, good = "client_id\tpath\tsentence\n", {"train": "client_id\tpath\tsentence\ns\ta\tx\ns\tb\tx\ns\t\tx\n", "dev": "sentence\tpath\nx\tc\n", "test": "client_id\tpath\tsentence\tmore\nu\tz\t\"x\t\n\nu\ty\t \n"}
    _release(tmp_path / "ok", good)
    _release(tmp_path / "no header", good | {"dev": "client_id\tpath\ns\tc\n"})
    _release(tmp_path / "gone", {"train": head})
    _release(tmp_path / "bytes", good)
    (tmp_path / "bytes/train.tsv").write_bytes(head.encode() + b"s\ta\t\xff\xfe\n")
    _release(tmp_path / "empty", {"train": "", "dev": head, "test": head})
    roots = {k: str(tmp_path / k) for k in ("ok", "no header", "gone", "bytes", "empty", "nothing")}
    parts, guards = sweeps.voice(spark, roots)
    got = parts.collect()
    assert sorted((r.split, r.n_utts, r.seconds, r.n_missing) for r in got if r.lang == "ok") == [("test", 1, 0.0, 1), ("train", 2, 5.0, 0), ("validation", 1, 0.0, 1)]
    errors = {r.lang: r.error for r in got if r.error}
    assert set(errors) == set(roots) - {"ok"} and all(r.split is None for r in got if r.error) and guards.count() == 0
    assert "lacks sentence" in errors["no header"] and "dev.tsv" in errors["gone"] and "UnicodeDecodeError: 1" in errors["bytes"] and "lacks" in errors["empty"] and "FileNotFoundError" in errors["nothing"]


def test_sweep_with_guard(spark, tmp_path):
    head = "client_id\tpath\tsentence\n"
    files = {"train": head + "a\tv1\tx\n", "dev": head + "d\tv4\tx\n", "test": head + "t\tv6\tx\n", "validated": head + "a\tv1\tx\na\tv3\tx\nd\tv4\tx\nd\tv5\tx\nt\tv6\tx\n"}
    seconds = "clip\tduration[ms]\n" + "".join(f"v{k}\t1000\n" for k in range(1, 7))
    _release(tmp_path / "en", files, seconds)
    _release(tmp_path / "de", files | {"validated": head + "d\tv9\tx\nt\tv1\tx\n"}, seconds)  # the same names in another language
    _release(tmp_path / "fr", files | {"dev": head + "\tv4\tx\n"}, seconds)
    parts, guards = sweeps.voice(spark, {k: str(tmp_path / k) for k in ("en", "de", "fr")}, train_source="validated_minus_eval")
    assert sorted((r.split, r.n_utts, r.seconds) for r in parts.where("lang = 'en'").collect()) == [("test", 1, 1.0), ("train", 2, 2.0), ("validation", 1, 1.0)]
    assert {r.lang: r.error.split(":")[1][:18] for r in parts.where("error is not null").collect()} == {"de": " the guard removes", "fr": " 1 rows have no cl"}
    r = guards.where("lang = 'en'").first()
    assert (r.n_validated, r.n_kept, r.n_in_eval_splits, r.n_eval_speaker_clips, r.n_leaked_speakers, r.seconds_removed_by_guard) == (5, 2, 2, 1, 1, 1.0)
