from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators import durations
from quillspark.plans import report
from quillspark.sources import readers, repository, sinks, specs

from .conftest import rows
from .test_sources import write

PRESET = "languages:\n  - { code: en, source: commonvoice, hf_config: en, normalizer: whisper-basic }\n  - { code: te, source: openslr, slr: 66, archives: [a.zip], index_files: [a.tsv], word_boundary: true }\n"


def test_presets(spark, tmp_path):
    path = write(tmp_path / "p.yaml", PRESET)
    got = specs.preset(spark, path)
    assert [(r.ord, r.code, r.archives) for r in got.orderBy("ord").collect()] == [(0, "en", []), (1, "te", ["a.zip"])]
    assert specs.in_scope([got, got]).count() == 2
    for text, why in (("languages: []", "no languages"), ("languages: [{code: x, source: tape}]", "unknown source"), ("languages: [{code: x, source: commonvoice}]", "needs hf_config"), ("languages: [{code: x, source: commonvoice, hf_config: x, q: 1}]", "unknown keys"), ("languages: [{source: manifest}]", "missing keys"), ("languages: [{code: x, source: openslr, slr: 1, archives: [a], index_files: []}]", "index files")):
        with pytest.raises(ValueError, match=why):
            specs.preset(spark, write(tmp_path / "q.yaml", text))
    base = {"id": "c", "ships_split": "none", "speaker_ids": "path", "languages": ["x"], "downloads": []} | dict.fromkeys("name source_page licence_name licence_url audio_format transcripts preparer citation".split(), "t")
    registry = specs.corpora(spark, write(tmp_path / "c.yaml", json.dumps({"corpora": [base, base | {"id": "d", "total_hours": 3}]})))
    assert rows(specs.corpus_by_language(registry)) == [("x", "d")]
    with pytest.raises(ValueError, match="not one of"):
        specs.corpora(spark, write(tmp_path / "d.yaml", json.dumps({"corpora": [base | {"ships_split": "some"}]})))
    assert specs.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}, "d": 1}


def test_repository(spark):
    mets = '<m:mets xmlns:m="u" xmlns:x="v" xmlns:dim="w"><dim:field element="rights" qualifier="uri">no</dim:field><dim:field element="rights"> CC BY-SA 4.0 </dim:field><m:file SIZE="12" CHECKSUM="AB" CHECKSUMTYPE="MD5"><m:FLocat x:href="/b/f.tgz?sequence=1"/></m:file><m:file/></m:mets>'
    assert repository.require_licence(repository.licence(mets), "BY-SA") == "CC BY-SA 4.0"
    assert repository.bitstreams(mets, "https://h.example/") == {"f.tgz": {"url": "https://h.example/b/f.tgz?sequence=1", "bytes": 12, "md5": "ab"}}
    with pytest.raises(ValueError, match="without"):
        repository.require_licence("other", "BY-SA")
    paths = ["train/transcriptions/stm/n/a.stm", "train/transcriptions/stm/n/a.vtt", "train/audio/n/a.wav", "x/audio/n/a.wav"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(repository.is_stm(F.col("p")), repository.is_audio(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, False)]


def test_commands(spark, tmp_path):
    for arm in ("a", "b"):
        for seed, bump in ((0, 0.0), (1, 2.0)):
            base = tmp_path / f"res/{arm}/s/seed{seed}"
            write(base / "results.json", json.dumps({"in_distribution": {"en": {"wer": 10 + bump, "cer": 4 + bump, "n": 8, "n_empty_refs": 0}}, "transfer": {}}))
            write(base / "predictions/en.json", json.dumps({"pairs": [["a b c d", "a b c x" if arm == "a" else "q q q q"]] * 8}))
            write(base / "text_stats.json", json.dumps({"languages": {"en": {"word_boundary": True, "policy": "whisper-basic"}}}))
    root = ["--scale", "s", "--results-root", str(tmp_path / "res")]
    assert "| in_distribution | en | WER | 11.00 ± 1.41 | 5.00 ± 1.41 | 2 |" in main(["aggregate", "--arm", "a", *root], spark)
    assert json.loads(main(["aggregate", "--arm", "a", "--json", *root], spark))["macro"][0]["mean"] == 11.0
    text = main(["analyze", "--arm", "a", "--seed", "1", "--compare-to", "b", "--resamples", "200", "--tables-dir", str(tmp_path / "t"), *root], spark)
    assert "| in_distribution | en | WER | 25.00 | [25.00, 25.00] |" in text and "-75.00" in text and "seed0" not in text
    doc = json.loads((tmp_path / "t/s_wer.json").read_text())
    assert doc["intervals"][0]["is_primary"] and doc["comparisons"][0]["delta"] == -75.0 and "| a/s/seed1 |" in (tmp_path / "t/s_cer.md").read_text()
    write(tmp_path / "res/b/s/seed1/text_stats.json", json.dumps({"languages": {"en": {"policy": "norm-1"}}}))
    write(tmp_path / "res/b/s/seed1/predictions/en.json", "not read")
    with pytest.raises(ValueError, match="policies differ"):
        main(["analyze", "--arm", "a", "--seed", "1", "--compare-to", "b", *root], spark)
    (tmp_path / "res/b/s/seed1/text_stats.json").write_text("{}")
    with pytest.raises(ValueError, match="without recorded policies"):
        main(["analyze", "--arm", "a", "--seed", "1", "--compare-to", "b", *root], spark)
    cv = tmp_path / "cv/en"
    for name in ("train", "dev", "test"):
        write(cv / f"{name}.tsv", "client_id\tpath\tsentence\na\t1\thi\n")
    write(cv / "clip_durations.tsv", "clip\tduration[ms]\n1\t3600000\n")
    got = main(["data-stats", "--preset", write(tmp_path / "p.yaml", PRESET), "--corpora-root", str(tmp_path / "cv"), "--tables-dir", str(tmp_path / "t"), "--min-train-hours", "2"], spark)
    assert "| en | commonvoice | 3 | 0 | 3.0 | 1.0 | yes |  |" in got and "FileNotFoundError" in got
    assert (tmp_path / "t/data_durations.md").read_text() == got


WAV = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 32000 * 360)


def test_data_of_all_sources(spark, tmp_path):
    preset = "languages:\n  - { code: en, source: commonvoice, hf_config: en }\n  - { code: te, source: openslr, slr: 66, archives: [a.zip], index_files: [a.tsv] }\n  - { code: hr, source: manifest, corpus: parl, hf_config: hr }\n  - { code: xx, source: commonvoice, hf_config: xx }\n"
    head = "client_id\tpath\tsentence\n"
    cv = tmp_path / "c/en"
    write(cv / "train.tsv", head + "a\tv1\tx\n")
    write(cv / "dev.tsv", head + "d\tv4\tx\n")
    write(cv / "test.tsv", head + "t\tv6\tx\n")
    write(cv / "validated.tsv", head + "a\tv1\tx\na\tv3\tx\nd\tv4\tx\nd\tv5\tx\nt\tv6\tx\n")
    write(cv / "clip_durations.tsv", "clip\tduration[ms]\n" + "".join(f"v{k}\t3600000\n" for k in range(1, 7)))
    te = tmp_path / "c/te"
    write(te / "a.tsv", "".join(f"te_{s}_{k}\tsaid\n" for s in "abcdefghij" for k in range(2)))
    for s in "abcdefghi":
        (te / f"te_{s}_0.wav").write_bytes(WAV)
    write(tmp_path / "c/parl/hr.tsv", "utt_id\tpath\ttext\tspeaker\tsplit\n" + "".join(f"u{k}\taudio/u{k}.wav\tsaid\ts{k}\t{split}\n" for k, split in enumerate(("train", "train", "validation", "test"))))
    (tmp_path / "c/parl/audio").mkdir()
    (tmp_path / "c/parl/audio/u0.wav").write_bytes(WAV)
    where = ["--preset", write(tmp_path / "p.yaml", preset), "--corpora-root", str(tmp_path / "c")]
    got = main(["data-stats", *where, "--tables-dir", str(tmp_path / "t"), "--train-source", "validated_minus_eval"], spark)
    assert "| en | commonvoice | 4 | 0 | 4.0 | 2.0 |" in got and "| en | 5 | 2 | 1 | 1 | 1.0 |" in got
    assert "| te | openslr | 20 | 11 | 0.9 |" in got and "| hr | manifest | 4 | 3 | 0.1 | 0.1 |" in got and "FileNotFoundError" in got
    assert json.loads((tmp_path / "t/data_durations.json").read_text())["languages"][0]["guard"]["n_kept"] == 2
    report = main(["check-data", *where], spark)
    assert "| yes | en | commonvoice | 3 | train=1 validation=1 test=1 |" in report and "| no | xx |" in report and "| yes | te | openslr | 20 |" in report


def test_sweep_goes_on_when_a_read_fails(spark):
    def measure(code):
        df = spark.createDataFrame([("train", 1, 2.0, 0)], "split string, n_utts long, seconds double, n_missing long")
        return df if code == "a" else df.withColumn("seconds", F.raise_error(F.lit("broken file")).cast("double"))

    got = {r.lang: (r.n_utts, r.error) for r in durations.sweep(spark, ["a", "b"], measure).collect()}
    assert got["a"] == (1, None) and got["b"][0] is None and "broken file" in got["b"][1]


def test_documents(spark, tmp_path):
    stats = spark.createDataFrame([("en", "train", 3, 1, 0.5, 2, 0), ("en", "test", 1, 0, 0.0, 0, 1)], "lang string, split string, n_utts long, unk_chars long, unk_rate double, removed_P long, removed_S long")
    doc = sinks.text_stats_document(stats, [{"code": "en", "heldout": False, "word_boundary": True, "policy": "whisper-basic", "policy_hash": "h"}], {"q": 1}, {"en": {"z": 2}}, min_char_count=5)
    assert doc["languages"]["en"]["splits"]["train"] == {"n_utts": 3, "unk_chars": 1, "unk_rate": 0.5, "removed": {"P": 2}, "evicted_by_floor": {"z": 2}}
    assert doc["training_vocab_evicted"] == {"q": 1} and doc["min_char_count"] == 5 and doc["languages"]["en"]["splits"]["test"]["evicted_by_floor"] == {}
    sinks.write_json(doc, str(tmp_path / "seed0/text_stats.json"))
    rates = spark.createDataFrame([("in_distribution", "en", 10.0, 4.0, 3, 1)], "section string, lang string, wer double, cer double, n long, n_empty_refs long")
    sinks.write_json(sinks.results_document("a", "s", 0, rates, ["en"]), str(tmp_path / "a/s/seed0/results.json"))
    assert readers.run_results(spark, str(tmp_path), "a", "s").first().wer == 10.0
    pairs = spark.createDataFrame([("en", 0, "a b", "a c"), ("en", 1, " ", "x"), ("en", 2, "d", "d")], "lang string, pos int, ref string, hyp string")
    side = json.loads(sinks.sidecar_documents(pairs, ["lang"]).first().document)
    assert side["n"] == 2 and side["n_empty_refs"] == 1 and side["pairs"] == [["a b", "a c"], ["d", "d"]] and round(side["wer"], 6) == 33.333333
    assert sinks.fetch_document("c", "CC0", [{"name": "b", "url": "u", "bytes": 1}], "2024")["files"] == [{"name": "b", "url": "u", "bytes": 1, "sha256": None, "md5": None}]


def test_settings(spark, tmp_path, monkeypatch):
    defaults = {"root": "r", "text": {"override": None, "min_char_count": 1}}
    full = specs.resolved(defaults | {"text": {"override": "norm-1", "min_char_count": 5}}, [{"code": "en"}], "norm-1")
    assert full["text"]["policies"]["en"]["name"] == "norm-1"
    sinks.write_yaml(full, str(tmp_path / "resolved_config.yaml"))
    monkeypatch.setenv("CORPUS_ROOT", "/data")
    got = specs.settings(defaults, str(tmp_path / "resolved_config.yaml"), {"text": {"min_char_count": 2}}, {"CORPUS_ROOT": ("root",)})
    assert got == {"root": "r", "text": {"override": "norm-1", "min_char_count": 2}}
    assert specs.settings(defaults, None, None, {"CORPUS_ROOT": ("root",)})["root"] == "/data"
    for over, why in (({"text": {"q": 1}}, "unknown keys"), ({"text": {"override": "none"}}, "unknown policy")):
        with pytest.raises(ValueError, match=why):
            specs.settings(defaults, None, over)


def test_preset_block(spark):
    rows = spark.createDataFrame([("en", "commonvoice", "", 3.0, True), ("ja", "commonvoice", "", 5.0, True), ("hr", "manifest", "parl", 9.0, True), ("xx", "commonvoice", "", 1.0, False)], "locale string, source string, corpus string, trainable_hours double, included boolean")
    text = report.preset_block(rows, "cv-1", {"ja": False}, {"en": "whisper-basic", "hr": "latin-marks"})
    assert text == "# Without a policy so far:\n#   ja\nlanguages:\n  - { code: hr, source: manifest, corpus: parl, hf_config: hr, normalizer: latin-marks }\n  - { code: ja, source: commonvoice, hf_dataset: cv-1, hf_config: ja, text_column: sentence, word_boundary: false }\n  - { code: en, source: commonvoice, hf_dataset: cv-1, hf_config: en, text_column: sentence, normalizer: whisper-basic }\n"
