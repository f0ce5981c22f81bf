"""Sources and sinks: results, manifests, signals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.sources import results as R
from auralake.sources import scans, wav


def test_results_keep_ids_and_refuse_repeats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("system,bucket,id,snr_in,clipped,pesq_wb\nckpt:/box/runs/m,b,007,5,True,\nraw,b,007,inf,0,nan\n")
    (tmp_path / "b.partial.csv").write_text("system,bucket,id\nraw,b,007\n")
    rows = {r.system: r for r in R.read_results(spark, [f"{tmp_path}/*.csv"]).collect()}
    assert set(rows) == {"ckpt:runs/m", "raw"}
    assert rows["raw"].id == "007" and rows["raw"].pesq_wb is None and rows["raw"].snr_in == float("inf")
    assert rows["ckpt:runs/m"].clipped and rows["ckpt:runs/m"].fault is None
    (tmp_path / "c.csv").write_text("system,bucket,id\nraw,b,007\n")
    with pytest.raises(R.Refused):
        R.read_results(spark, [f"{tmp_path}/*.csv"])
    with pytest.raises(R.Refused):
        R.read_results(spark, [])


def test_resume_passes_over_a_torn_line(spark, tmp_path):
    (tmp_path / "r.csv").write_text("bucket,id,x\nb,1,2\nb,2")
    work = spark.createDataFrame([("b", "1"), ("b", "2")], "bucket string, id string")
    assert [r.id for r in R.resume(work, spark, str(tmp_path), ["bucket", "id"], ["bucket", "id", "x"]).collect()] == ["2"]
    with pytest.raises(R.Refused):
        R.resume(work, spark, str(tmp_path), ["bucket", "id"], ["bucket", "id", "y"])


def test_results_go_by_their_own_headers(spark, tmp_path):
    """Files of one pattern may order their columns differently, lack some, and quote separators, quotes and line ends."""
    (tmp_path / "a.csv").write_text("system,bucket,id,snr_out,stoi,asr_text\nraw,b,1,12.5,0.8,\"hello, \"\"world\"\"\"\n")
    (tmp_path / "b.csv").write_text("stoi,snr_out,id,bucket,system\n0.7,11.5,2,b,raw\n")
    (tmp_path / "c.csv").write_text('asr_text,system,bucket,id,snr_out\n"two\nlines",raw,b,3,\n')
    (tmp_path / "d.csv").write_text("")
    rows = {r.id: r for r in R.read_results(spark, [f"{tmp_path}/*.csv"]).collect()}
    assert [(rows[k].snr_out, rows[k].stoi, rows[k].asr_text) for k in "123"] == [(12.5, 0.8, 'hello, "world"'), (11.5, 0.7, None), (None, None, "two\nlines")]
    (tmp_path / "e.csv").write_text("system,bucket,id,snr_out\nraw,b,4\n")
    with pytest.raises(R.Refused):
        R.read_results(spark, [f"{tmp_path}/*.csv"])


@pytest.mark.parametrize("end,left", [("\n", ["3"]), ("", ["2", "3"])])
def test_resume_reads_quoted_values(spark, tmp_path, end, left):
    (tmp_path / "r.csv").write_text('bucket,id,text\nb,1,"hello, ""world"""\nb,2,"whole\nrow"' + end)
    work = spark.createDataFrame([("b", k) for k in "123"], "bucket string, id string")
    assert sorted(r.id for r in R.resume(work, spark, str(tmp_path), ["bucket", "id"], ["bucket", "id", "text"]).collect()) == left


def test_manifest_round_trip(spark, tmp_path):
    row = ("s:1", "c", "speech", "g", "", "a\\b.wav", 1.0, "MIT", "train", "aaa", "")
    df = spark.createDataFrame([row, ("s:2", *row[1:])], "source_id string, corpus string, kind string, group_id string, speaker_id string, path string, duration_s double, licence string, split string, sha1 string, noise_class string")
    R.write_manifest(df, f"{tmp_path}/m")
    back = R.read_manifests(spark, f"{tmp_path}/m").collect()
    assert [(r.source_id, r.path) for r in back] == [("s:1", "a/b.wav")]
    assert R.is_manifest(df) and not R.is_manifest(spark.range(1))


def test_run_records_and_registry(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"history": [{"epoch": 0, "val": 0.5}, {"epoch": 1, "val": 0.6}]}))
    assert [(r.place, r.val) for r in R.read_runs(spark, str(tmp_path)).orderBy("place").collect()] == [(0, 0.5), (1, 0.6)]
    registry = R.flattened_registry(spark, {"a": {"access": "http", "dest": "x", "licence": "MIT", "files": ["u"]}, "b": {"access": "magic", "dest": "/x", "files": []}})
    assert {(r.key, r.rule) for r in R.registry_violations(registry, ["http"]).collect()} == {("b", r) for r in ("access", "licence", "files", "relative path")}


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    import struct

    x = np.random.default_rng(0).uniform(-0.9, 0.9, (2, 50))
    if bits == 16:
        data = wav.encoded(x, 16000)
    else:
        body = b"".join(int(v * (1 << (bits - 1))).to_bytes(bits // 8, "little", signed=True) for frame in x.T for v in frame)
        data = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 0, 2 * bits // 8, bits) + b"data" + struct.pack("<I", len(body)) + body
    (tmp_path / "x.wav").write_bytes(data)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    rows = {r.path.rpartition("/")[2]: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    assert rows["x.wav"].channels == 2 and np.allclose(rows["x.wav"].samples, x, atol=1e-4)
    assert rows["bad.wav"].error and rows["bad.wav"].samples is None


def test_sidecars_need_a_clean_signal(spark):
    files = spark.createDataFrame([(p,) for p in ("d/1.mix.wav", "d/1.clean.wav", "d/1.json", "d/2.mix.wav")], "path string")
    assert [(r.stem, r.meta) for r in wav.sidecars(files).collect()] == [("d/1", "d/1.json")]


def test_scans_group_and_stop(spark):
    files = spark.createDataFrame([(f"r/9/1/9-1-{i}.flac", 3600.0, "") for i in range(5)], "path string, duration_s double, sha1 string")
    rows = scans.scan(files, scans.speech_by_speaker("ls", "CC BY 4.0", 2.5)).collect()
    assert len(rows) == 3 and {(r.speaker_id, r.group_id) for r in rows} == {("9", "ls-9")}
    assert len({r.split for r in rows}) == 1


def test_scans_by_category_and_licence(spark):
    rows = [("dog", "stationary"), ("fireworks", "changing"), ("laughing", "changing"), (None, "changing")]
    files = spark.createDataFrame([(f"e/audio/{i}.wav", 5.0, "", c, f"s{i}", m) for i, (c, m) in enumerate(rows)], "path string, duration_s double, sha1 string, category string, src_file string, measured_class string")
    assert sorted((r.source_id, r.noise_class) for r in scans.scan(files, scans.SCANS["esc50"]()).collect()) == [("esc50:dog/0", "stationary"), ("esc50:fireworks/1", "impulsive")]
    by, zero = "http://creativecommons.org/licenses/by/3.0/", "http://creativecommons.org/publicdomain/zero/1.0/"
    rows = [("Crowd", by), ("Explosion", zero), ("Wind", by.replace("by", "by-nc")), ("Siren", "http://creativecommons.org/licenses/sampling+/1.0/"), ("Bark", by), ("Engine", None)]
    files = spark.createDataFrame([(f"f/{i}.wav", 5.0, "", c, u, "u", "changing") for i, (c, u) in enumerate(rows)], "path string, duration_s double, sha1 string, label string, file_licence string, uploader string, measured_class string")
    assert sorted((r.source_id, r.noise_class, r.licence) for r in scans.scan(files, scans.SCANS["fsd50k"]()).collect()) == [("fsd50k:Crowd/0", "changing", by), ("fsd50k:Explosion/1", "impulsive", zero)]


def test_first_label_is_the_clips_own_first(spark):
    rows = spark.createDataFrame([(["Bark", "Siren", "Explosion"],), (["Bark"],), (None,)], "labels array<string>")
    assert [r.x for r in rows.select(scans.first_label(F.col("labels"), scans.FSD50K_LABELS).alias("x")).collect()] == ["Siren", None, None]


def test_reserved_split_is_refused(spark):
    with pytest.raises(ValueError):
        scans.SCANS["wham"]("tt")
    files = spark.createDataFrame([(f"w/{s}/07_a{s}.wav", 5.0, "", "changing") for s in ("tr", "cv", "tt")], "path string, duration_s double, sha1 string, measured_class string")
    assert [(r.source_id, r.group_id) for r in scans.scan(files, scans.SCANS["wham"]()).collect()] == [("wham:tr:07_atr", "wham-07")]


def test_label_filter_and_pairs(spark):
    rows = spark.createDataFrame([("d/abcdefghijk_1.wav",), ("d/zzzzzzzzzzz_1.wav",)], "path string")
    labels = spark.createDataFrame([("abcdefghijk", ["/m/speech"])], "clip string, labels array<string>")
    assert [r.path for r in scans.without_labels(rows, labels, ["/m/speech"]).collect()] == ["d/zzzzzzzzzzz_1.wav"]
    measured = spark.createDataFrame([(1, 2, 1429.0), (2, 1, 1429.0), (1, 3, 400.0)], "a int, b int, null_hz double")
    assert [(r.a, r.b) for r in scans.microphone_pairs(measured, 0.1, 0.135).collect()] == [(1, 2)]


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"x")
    assert R.file_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"x").hexdigest()
    assert R.condition_summary(spark.createDataFrame([("present", 1.0, 0.9, 0.1, 0)], "condition string, snr_out double, stoi double, speech_loss double, fail int"), ["present"]).select(F.col("n")).first()["n"] == 1


def test_recordings_and_verdicts(spark):
    table = spark.createDataFrame([("1", "s", "hi", "engine", "t", "1"), ("1", "s", "hi", "rain", "t", "maybe"), ("", None, "hi", "quiet", "t", "0")], "id string, speaker string, language string, condition string, transcript string, has_clean string")
    assert sorted((r.key, r.rule) for r in R.recording_violations(table).collect()) == [("", "id"), ("", "speaker"), ("1", "condition"), ("1", "has_clean"), ("1", "repeated key")]
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", True)], "g string, ok boolean")
    assert {r.g: r.verdict for r in R.verdict(rows, ["g"], "ok").collect()} == {"a": "TBD", "b": "FAIL", "c": "PASS"}


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path, monkeypatch):
    """Of files of several headers, long, short and empty, in few tasks; lines are only counted up by hash."""
    for k in range(7):
        header = ["a,b", "b,a", "x"][k % 3]
        (tmp_path / f"{k}.csv").write_text("".join(f"{x}\n" for x in [header, *("zz,0" for _ in range(1000 * k))]))
    (tmp_path / "empty.csv").write_text("")
    plans, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    found = R.headers(spark, [f"{tmp_path}/*.csv"])
    assert {h: [f.rpartition("/")[2] for f in files] for h, files in found.items()} == {("a", "b"): ["0.csv", "3.csv", "6.csv"], ("b", "a"): ["1.csv", "4.csv"], ("x",): ["2.csv", "5.csv"]}
    assert plans and not any("SortAggregate" in p for p in plans)
