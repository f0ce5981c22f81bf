"""The recording source and sink: byte ranges, pushed filters, commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.sources import recordings as R
from auralake.sources import wav


@pytest.fixture
def folder(tmp_path):
    """Three recordings, one of them below a folder, and what is none."""
    rng = np.random.default_rng(1)
    signals = {"a.mix": rng.uniform(-0.9, 0.9, (2, 1000)), "a.clean": rng.uniform(-0.9, 0.9, (2, 1000)), "sub/b": rng.uniform(-0.9, 0.9, (1, 37))}
    (tmp_path / "sub").mkdir()
    for name, x in signals.items():
        (tmp_path / f"{name}.wav").write_bytes(wav.encoded(x, 16000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVEjunk")
    (tmp_path / "_temporary-x").mkdir()
    (tmp_path / "_temporary-x" / "c.wav").write_bytes(wav.encoded(np.zeros((1, 5)), 16000))
    (tmp_path / "notes.txt").write_text("none")
    return tmp_path, {name: wav.decoded((tmp_path / f"{name}.wav").read_bytes())[1] for name in signals}


def whole(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start or 0)):
        if r.error is None:
            found.setdefault(r.path.removesuffix(".wav"), []).append(np.array(r.samples, dtype=np.float32))
    return {name: np.concatenate(parts, axis=1) for name, parts in found.items()}


@pytest.mark.parametrize("chunk,size", [(64, 1 << 20), (64, 300), (7, 11), (5000, 50)])
def test_byte_ranges_give_each_chunk_once(folder, chunk, size):
    path, signals = folder
    reader = R.Reader({"path": str(path), "chunkframes": str(chunk), "partitionbytes": str(size)})
    names = [c.split()[0] for c in R.SCHEMA.replace("array<array<float>>", "x").split(", ")]
    rows = [type("Row", (), dict(zip(names, r))) for p in reader.partitions() for r in reader.read(p)]
    assert all(r.frames <= chunk and r.start % chunk == 0 for r in rows if r.error is None)
    found = whole(rows)
    assert set(found) == set(signals) and all(np.array_equal(found[k], signals[k]) for k in signals)
    assert [(r.path, r.error is not None) for r in rows if r.path == "bad.wav"] == [("bad.wav", True)]


def test_a_ranged_read_reads_its_bytes_only(folder, monkeypatch):
    path, signals = folder
    read = {}

    class Counted:
        def __init__(self, system, name):
            self.file, self.name = system.open_input_file(name), os.path.basename(name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n):
            read[self.name] = read.get(self.name, 0) + n
            return self.file.read(n)

    class System:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def open_input_file(self, name):
            return Counted(self.system, name)

    real = R.opened
    monkeypatch.setattr(R, "opened", lambda uri: (System(real(uri)[0]), real(uri)[1]))
    reader = R.Reader({"path": str(path), "chunkframes": "10", "kind": '["mix"]', "from": "505", "to": "520"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[6] for r in rows] == [500, 510] and np.array_equal(np.array(rows[0][8], np.float32), signals["a.mix"][:, 500:510])
    assert read == {"a.mix.wav": 12 + 8 + 16 + 8 + 2 * 10 * 4}


def test_read_by_name_and_frames(spark, folder):
    path, signals = folder
    df = R.read_recordings(spark, str(path), chunk_frames=100, partition_bytes=700)
    assert {k: v.shape for k, v in whole(df.collect()).items()} == {k: v.shape for k, v in signals.items()}
    assert df.filter("item = 'a' and kind in ('mix', 'x') and start >= 300 and start < 500 and rate > 0").count() == 2
    assert R.read_recordings(spark, str(path), ["a"], ["mix", "x"], (300, 401), 100).count() == 2
    part = R.read_range(spark, str(path), 30, 75, chunk_frames=20)
    found = whole(part.withColumn("error", F.lit(None)).collect())
    assert set(found) == set(signals) and all(np.array_equal(found[k], signals[k][:, 30:105]) for k in signals)
    pairs = R.paired(df).collect()
    assert len(pairs) == 10 and all(np.array_equal(np.array(r["mix"], np.float32), signals["a.mix"][:, r["start"] : r["start"] + 100]) for r in pairs)


def chunks(spark, signals, n, rate=8000):
    rows = [(item, kind, rate, at, x[:, at : at + n].tolist()) for (item, kind), x in signals.items() for at in range(0, x.shape[1], n)]
    return spark.createDataFrame(rows, "item string, kind string, rate int, start long, samples array<array<double>>")


def test_written_recordings_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    signals = {("a", "mix"): rng.uniform(-1, 1, (2, 501)), ("a", ""): rng.uniform(-1, 1, (1, 3)), ("b", None): rng.uniform(-1, 1, (3, 64))}
    path = str(tmp_path / "out")
    R.write_recordings(chunks(spark, signals, 50).repartition(4), path)
    assert sorted(os.listdir(path)) == ["a.mix.wav", "a.wav", "b.wav"]
    for (item, kind), x in signals.items():
        rate, y = wav.decoded(open(f"{path}/{item}.{kind}.wav" if kind else f"{path}/{item}.wav", "rb").read())
        assert rate == 8000 and y.shape == x.shape and np.abs(x - y).max() <= 1 / 32768
    R.write_recordings(chunks(spark, {("b", None): np.zeros((1, 5))}, 2), path)
    assert R.read_recordings(spark, path).filter("item = 'b'").first()["total"] == 5
    R.write_recordings(chunks(spark, signals, 50).limit(0), path)
    assert sorted(os.listdir(path)) == ["a.mix.wav", "a.wav", "b.wav"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    good = chunks(spark, {(f"g{i}", "mix"): np.zeros((1, 10)) for i in range(8)}, 10)
    gap = chunks(spark, {("bad", "mix"): np.zeros((1, 30))}, 10).filter("start <> 10")
    with pytest.raises(Exception, match="does not follow"):
        R.write_recordings(good.union(gap), path)
    assert not os.path.exists(path) or os.listdir(path) == []
