"""Recordings read from files that the test writes, against a plain read of the same files."""

import struct
import wave

import numpy as np
import pytest

from lexspan.operators.spans import frame_energy
from lexspan.sources.kaldi import fill_open_ends
from lexspan.sources.waves import recording_lengths, register, signal


def written(path, samples, rate=8000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.astype(f"<i{width}").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("waves")
    (root / "deep").mkdir()
    rng = np.random.default_rng(3)
    truth = {}
    for name, n, channels, width in (("a.wav", 50_001, 1, 2), ("deep/b.WAV", 7_000, 2, 2), ("c.wav", 0, 1, 2), ("d.wav", 901, 1, 4)):
        x = rng.integers(-20_000, 20_000, n * channels) * (1 if width == 2 else 65536)
        written(root / name, x, channels=channels, width=width)
        truth[str(root / name)] = x.reshape(-1, channels).mean(axis=1) / (32768.0 if width == 2 else 2147483648.0)
    (root / "bad.wav").write_bytes(b"not a recording at all")
    (root / "empty.wav").write_bytes(b"")
    (root / "none.wav").write_bytes(b"RIFF\x04\0\0\0WAVE")
    (root / "notes.txt").write_text("no recording")
    # a stream: the size of its samples was never written
    head = b"RIFF\xff\xff\xff\xffWAVELIST\x03\0\0\0abc\0fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data\xff\xff\xff\xff"
    x = rng.integers(-9, 9, 333)
    (root / "stream.wav").write_bytes(head + x.astype("<i2").tobytes() + b"\x01")
    truth[str(root / "stream.wav")] = x / 32768.0
    return root, truth


def test_headers(spark, folder):
    register(spark)
    root, truth = folder
    rows = {r.path: r for r in spark.read.format("wav_headers").load(str(root)).collect()}
    assert {p: r.frames for p, r in rows.items() if r.problem is None} == {p: len(x) for p, x in truth.items()}
    assert {p.rsplit("/", 1)[1] for p, r in rows.items() if r.problem} == {"bad.wav", "empty.wav", "none.wav"}
    assert {r.samplerate for p, r in rows.items() if p.endswith("stream.wav")} == {16000}


@pytest.mark.parametrize("block,per_task", [(1 << 20, 32), (1000, 3), (7, 500)])
def test_blocks_hold_every_sample_once(spark, folder, block, per_task):
    register(spark)
    root, truth = folder
    df = spark.read.format("wav_blocks").option("block_bytes", block).option("blocks_per_task", per_task).load(str(root))
    got = {p: np.zeros(0) for p, x in truth.items()}
    for r in sorted(df.collect(), key=lambda r: r.first):
        assert len(got[r.path]) == r.first
        got[r.path] = np.concatenate([got[r.path], r.samples])
    assert all(np.array_equal(got[p], x) for p, x in truth.items())


def test_one_file_in_several_partitions(spark, folder):
    register(spark)
    root, truth = folder
    path = str(root / "a.wav")
    df = spark.read.format("wav_blocks").option("block_bytes", 4000).option("blocks_per_task", 5).load(path)
    assert df.rdd.getNumPartitions() > 4
    got = {r.frame: r.rms for r in frame_energy(signal(df), 240).collect()}
    whole = truth[path][: len(truth[path]) // 240 * 240].reshape(-1, 240)
    assert got == pytest.approx(dict(enumerate(np.sqrt((whole**2).mean(axis=1) + 1e-12))), rel=1e-9)


def test_open_ends_from_files(spark, folder):
    register(spark)
    root, _ = folder
    recordings = spark.createDataFrame([("r1", str(root / "a.wav")), ("r2", str(root / "bad.wav"))], "rec string, path string")
    lengths = recording_lengths(spark.read.format("wav_headers").load(str(root)), recordings)
    segments = spark.createDataFrame([("u1", "r1", 0.0, None), ("u2", "r1", 1.0, 2.0), ("u3", "r2", 0.0, None)], "utt string, rec string, start double, end double")
    assert {r.utt: r.end for r in fill_open_ends(segments, lengths).collect()} == {"u1": 50_001 / 8000, "u2": 2.0, "u3": None}


def test_missing_path(spark, folder):
    register(spark)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("wav_headers").load(str(folder[0] / "nowhere")).collect()
