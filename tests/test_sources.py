"""Audio files, text tables and documents against bytes and texts made here."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import audio, store, text


def wav(values: np.ndarray, bits: int, channels: int, rate: int = 8000, code: int = 1, extra: bytes = b"") -> bytes:
    if bits == 24:
        data = b"".join(int(v).to_bytes(3, "little", signed=True) for v in values)
    else:
        data = values.astype({8: "u1", 16: "<i2", 32: "<f4" if code == 3 else "<i4"}[bits]).tobytes()
    align = channels * bits // 8
    form = b"fmt " + struct.pack("<IHHIIHH", 16, code, channels, rate, rate * align, align, bits)
    body = extra + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@pytest.mark.parametrize("bits,code,scale,offset", [(8, 1, 128, 128), (16, 1, 32768, 0), (24, 1, 2**23, 0), (32, 1, 2**31, 0), (32, 3, 1, 0)])
def test_wav(bits, code, scale, offset):
    values = np.array([-100, 0, 7, 100, 50, -50]) if code == 1 else np.array([-0.5, 0, 0.25, 1, 0.1, -0.1])
    rate, channels, got = audio.decode_wav(wav(values + offset, bits, 2, code=code, extra=b"LIST" + struct.pack("<I", 3) + b"odd" + b"\0"))
    want = values.astype(np.float32 if code == 3 else float).astype(float).reshape(-1, 2) / scale
    assert (rate, channels) == (8000.0, 2) and got.dtype == np.float32 and np.array_equal(got, (want[:, 0] / 2 + want[:, 1] / 2).astype(np.float32))


def test_wav_tail_and_errors():
    rate, _, got = audio.decode_wav(wav(np.arange(10_000) % 100, 16, 1), most_seconds=0.5)
    assert len(got) == 4000 and got[-1] == np.float32(99 / 32768)
    assert audio.decode_wav(b"RIFFxxxxAVI ") is None and audio.decode_wav(b"") is None
    for bad in (wav(np.zeros(4), 16, 9), wav(np.zeros(4), 16, 1, rate=3000), wav(np.zeros(4), 16, 1, code=7), wav(np.zeros(0), 16, 1), wav(np.zeros(4), 16, 1)[:30]):
        with pytest.raises(ValueError):
            audio.decode_wav(bad)


MP3 = b"\xff\xfb\x90\xc0" + bytes(413)  # 128 kbit/s, 44.1 kHz, one channel: 417 bytes


def adts(n: int) -> bytes:
    return bytes([0xFF, 0xF1, 0x50, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + bytes(n - 7)


def test_frames_are_found_again():
    kind, rate, channels, seconds = audio.layout(MP3 * 10)
    assert (kind, rate, channels) == ("mp3", 44100.0, 1) and seconds == pytest.approx(11520 / 44100)
    for data in (b"\0" + MP3 * 10, MP3 * 5 + b"abc" + MP3 * 5, b"ID3\4\0\0\0\0\0\x05hello" + MP3 * 3, MP3 * 9 + MP3[:300]):
        assert audio.layout(data)[0] == "mp3"
    assert audio.layout(MP3 * 2 + bytes(400)) is None and audio.layout(b"plain text, no audio") is None
    for data in (adts(300) * 4, b"\0\0" + adts(300) * 4, adts(200) * 3 + b"\xff" + adts(200) * 3):
        assert audio.layout(data)[:3] == ("aac", 44100.0, 2)


def test_other_layouts():
    assert audio.layout(b"OggS" + bytes(24) + b"OpusHead\x01\x02" + bytes(20)) == ("opus", 48000.0, 2, None)
    assert audio.layout(b"OggS" + bytes(24) + b"\x01vorbis" + bytes(4) + b"\x02" + struct.pack("<I", 44100) + bytes(9)) == ("vorbis", 44100.0, 2, None)
    info = (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big")
    assert audio.layout(b"fLaC" + bytes(14) + info + bytes(16)) == ("flac", 44100.0, 2, 2.0) and audio.layout(b"fLaC" + bytes(14) + info) is None
    box = bytes(4) + b"ftyp" + bytes(4) + bytes(4) + b"mp4a" + bytes(16) + struct.pack(">HHI", 2, 16, 0) + struct.pack(">I", 44100 << 16)
    assert audio.layout(box) == ("mp4", 44100.0, 2, None)
    assert audio.layout(box[:-1]) is None and audio.layout(box.replace(struct.pack(">I", 44100 << 16), bytes(4))) is None


def test_files(spark, tmp_path):
    for name, data in {"a.wav": wav(np.arange(8), 16, 1), "b.mp3": MP3 * 10, "c.txt": b"none", "d.wav": wav(np.zeros(4), 16, 9)}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.checked(audio.decoded(audio.files(spark, str(tmp_path)))).collect()}
    assert rows["a.wav"].problem is None and len(rows["a.wav"].samples) == 8 and rows["b.mp3"].problem is None
    assert rows["c.txt"].error and rows["d.wav"].error and rows["c.txt"].problem and rows["d.wav"].problem
    with pytest.raises(TypeError):
        audio.float_samples(spark.createDataFrame([([1, 2],)], "samples array<int>"))


def test_upload_limits(spark):
    """Each rule on its border."""
    rows = [(12 << 20, 44100.0, 2, 60.0), ((12 << 20) + 1, 44100.0, 2, 60.0), (1, 7349.0, 1, 1.0), (1, 7350.0, 1, 1.0), (1, 192000.0, 8, 1.0), (1, 44100.0, 9, 1.0), (1, 44100.0, 1, 0.0), (1, 44100.0, 1, 120.5), (1, 192000.0, 8, 60.0)]
    problem = audio.upload_problem(*(F.col(c) for c in "abcd"))
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b double, c int, d double").select(problem).collect()]
    assert got == [None, "file too large", "layout not verified", None, None, "layout not verified", "duration unknown", "too long", "needs too much memory"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\r\n"Smith, J","says ""hi"""\r\n\r\nab"c,d"e\nx,"two\nlines",more\n,\n', newline="")
    (tmp_path / "b.csv").write_text("other\n1\n")
    rows = [tuple(r) for r in text.read_csv(spark, str(tmp_path / "a.csv"), ["name", "note", "none"]).collect()]
    assert rows == [("Smith, J", 'says "hi"', ""), ("abc,de", "", ""), ("x", "two\nlines", "")]
    found = text.load_tables(spark, {"a": (str(tmp_path / "a.csv"), ["note"]), "b": (str(tmp_path / "b.csv"), ["other"])})
    assert found["a"].count() == 3 and found["b"].count() == 1
    with pytest.raises(ValueError):
        text.load_tables(spark, {"a": (str(tmp_path / "a.csv"), ["note"]), "b": (str(tmp_path / "b.csv"), ["missing"])})


def test_snapshots_hash_numbers_as_browsers_print_them(spark):
    numbers = {100.0: "100", 0.5: "0.5", -3.25: "-3.25", 0.00012: "0.00012", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 12345678.5: "12345678.5", 1e15: "1000000000000000", 0.0: "0", 1e21: "1e+21", 0.1: "0.1"}
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(text.json_number(F.col("x"))).collect()
    assert [r[0] for r in got] == list(numbers.values())

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return f"fnv1a32-{h:08x}"

    points = spark.createDataFrame([([(1000.0, 0.5), (100.0, -2.0), (-1.0, 3.0)],), ([],)], "p array<struct<frequency: double, db: double>>")
    assert [r[0] for r in points.select(text.snapshot(F.col("p"))).collect()] == [fnv('[{"frequency":100,"correctionDb":-2},{"frequency":1000,"correctionDb":0.5}]'), None]


def test_upserts_keep_the_latest(spark):
    schema = "id string, timestamp long, v int"
    stored = spark.createDataFrame([(f"r{i}", i, 0) for i in range(120)], schema)
    new = spark.createDataFrame([("r5", 500, 1), ("r5", 400, 2), ("r119", 1, 3), ("x", 50, 4)], schema)
    got = {r.id: (r.timestamp, r.v) for r in store.upserted(stored, new).collect()}
    assert len(got) == 100 and got["r5"] == (500, 1) and got["x"] == (50, 4) and "r119" not in got and "r0" not in got
    assert store.without(stored, new).count() == 118 and store.upserted(stored.limit(0), new).count() == 3


def test_compaction(spark):
    rows = spark.sql("select 1 as id, transform(sequence(0, 999), x -> named_struct('t', x, 'deviceId', 'secret')) as temporal_beta, array(1) as psd, named_struct('routeId', 'r', 'kept', double('nan')) as nested")
    slim = store.compacted(rows)
    r = slim.first()
    assert slim.columns == ["id", "temporal_beta", "nested", "compacted", "detail_arrays_stored"] and len(r.temporal_beta) == 600
    assert "secret" not in json.dumps(r.asDict(True)) and r.nested.asDict() == {"kept": None} and [x.t for x in r.temporal_beta][::599] == [0, 999]
