"""WAV files as a data source against the decoder of whole files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import audio, wav_files

from .test_sources import wav


@pytest.fixture
def folder(spark, tmp_path):
    wav_files.register(spark)
    rng = np.random.default_rng(5)
    for name, seconds, bits, channels in (("a", 3, 16, 2), ("b", 0.5, 24, 1), ("c", 9, 8, 3)):
        values = rng.integers(0, 200, int(8000 * seconds) * channels) - (0 if bits == 8 else 100)
        (tmp_path / f"{name}.wav").write_bytes(wav(values, bits, channels, extra=b"LIST\3\0\0\0odd\0"))
    return tmp_path


def read(spark, folder, **options):
    return spark.read.format("wav_frames").options(**options).load(str(folder))


@pytest.mark.parametrize("split", [1_001, 30_000, 1 << 25])
@pytest.mark.parametrize("most", [0.7, 120.0])
def test_frames_equal_whole_files(spark, folder, split, most):
    rows = read(spark, folder, splitBytes=split, mostSeconds=most)
    got = {}
    for r in rows.orderBy("path", "place").collect():
        got.setdefault(os.path.basename(r.path), []).append(r)
    for file in folder.iterdir():
        rate, channels, want = audio.decode_wav(file.read_bytes(), most)
        mine = got.pop(file.name)
        assert [r.place for r in mine] == list(range(len(want))) and {(r.rate, r.channels, r.error) for r in mine} == {(rate, channels, None)}
        assert np.array_equal(np.array([r.x for r in mine], np.float32), want)
    assert not got


def test_parts_spread_and_small_files_share(spark, folder):
    assert read(spark, folder, splitBytes=20_000).rdd.getNumPartitions() > 10
    assert read(spark, folder).rdd.getNumPartitions() == 1


def test_what_is_not_read(spark, folder, monkeypatch):
    """Long files are not opened, nor hidden ones listed; what can't be read is one row."""
    (folder / "_hidden.wav").write_bytes(b"x")
    (folder / ".x").mkdir()
    (folder / ".x" / "y.wav").write_bytes(b"x")
    (folder / "deep").mkdir()
    (folder / "deep" / "text.txt").write_bytes(b"not a wav at all, and longer than a head")
    (folder / "empty.wav").write_bytes(b"")
    (folder / "cut.wav").write_bytes((folder / "a.wav").read_bytes()[:30])
    os.truncate(folder / "c.wav", 60_000)
    (folder / "c.wav").chmod(0)
    rows = read(spark, folder, mostBytes=50_000, splitBytes=20).where("error is not null").select(F.substring_index("path", "/", -1).alias("name"), "error", "x").collect()
    assert sorted((r.name, r.error) for r in rows) == [("a.wav", "too large"), ("c.wav", "too large"), ("cut.wav", "a WAV without format or data"), ("empty.wav", "no WAV"), ("text.txt", "no WAV")]
    assert all(r.x is None for r in rows)


def test_columns_and_options(spark, folder, tmp_path):
    assert read(spark, folder / "b.wav").select("x").count() == 4000
    (tmp_path / "nothing").mkdir()
    assert read(spark, tmp_path / "nothing").isEmpty()
    for bad in (dict(splitBytes=0), dict(mostSeconds=0)):
        with pytest.raises(Exception, match="must be positive"):
            read(spark, folder, **bad).collect()
    with pytest.raises(Exception, match="nowhere"):
        read(spark, folder / "nowhere").collect()


def test_reads_only_heads_and_the_tail(folder):
    """Of a long file no byte before the last seconds is read but the chunks' heads."""
    files = wav_files._Files({"path": str(folder), "mostSeconds": "0.5", "splitBytes": "10000"})
    read = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            read.append((at, n))
            return self.file.read_at(n, at)

    class System:
        def open_input_file(self, path):
            return Counting(wav_files.fs.LocalFileSystem().open_input_file(path))

    part = wav_files.Part(str(folder / "c.wav"), (folder / "c.wav").stat().st_size, 0, (folder / "c.wav").stat().st_size)
    frames = sum(b.num_rows for b in files._frames(System(), part))
    assert frames == 4000 and sum(n for _, n in read) < 4000 * 3 + 100


def test_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        rows = spark.readStream.format("wav_frames").option("lag", 0).load(str(folder)).groupBy("path").count()
        query = rows.writeStream.outputMode("update").foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{out}/rows/n={n}"))
        query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r.path), r["count"]) for r in spark.read.parquet(f"{out}/rows").collect())

    first = [("a.wav", 24_000), ("b.wav", 4_000), ("c.wav", 72_000)]
    assert run() == first
    assert run() == first
    (folder / "d.wav").write_bytes(wav(np.zeros(100), 16, 1))
    assert run() == [*first, ("d.wav", 100)]
