"""WAV files as a data source: spark.read.format("wav_frames") and spark.readStream.format("wav_frames").

A row is a frame: path, rate, channels, place (from 0, of the frames that are
kept) and x, its mono value. The driver only lists files. Splits are ranges of
bytes, many small files or a part of a large one; a task reads the heads of a
file's chunks, then those of its bytes that hold frames of the last mostSeconds.
A file beyond mostBytes is not opened. A file that can't be read, or that is
no WAV, is one row with error and without a frame; an empty folder gives no row.

Options: path, a file or folder (with those in it; names that begin with _ or .
are left out), on any file system that pyarrow opens by its address; mostBytes
and mostSeconds (the upload rules' values, if not set); splitBytes (32 MiB);
lag (seconds, 1), see WavStream.

A session registers it by register(spark).
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lumenfold.sources.audio import MIB, MOST_BYTES, MOST_SECONDS, wav_form

FORMAT, FIELDS = "wav_frames", "path string, rate double, channels int, place long, x float, error string"
KINDS = pa.schema([("path", pa.string()), ("rate", pa.float64()), ("channels", pa.int32()), ("place", pa.int64()), ("x", pa.float32()), ("error", pa.string())])
#: Frames of one Arrow batch.
BATCH = 1 << 16


@dataclass(frozen=True)
class Part:
    """The bytes begin to end of a file of length bytes."""

    path: str
    length: int
    begin: int
    end: int


class Split(InputPartition):
    def __init__(self, parts: list[Part]):
        super().__init__(parts)


class _Files:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("wav_frames needs a path")
        self.path = options["path"]
        self.most_bytes, self.split_bytes = int(options.get("mostBytes", MOST_BYTES)), int(options.get("splitBytes", 32 * MIB))
        self.most_seconds, self.lag = float(options.get("mostSeconds", MOST_SECONDS)), float(options.get("lag", 1.0))
        if self.split_bytes < 1 or self.most_bytes < 0 or not self.most_seconds > 0:
            raise ValueError("wav_frames: splitBytes and mostSeconds must be positive, mostBytes not negative")

    def listed(self) -> list[fs.FileInfo]:
        system, root = fs.FileSystem.from_uri(self.path)
        here = system.get_file_info(root)
        if here.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [here] if here.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda f: any(p[0] in "_." for p in f.path[len(root) :].split("/") if p)
        return sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path)

    def splits(self, found: list[fs.FileInfo]) -> list[Split]:
        """Splits of about split_bytes; a file beyond most_bytes counts as nothing, for it is not read."""
        out, parts, room = [], [], self.split_bytes
        for f in found:
            begin = 0
            while True:
                end = f.size if f.size > self.most_bytes else min(f.size, begin + room)
                parts.append(Part(f.path, f.size, begin, end))
                room -= 1 if f.size > self.most_bytes else max(1, end - begin)
                if room <= 0:
                    out, parts, room = [*out, Split(parts)], [], self.split_bytes
                begin = end
                if begin >= f.size:
                    break
        return [*out, Split(parts)] if parts else out

    def rows(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for part in split.value if split else []:  # of an empty folder Spark asks for one split, None
            if part.length > self.most_bytes:
                yield _failed(part, "too large")
                continue
            try:
                yield from self._frames(system, part)
            except (ValueError, OSError, struct.error) as e:
                # a file's error is told once, by its first part
                if part.begin == 0:
                    yield _failed(part, str(e))

    def _frames(self, system: fs.FileSystem, part: Part) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(part.path) as file:
            form = wav_form(lambda at, n: file.read_at(n, at), part.length)
            if form is None:
                raise ValueError("no WAV")
            skipped = form.frames - form.kept(self.most_seconds)
            # a frame is of the part in which its first byte lies
            first, last = (min(form.frames, max(skipped, -((form.begin - edge) // form.align))) for edge in (part.begin, part.end))
            for at in range(first, last, BATCH):
                n = min(BATCH, last - at)
                x = form.mono(file.read_at(n * form.align, form.begin + at * form.align))
                constants = (pa.repeat(pa.scalar(v, KINDS.field(k).type), n) for k, v in (("path", part.path), ("rate", float(form.rate)), ("channels", form.channels)))
                yield pa.RecordBatch.from_arrays([*constants, pa.array(np.arange(at - skipped, at - skipped + n)), pa.array(x), pa.nulls(n, pa.string())], schema=KINDS)


def _failed(part: Part, error: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"path": part.path, "error": error}], schema=KINDS)


class WavReader(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[Split]:
        return self.files.splits(self.files.listed())

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class WavStream(DataSourceStreamReader):
    """Files by the time of their last change.

    An offset is such a time, and a batch has the files changed after one and up
    to another, so that a batch that runs again finds the same files. Files are
    taken once lag seconds old, which is how late a file may appear with an
    earlier time; writers move whole files into the folder and leave them there.
    """

    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        ripe = time.time_ns() - int(self.files.lag * 1e9)
        return {"changed": max((f.mtime_ns for f in self.files.listed() if f.mtime_ns <= ripe), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.files.splits([f for f in self.files.listed() if start["changed"] < f.mtime_ns <= end["changed"]])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(_Files(self.options))

    def streamReader(self, schema: StructType) -> WavStream:
        return WavStream(_Files(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
