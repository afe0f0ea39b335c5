"""Audio files as tables: WAV samples, layouts of compressed files, upload rules."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

MIB = 1 << 20
MOST_BYTES, MOST_COMPRESSED, MOST_SECONDS, MOST_PEAK = 40 * MIB, 12 * MIB, 120.0, 128 * MIB


@dataclass(frozen=True)
class WavForm:
    """Where a WAV's frames lie and how they are written."""

    rate: int
    channels: int
    align: int
    kind: str | None
    scale: float
    begin: int
    frames: int

    def kept(self, most_seconds: float) -> int:
        """How many frames at the end are of the last most_seconds."""
        return min(self.frames, int(self.rate * most_seconds))

    def mono(self, raw: bytes) -> np.ndarray:
        """Whole frames as float32: channels are averaged in double precision and rounded once."""
        if self.kind is None:
            parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            values = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000
        else:
            values = np.frombuffer(raw, self.kind)
        values = values.astype(np.float64) - (128.0 if self.kind == "u1" else 0.0)
        return ((values / self.scale).reshape(-1, self.channels).sum(1) / self.channels).astype(np.float32)


def wav_form(read: Callable[[int, int], bytes], length: int) -> WavForm | None:
    """The form of a PCM or float WAV of length bytes, by read(place, bytes) of its chunks' heads alone; None if it is no WAV.

    Raises ValueError for a WAV that can't be read.
    """
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    form, body, at = None, None, 12
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt " and size >= 16 and at + 24 <= length:
            form = struct.unpack("<HHIIHH", read(at + 8, 16))
            if form[0] == 0xFFFE and size >= 26 and at + 34 <= length:
                form = (*struct.unpack("<H", read(at + 32, 2)), *form[1:])
        elif name == b"data":
            body = (at + 8, min(size, length - at - 8))
        at += 8 + size + (size & 1)
    if form is None or body is None:
        raise ValueError("a WAV without format or data")
    code, channels, rate, _, align, bits = form
    kinds = {(1, 8): ("u1", 128.0), (1, 16): ("<i2", 32768.0), (1, 24): (None, 2.0**23), (1, 32): ("<i4", 2.0**31), (3, 32): ("<f4", 1.0)}
    if (code, bits) not in kinds or not 1 <= channels <= 8 or not 4000 <= rate <= 384_000:
        raise ValueError("an encoding that is not supported")
    if align != channels * bits // 8 or body[1] < align:
        raise ValueError("frames that don't fit the format")
    return WavForm(rate, channels, align, *kinds[code, bits], body[0], body[1] // align)


def decode_wav(data: bytes, most_seconds: float = MOST_SECONDS) -> tuple[float, int, np.ndarray] | None:
    """Rate, channels and mono float32 samples of the last most_seconds of a WAV; None if it is no WAV.

    Raises ValueError for a WAV that can't be read.
    """
    form = wav_form(lambda at, n: data[at : at + n], len(data))
    if form is None:
        return None
    end = form.begin + form.frames * form.align
    return float(form.rate), form.channels, form.mono(data[end - form.kept(most_seconds) * form.align : end])


Frame = tuple[int, int, int, float]


def _walked(data: bytes, begin: int, header: int, frame: Callable[[bytes, int], Frame | None]) -> tuple[float, int, float] | None:
    """Highest rate, most channels and seconds of whole frames (size, rate, channels, seconds), if they are 80% of data from begin on.

    Bytes that begin no frame are stepped over to the next sync byte.
    """
    at, used, rate, channels, seconds = begin, 0, 0, 0, 0.0
    while 0 <= at and at + header <= len(data):
        found = frame(data, at)
        if found is None or at + found[0] > len(data):
            at = data.find(b"\xff", at + 1)
            continue
        at, used = at + found[0], used + found[0]
        rate, channels, seconds = max(rate, found[1]), max(channels, found[2]), seconds + found[3]
    return (float(rate), channels, seconds) if used and used >= 0.8 * max(1, len(data) - begin) else None


# fixed values: bit rates in kbit/s (MPEG 1 and 2, layer III) and sample rates in Hz by version
MP3_KBITS = {True: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], False: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
MP3_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
# fixed values: sample rates by index
ADTS_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def _mp3_frame(data: bytes, at: int) -> Frame | None:
    sync, code, mode = data[at : at + 2], data[at + 2], data[at + 3]
    version, layer, bit, sample = sync[1] >> 3 & 3, sync[1] >> 1 & 3, code >> 4, code >> 2 & 3
    if sync[0] != 0xFF or sync[1] & 0xE0 != 0xE0 or version == 1 or layer != 1 or bit in (0, 15) or sample == 3:
        return None
    rate, one = MP3_RATES[version][sample], version == 3
    size = (144 if one else 72) * MP3_KBITS[one][bit] * 1000 // rate + (code >> 1 & 1)
    return (size, rate, 1 if mode >> 6 == 3 else 2, (1152 if one else 576) / rate) if size >= 24 else None


def _adts_frame(data: bytes, at: int) -> Frame | None:
    b = data[at : at + 7]
    index, size, channels = b[2] >> 2 & 15, (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5, (b[2] & 1) << 2 | b[3] >> 6
    if b[0] != 0xFF or b[1] & 0xF6 != 0xF0 or index >= len(ADTS_RATES) or size < 7 or not channels:
        return None
    return size, ADTS_RATES[index], channels, 1024 * ((b[6] & 3) + 1) / ADTS_RATES[index]


def _mp3(data: bytes) -> tuple[str, float, int, float | None] | None:
    tagged = data[:3] == b"ID3" and len(data) >= 10
    begin = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0))) if tagged else 0
    found = _walked(data, begin, 4, _mp3_frame)
    return found and ("mp3", *found)


def _adts(data: bytes) -> tuple[str, float, int, float | None] | None:
    found = _walked(data, 0, 7, _adts_frame)
    return found and ("aac", *found)


def _ogg(data: bytes) -> tuple[str, float, int, float | None] | None:
    head = data[: 256 << 10]
    if (at := head.find(b"OpusHead")) >= 0 and at + 10 <= len(head):
        return "opus", 48000.0, head[at + 9], None
    if (at := head.find(b"\x01vorbis")) >= 0 and at + 16 <= len(head):
        return "vorbis", float(struct.unpack_from("<I", head, at + 12)[0]), head[at + 11], None
    return None


def _flac(data: bytes) -> tuple[str, float, int, float | None] | None:
    if len(data) < 42:
        return None
    bits = int.from_bytes(data[18:26], "big")
    rate, samples = bits >> 44, bits & (1 << 36) - 1
    return ("flac", float(rate), (bits >> 41 & 7) + 1, samples / rate if rate and samples else None) if rate else None


def _mp4(data: bytes) -> tuple[str, float, int, float | None] | None:
    at = data.find(b"mp4a")
    if at < 4 or at + 32 > len(data):
        return None
    rate, channels = struct.unpack_from(">I", data, at + 28)[0] >> 16, struct.unpack_from(">H", data, at + 20)[0]
    return ("mp4", float(rate), channels, None) if rate and channels else None


def layout(data: bytes) -> tuple[str, float, int, float | None] | None:
    """Container, highest rate, channels and seconds (if told) of a compressed file, by its first bytes."""
    if data[:4] == b"OggS":
        return _ogg(data)
    if data[:4] == b"fLaC":
        return _flac(data)
    if data[4:8] == b"ftyp":
        return _mp4(data)
    return _mp3(data) or _adts(data)


FILE_FIELDS = "path string, length long, kind string, rate double, channels int, seconds double, samples array<float>, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def decoded(binary: DataFrame) -> DataFrame:
    """path, kind, rate, channels, seconds, samples, error of rows (path, length, content).

    WAV files are decoded; of compressed ones only the layout is read, for which
    no codec is needed. A file beyond MOST_BYTES is not opened. Null content is
    an error of its row.
    """

    def read(path, length, content):
        row = dict(path=path, length=length, kind=None, rate=None, channels=None, seconds=None, samples=None, error=None)
        if content is None or (length or len(content)) > MOST_BYTES:
            return row | {"error": "no content" if content is None else "too large"}
        try:
            wav = decode_wav(content)
            if wav:
                return row | {"kind": "wav", "rate": wav[0], "channels": wav[1], "seconds": len(wav[2]) / wav[0], "samples": wav[2].tolist()}
            found = layout(content)
            return row | (dict(zip(("kind", "rate", "channels", "seconds"), found)) if found else {"error": "layout not recognised"})
        except (ValueError, struct.error) as e:
            return row | {"error": str(e)}

    kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns):  # a file at a time: they are large
                out = read(*(x.as_py() for x in row))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out.values(), kinds)], list(out))

    return binary.select("path", "length", "content").mapInArrow(run, FILE_FIELDS)


def decode_peak(encoded: Column, seconds: Column, rate: Column, channels: Column) -> Column:
    """Bytes that decoding may hold at once: the file, all channels, the mono mix and working room."""
    frames = F.ceil(seconds * rate)
    whole = frames * channels * 4
    return encoded + whole + frames * 4 + F.greatest(F.lit(8 * MIB), F.ceil(whole * 0.5))


def upload_problem(length: Column, rate: Column, channels: Column, seconds: Column) -> Column:
    """The first rule that a compressed file breaks, or null."""
    return (
        F.when(length > MOST_COMPRESSED, "file too large").when(rate.isNull() | ~rate.between(7350, 192_000) | ~channels.between(1, 8), "layout not verified")
        .when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf")), "duration unknown").when(seconds > MOST_SECONDS, "too long")
        .when(decode_peak(length, seconds, rate, channels) > MOST_PEAK, "needs too much memory")
    )


def checked(files: DataFrame) -> DataFrame:
    """decoded() files with problem: why a file must not be decoded, or null."""
    problem = F.when(F.col("length") > MOST_BYTES, "file too large").when(F.col("kind") != "wav", upload_problem(*(F.col(c) for c in ("length", "rate", "channels", "seconds"))))
    return files.withColumn("problem", F.coalesce(problem, F.col("error")))


def float_samples(rows: DataFrame, samples: str = "samples") -> DataFrame:
    """rows with samples as floats; TypeError for arrays of integers, which may be encoded audio. Values stay as they are."""
    kind = rows.schema[samples].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, (FloatType, DoubleType)):
        raise TypeError("samples must be arrays of float or double")
    return rows.withColumn(samples, F.col(samples).cast("array<float>"))


def bounded(samples: Column, rate: Column, seconds: float = MOST_SECONDS) -> Column:
    """struct(samples, source_seconds, begins, truncated): the tail that is analysed, and what of the source it is."""
    n = F.size(samples)
    keep = F.greatest(F.lit(1), F.floor(rate * seconds)).cast("int")
    return F.struct(tail(samples, rate, seconds).alias("samples"), (n / rate).alias("source_seconds"), (F.greatest(F.lit(0), n - keep) / rate).alias("begins"), (n > keep).alias("truncated"))


def mono(channels: Column) -> Column:
    """The mean of 1 to 8 channel arrays, added in double precision and rounded to float once."""
    n = F.size(channels)
    at = F.sequence(F.lit(0), F.array_min(F.transform(channels, lambda c: F.size(c))) - 1)
    mixed = F.transform(at, lambda i: (F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i).cast("double") / n)).cast("float"))
    return F.when(n.between(1, 8), F.when(F.array_min(F.transform(channels, lambda c: F.size(c))) > 0, mixed).otherwise(F.array().cast("array<float>")))


def tail(samples: Column, rate: Column, seconds: float = MOST_SECONDS) -> Column:
    """The last samples that fit in so many seconds."""
    keep = F.greatest(F.lit(1), F.floor(rate * seconds)).cast("int")
    return F.when(F.size(samples) <= keep, samples).otherwise(F.slice(samples, -keep, keep))
