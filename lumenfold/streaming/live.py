"""Live sessions: packets in, half-second activity frames and window results out, with state for each session."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lumenfold.functions import spectra
from lumenfold.plans import recording

PACKET = "session_id string, seq long, start_sample long, rate double, samples array<float>, ts timestamp"
OUTPUT = "session_id string, kind string, begins double, ends double, samples long, ts timestamp, " + recording.MEASURES
FRAME_SECONDS, BUFFER_SECONDS = 0.5, 30.0

# Seconds of the fast and the stable window, and of their cadences.
MODES = {"instant": (1.5, 3.0, 0.25, 0.5), "balanced": (2.0, 8.0, 0.5, 1.0), "stable": (3.0, 12.0, 0.75, 1.5)}


@dataclass
class Session:
    """What is kept of a session: the last samples in the chunks they came in, and positions in samples.

    A missing stretch (start_sample beyond what came) is a gap, not silence:
    windows never reach across it and the unfinished frame before it ends early.
    pending counts the last samples, which no frame has yet.
    """

    mode: str = "balanced"
    rate: float = 0.0
    position: int = 0
    seq: int = -1
    pending: int = 0
    due: dict = field(default_factory=lambda: {"fast": 0.0, "stable": 0.0})
    chunks: dict[int, np.ndarray] = field(default_factory=dict)  # by their first sample, in order
    seen: pd.Timestamp | None = None

    def add(self, seq: int, start: int, rate: float, samples: np.ndarray) -> Iterator[tuple]:
        """Rows (kind, begins, ends, samples, measures) that the packet completes; a repeated packet none.

        At most one window comes with a packet: the stable one if it is due and
        enough is there, else the fast one, which needs 1.5 seconds and takes
        what there is up to its length. What is passed over stays due.
        """
        if seq <= self.seq or not rate or len(samples) == 0:
            return
        if self.rate and (rate != self.rate or start != self.position):
            yield from self.finish()
            yield self._row("gap", self.position / self.rate, max(start / rate, self.position / self.rate), np.zeros(0))
            self.chunks, self.due = {}, {"fast": 0.0, "stable": 0.0}
        if self.seq < 0 or start != self.position or rate != self.rate:
            self.position = start
        self.chunks[self.position] = samples
        self.seq, self.rate, self.position, self.pending = seq, rate, self.position + len(samples), self.pending + len(samples)
        frame = max(1, int(spectra.half_up(FRAME_SECONDS * rate)))
        while self.pending >= frame:
            begin = self.position - self.pending
            yield self._row("frame", begin / rate, (begin + frame) / rate, self.latest(self.pending)[:frame])
            self.pending -= frame
        self._forget(max(frame, int(BUFFER_SECONDS * rate)))
        fast, stable, fast_every, stable_every = MODES[self.mode]
        now, there = self.position / rate, (self.position - next(iter(self.chunks))) / rate
        for kind, least, seconds, every in (("stable", stable, stable, stable_every), ("fast", min(1.5, fast), fast, fast_every)):
            if there >= least and now >= self.due[kind]:
                self.due[kind] = now + every
                x = self.latest(int(min(there, seconds) * rate))
                yield self._row(kind, now - len(x) / rate, now, x, 48 if kind == "stable" else 24)
                break

    def latest(self, n: int) -> np.ndarray:
        """The last n samples, or all there are."""
        parts, there = [], 0
        for chunk in reversed(self.chunks.values()):
            if there >= n:
                break
            parts.append(chunk)
            there += len(chunk)
        return np.concatenate(parts[::-1])[-n:] if n and parts else np.zeros(0, np.float32)

    def _forget(self, most: int) -> None:
        """Drops whole chunks that lie before the last `most` samples."""
        for start in list(self.chunks):
            if start + len(self.chunks[start]) > self.position - most:
                break
            del self.chunks[start]

    def finish(self) -> Iterator[tuple]:
        """The unfinished frame, as it is."""
        if self.pending:
            yield self._row("frame", (self.position - self.pending) / self.rate, self.position / self.rate, self.latest(self.pending))
            self.pending = 0

    def _row(self, kind: str, begins: float, ends: float, samples: np.ndarray, budget: int = 0) -> tuple:
        measured = {} if kind == "gap" else recording.measure(samples, self.rate, budget=budget) if budget else recording.levels(samples, self.rate)
        return kind, begins, ends, len(samples), measured


_NAMES = [f.strip().split(" ")[0] for f in OUTPUT.split(",")]


def _rows(session_id: str, found: Iterable[tuple]) -> pd.DataFrame:
    """found: (ts, (kind, begins, ends, samples, measures))."""
    return pd.DataFrame([(session_id, *r[:4], ts, *(r[4].get(n) for n in _NAMES[6:])) for ts, r in found], columns=_NAMES)


def _in_order(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """ts and the arguments of Session.add."""
    rows = pd.concat(list(frames))
    for r in rows.sort_values(["seq", "start_sample"]).itertuples():
        yield r.ts, (int(r.seq), int(r.start_sample), float(r.rate), np.asarray(r.samples, np.float32))


class LiveSession(StatefulProcessor):
    """A session's state: its positions as one small value, its samples as a map from a chunk's first sample to the chunk.

    A packet writes its own chunk and the positions, and removes the chunks that
    have left the buffer; the others stay as they are, whatever the buffer holds.
    A timer at the last packet's time and idle_ms ends the session.
    """

    HEAD = "rate double, position long, seq long, pending long, fast double, stable double, seen timestamp"

    def __init__(self, mode: str, idle_ms: int):
        self.mode, self.idle_ms = mode, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.chunks = handle.getMapState("chunks", "start long", "samples binary")

    def _session(self) -> Session:
        if not self.head.exists():
            return Session(self.mode)
        rate, position, seq, pending, fast, stable, seen = self.head.get()
        held = sorted((k[0], v[0]) for k, v in self.chunks.iterator())
        return Session(self.mode, rate, position, seq, pending, {"fast": fast, "stable": stable}, {k: np.frombuffer(v, np.float32) for k, v in held}, seen)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        session, out = self._session(), []
        before = set(session.chunks)
        for session.seen, packet in _in_order(rows):
            out += [(session.seen, r) for r in session.add(*packet)]
        for start in before - set(session.chunks):
            self.chunks.removeKey((start,))
        for start in set(session.chunks) - before:
            self.chunks.updateValue((start,), (session.chunks[start].tobytes(),))
        seen = pd.Timestamp(session.seen).to_pydatetime()
        self.head.update((session.rate, session.position, session.seq, session.pending, session.due["fast"], session.due["stable"], seen))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(seen).timestamp() * 1000) + self.idle_ms)
        yield _rows(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self._session()
        yield _rows(key[0], ((session.seen, r) for r in session.finish()))
        self.head.clear()
        self.chunks.clear()

    def close(self) -> None:
        pass


def with_stored_state(spark: SparkSession) -> None:
    """Has the session keep streaming state in a store that holds single entries, as transformWithState needs; a choice of the session's own stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live(packets: DataFrame, mode: str = "balanced", late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """A stream of packets (see PACKET) as a stream of frames, gaps and window results.

    One session's packets of a micro-batch are put in order of seq; those that
    came before are dropped as repeats. A session without packets for idle_ms of
    event time ends: its unfinished frame comes out and its state goes. A packet
    beyond the watermark is late and dropped by Spark.
    """
    with_stored_state(packets.sparkSession)
    marked = packets.withWatermark("ts", late)
    return marked.groupBy("session_id").transformWithStateInPandas(LiveSession(mode, idle_ms), OUTPUT, "Append", "EventTime")


def replayed(packets: DataFrame, mode: str = "balanced") -> DataFrame:
    """The same results from packets that are all there, each session ended."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        session, out = Session(mode), []
        for session.seen, packet in _in_order([frame]):
            out += [(session.seen, r) for r in session.add(*packet)]
        return _rows(key[0], [*out, *((session.seen, r) for r in session.finish())])

    return packets.groupBy("session_id").applyInPandas(each, OUTPUT)


def packets(samples: DataFrame, key: str, size: int, began: float = 0.0) -> DataFrame:
    """Samples as rows (key, n from 0, x, rate) as packets of size samples (see PACKET), the first at began in seconds of Unix time."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda p: p["x"].cast("float"))
    grouped = samples.groupBy(F.col(key).cast("string").alias("session_id"), F.floor(F.col("n") / size).alias("seq")).agg(F.max("rate").cast("double").alias("rate"), x.alias("samples"))
    start = F.col("seq") * size
    return grouped.select("session_id", "seq", start.alias("start_sample"), "rate", "samples", F.timestamp_seconds(F.lit(float(began)) + start / F.col("rate")).alias("ts"))


def gaps(packets: DataFrame) -> DataFrame:
    """session_id, sample_offset, resume_sample_offset, gap_seconds of breaks in the sample count."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("seq")
    ends = F.lag(F.col("start_sample") + F.size("samples")).over(w)
    return packets.withColumn("_end", ends).where("_end < start_sample").select(
        "session_id", F.col("_end").alias("sample_offset"), F.col("start_sample").alias("resume_sample_offset"), ((F.col("start_sample") - F.col("_end")) / F.col("rate")).alias("gap_seconds")
    )


def event_windows(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by event_type in tumbling or sliding windows of ts; a stream closes them by its watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n", "total")
