"""Running summaries of live sessions: activity, displayed color, statistics, and a summary when a session ends.

The rows of live(), with their gates, are a table in between; this is the second
query over it. A session's state has a bounded size: running sums, seconds of
each state, and a timeline whose older half is folded into one segment when it
grows beyond SEGMENTS.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lumenfold.operators import classify
from lumenfold.operators.intervals import COLORS, STATES
from lumenfold.plans import recording

from .color_state import Display
from .live import with_stored_state

SEGMENTS = 2048
ORDER = {"gap": 0, "frame": 1, "fast": 2, "stable": 3}
SUMMARY = (
    "session_id string, kind string, at double, state string, beta double, confidence string, seconds double, dominant string, reliable boolean, reliable_percent double, rejected_percent double, "
    "observations long, beta_mean double, beta_sd double, rmse_db_mean double, r2_mean double, flatness_mean double, durations string, timeline string, timeline_covers boolean, timeline_matches boolean"
)


def with_states(rows: DataFrame) -> DataFrame:
    """live()'s rows with state, confidence and reliable; frames get what their level says, "insufficient" if it says nothing."""
    gated = recording.gated(rows)
    own = classify.activity_state(F.col("samples"), F.col("non_finite"), F.col("dbfs"), recording.clipped(), F.lit(None).cast("string"))
    window = F.col("kind").isin("fast", "stable")
    kept = gated.withColumn("state", F.when(F.col("kind") == "frame", own).when(window, F.col("state")))
    return kept.withColumns({"confidence": F.when(window, F.col("confidence")), "reliable": window & F.col("reliable")}).drop("reasons")


@dataclass
class Running:
    """What is kept of a session."""

    seconds: float = 0.0
    durations: dict = field(default_factory=dict)
    timeline: list = field(default_factory=list)  # state, begins, ends, and of a folded one its seconds by state
    sums: dict = field(default_factory=lambda: dict.fromkeys(("n", "mean", "m2", "rmse_db", "r2", "flatness"), 0.0))
    latest: str | None = None
    display: Display = field(default_factory=Display)
    # of a stored session: closed segments that timeline doesn't hold, the place of the next one, how to read them, and whether they were read
    closed: int = 0
    place: int = 0
    read: Callable[[], list] | None = None
    loaded: bool = False

    @classmethod
    def of(cls, head: tuple, durations: dict, read: Callable[[], list]) -> Running:
        """A session from head(), its durations, and a function that reads its closed segments in order."""
        seconds, latest, sums, display, open_, closed, place = head
        names = ("n", "mean", "m2", "rmse_db", "r2", "flatness")
        return cls(seconds, durations, json.loads(open_), dict(zip(names, sums)), latest, Display(*display), closed, place, read)

    def head(self) -> tuple:
        """All of fixed size: what a batch rewrites."""
        d = self.display
        open_ = json.dumps(self.timeline[-1:])
        return self.seconds, self.latest, tuple(map(float, self.sums.values())), (d.state, d.smoothed, d.beta, d.pending, d.count, d.confidence), open_, self.closed + len(self.timeline[:-1]), self.place + len(self.timeline[:-1])

    def closing(self) -> dict[int, list]:
        """The segments that closed since the session was loaded, by their places."""
        return {self.place + i: segment for i, segment in enumerate(self.timeline[:-1])}

    def _load(self) -> None:
        if self.closed and self.read:
            self.timeline, self.closed, self.loaded = self.read() + self.timeline, 0, True

    def add(self, r) -> Iterator[dict]:
        if r.kind == "gap":  # what was heard before tells nothing of what comes
            self.latest, self.display = None, Display()
        elif r.kind == "frame":
            self._frame(r.state, r.ends - r.begins)
        elif r.kind == "fast":
            if r.state in ("silence", "tonal", "clipping"):
                self.display.block(r.state)
        else:
            self.latest = r.state
            beta = None if r.beta is None or not np.isfinite(r.beta) else float(r.beta)
            if r.reliable and beta is not None:
                s = self.sums
                s["n"] += 1
                step = beta - s["mean"]
                s["mean"] += step / s["n"]
                s["m2"] += step * (beta - s["mean"])
                for name in ("rmse_db", "r2", "flatness"):
                    s[name] += getattr(r, name) if np.isfinite(getattr(r, name)) else 0.0
            self.display.observe(r.state, beta, bool(r.reliable), r.confidence)
            yield dict(kind="display", at=r.ends, state=self.display.state, beta=self.display.beta, confidence=self.display.confidence, seconds=self.seconds)

    def _frame(self, own: str, seconds: float) -> None:
        state = own
        if own == "insufficient" and self.latest is not None:
            state = "mixed" if self.latest == "silence" else self.latest if self.latest in STATES else own
        begins, self.seconds = self.seconds, self.seconds + seconds
        self.durations[state] = self.durations.get(state, 0.0) + seconds
        if self.timeline and self.timeline[-1][0] == state:
            self.timeline[-1][2] = self.seconds
        else:
            self.timeline.append([state, begins, self.seconds, None])
        if self.closed + len(self.timeline) > SEGMENTS:
            self._load()
            old, self.timeline = self.timeline[: SEGMENTS // 2], self.timeline[SEGMENTS // 2 :]
            self.timeline.insert(0, ["session-compressed", old[0][1], old[-1][2], _seconds(old)])

    def summary(self) -> dict:
        """Reliable only with a dominant color and less than a fifth rejected."""
        self._load()
        colors = {c: self.durations.get(c, 0.0) for c in COLORS}
        good, whole = sum(colors.values()), max(self.seconds, np.finfo(float).eps)
        dominant = max(colors, key=colors.get) if good > 0 else None
        s = self.sums
        mean = lambda name: s[name] / s["n"] if s["n"] else None
        told = _seconds(self.timeline)
        rejected = 100 * (whole - good) / whole
        return dict(
            kind="summary", at=self.seconds, state=dominant if dominant and rejected < 20 else "mixed", seconds=self.seconds, dominant=dominant, reliable=dominant is not None and rejected < 20,
            reliable_percent=100 * good / whole, rejected_percent=rejected, observations=int(s["n"]), beta_mean=s["mean"] if s["n"] else None, beta_sd=float(np.sqrt(s["m2"] / s["n"])) if s["n"] else None,
            rmse_db_mean=mean("rmse_db"), r2_mean=mean("r2"), flatness_mean=mean("flatness"), durations=json.dumps(self.durations, sort_keys=True), timeline=json.dumps(self.timeline),
            timeline_covers=abs((self.timeline[-1][2] if self.timeline else 0.0) - self.seconds) < 1e-6, timeline_matches=all(abs(told.get(k, 0.0) - v) < 1e-6 for k, v in self.durations.items()),
        )


def _seconds(timeline: list) -> dict:
    out: dict = {}
    for state, begins, ends, folded in timeline:
        for k, v in (folded or {state: ends - begins}).items():
            out[k] = out.get(k, 0.0) + v
    return out


_NAMES = [f.strip().split(" ")[0] for f in SUMMARY.split(",")]


def _frame(session_id: str, rows: Iterable[dict]) -> pd.DataFrame:
    return pd.DataFrame([[session_id, *(r.get(n) for n in _NAMES[1:])] for r in rows], columns=_NAMES)


def _added(running: Running, frames: Iterable[pd.DataFrame]) -> Iterator[dict]:
    rows = pd.concat(list(frames))
    rows = rows.assign(_order=rows["kind"].map(ORDER)).sort_values(["ends", "_order"]).astype({"beta": object})
    for r in rows.itertuples():
        yield from running.add(r)


_READ = ["session_id", "kind", "begins", "ends", "state", "reliable", "confidence", "beta", "rmse_db", "r2", "flatness"]


class RunningSession(StatefulProcessor):
    """A session's state: sums, display and the open segment as one small value, seconds by state and closed segments by place as maps.

    A batch rewrites the small value, the seconds of the states it met, and adds
    the segments it closed; all segments are read only where the older half is
    folded, once in as many segments, and at the end.
    """

    HEAD = (
        "seconds double, latest string, sums struct<n: double, mean: double, m2: double, rmse_db: double, r2: double, flatness: double>, "
        "display struct<state: string, smoothed: double, beta: double, pending: string, count: int, confidence: string>, open string, closed int, place long"
    )

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.durations = handle.getMapState("durations", "state string", "seconds double")
        self.segments = handle.getMapState("segments", "place long", "segment string")

    def _running(self) -> Running:
        if not self.head.exists():
            return Running()
        segments = lambda: [json.loads(s) for _, s in sorted((k[0], v[0]) for k, v in self.segments.iterator())]
        return Running.of(self.head.get(), {k[0]: v[0] for k, v in self.durations.iterator()}, segments)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        running = self._running()
        before = dict(running.durations)
        rows = list(rows)
        out = list(_added(running, rows))
        for state, seconds in running.durations.items():
            if before.get(state) != seconds:
                self.durations.updateValue((state,), (seconds,))
        if running.loaded:
            self.segments.clear()
        for place, segment in running.closing().items():
            self.segments.updateValue((place,), (json.dumps(segment),))
        self.head.update(running.head())
        last = max(int(pd.Timestamp(r["ts"].max()).timestamp() * 1000) for r in rows)
        timers = list(self.handle.listTimers())
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max([last + self.idle_ms, *timers]))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(key[0], [self._running().summary()])
        self.head.clear()
        self.durations.clear()
        self.segments.clear()

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, late: str = "10 seconds", idle_ms: int = 120_000) -> DataFrame:
    """A stream of with_states() rows as a stream of displays, one for each stable window, and of summaries.

    A session without rows for idle_ms of event time ends: its summary comes out and its state goes.
    """
    with_stored_state(rows.sparkSession)
    marked = rows.select(*_READ, "ts").withWatermark("ts", late)
    return marked.groupBy("session_id").transformWithStateInPandas(RunningSession(idle_ms), SUMMARY, "Append", "EventTime")


def summarized(rows: DataFrame) -> DataFrame:
    """The same from rows that are all there, each session ended."""

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        running = Running()
        return _frame(key[0], [*_added(running, [frame]), running.summary()])

    return rows.select(*_READ).groupBy("session_id").applyInPandas(each, SUMMARY)
