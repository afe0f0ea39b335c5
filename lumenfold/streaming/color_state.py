"""The displayed color: smoothed exponent, hysteresis and confirmation, as a fold over observations in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lumenfold.functions.scalars import finite
from lumenfold.operators import buckets
from lumenfold.operators.intervals import COLORS
from lumenfold.operators.spectral import CANONICAL

SHOWN = "shown_state string, smoothed double, shown_beta double, pending string, pending_count int, confidence string"


@dataclass
class Display:
    """The displayed color: a smoothed exponent, hysteresis, and `required` observations in a row to change it."""

    state: str = "listening"
    smoothed: float | None = None
    beta: float | None = None
    pending: str | None = None
    count: int = 0
    confidence: str = "None"

    def block(self, state: str | None) -> None:
        self.__init__("mixed" if state is None or state in COLORS else state)

    def observe(self, state: str, beta: float | None, reliable: bool, confidence: str | None, alpha: float = 0.28, hysteresis: float = 0.12, required: int = 2) -> None:
        colors = dict(CANONICAL)
        if not reliable or beta is None or not np.isfinite(beta) or state not in colors:
            return self.block(state)
        self.smoothed = beta if self.smoothed is None else alpha * beta + (1 - alpha) * self.smoothed
        away = {c: abs(self.smoothed - b) for c, b in colors.items()}
        proposed = min(away, key=away.get)
        if self.state in colors and away[proposed] + hysteresis >= away[self.state]:
            proposed = self.state
        waiting = False
        if proposed != self.state:
            self.count = self.count + 1 if self.pending == proposed else 1
            waiting = self.count < required
            self.state = self.state if waiting else proposed
        self.pending, self.count = (proposed, self.count) if waiting else (None, 0)
        self.beta = self.beta if waiting else self.smoothed
        known = self.state in colors and self.beta is not None
        self.confidence = "None" if not known else "Provisional" if waiting or state != self.state else confidence or "None"


def color_states(observations: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float = 0.28, hysteresis: float = 0.12, required: int = 2, width: float | None = None) -> DataFrame:
    """Per key the displayed state after each of its observations (beta, state, reliable, confidence) in order.

    Unreliable observations show their own state and forget the rest. A color
    gives way only if another one is nearer to the smoothed exponent by more
    than hysteresis, in `required` observations in a row.

    As an unreliable observation forgets what was before it, the fold starts
    anew there: a key falls into stretches from one such observation to the
    next, found by a scan over buckets of width seconds of order's first column
    (measured, if not given), and stretches spread over tasks. Within a task
    they are sorted and folded one row after the other; the state that passes
    from batch to batch is one small object. A null or infinite time is left out.
    """
    keys, order = list(keys), list(order)
    rows = observations.select(*keys, *order, "beta", "state", "reliable", "confidence").where(finite(F.col(order[0])).isNotNull())
    usable = F.coalesce(F.col("reliable"), F.lit(False)) & finite(F.col("beta")).isNotNull() & F.coalesce(F.col("state").isin(COLORS), F.lit(False))
    marked = buckets.latest(rows, keys, order[0], buckets.width(rows, order[0]) if width is None else width, order, ~usable)
    dealt = marked.repartition(*keys, "_since").sortWithinPartitions(*keys, "_since", *order)
    out = StructType([*rows.select(*keys, *order, "beta").schema, *_parse_datatype_string(SHOWN)])
    arrow, kept = to_arrow_schema(out), len(keys) + len(order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, shown = None, Display()
        for b in batches:
            cells = [b.column(i).to_pylist() for i in (*range(len(keys)), *range(kept, b.num_columns))]
            found: list[tuple] = []
            for *key, beta, state, reliable, confidence, since in zip(*cells):
                if (key, since) != stretch:
                    stretch, shown = (key, since), Display()
                shown.observe(state, beta, bool(reliable), confidence, alpha, hysteresis, required)
                found.append((shown.state, shown.smoothed, shown.beta, shown.pending, shown.count, shown.confidence))
            columns = zip(*found) if found else [()] * 6
            made = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[kept + 1 :])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept + 1)), *made], arrow.names)

    return dealt.select(*keys, *order, "beta", "state", "reliable", "confidence", "_since").mapInArrow(fold, out)
