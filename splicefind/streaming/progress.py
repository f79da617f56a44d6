"""Stateful stream operators: progress debouncing, change scores and sessions.

State per key is one frame, so it stays small however long a stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "task_id string, ts double, stage string, percent double"


def debounced(frames: DataFrame, quiet: float = 0.5) -> DataFrame:
    """Frames (task_id, ts, stage, percent) to publish: the first, a new stage, the end, or after ``quiet`` seconds.

    A held frame is emitted before the one that is due.
    """
    state = "last double, stage string, held_ts double, held_stage string, held_percent double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        last, stage, *held = s.get if s.exists else (None, None, None, None, None)
        held = None if held[0] is None else tuple(held)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows.itertuples():
            if last is None or r.percent >= 100 or r.stage != stage or r.ts - last >= quiet:
                out += [held] if held else []
                out.append((r.ts, r.stage, r.percent))
                held, last, stage = None, r.ts, r.stage
            else:
                held = (r.ts, r.stage, r.percent)
        s.update((last, stage, *(held or (None, None, None))))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["task_id", "ts", "stage", "percent"])

    return frames.select("task_id", "ts", "stage", "percent").groupBy("task_id").applyInPandasWithState(step, FRAME, state, "append", GroupStateTimeout.NoTimeout)


def change_scores(frames: DataFrame) -> DataFrame:
    """Frames (source_id, t, hist, gray) -> (source_id, t, score): half the L1 of histograms plus half the mean change of pixels."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        hist, gray = s.get if s.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("t", kind="stable").itertuples():
            if hist is not None:
                l1 = sum(abs(a - b) for a, b in zip(hist, r.hist))
                mad = sum(abs(a - b) for a, b in zip(gray, r.gray)) / max(len(r.gray), 1) / 255
                out.append((key[0], r.t, 0.5 * l1 + 0.5 * mad))
            hist, gray = [float(x) for x in r.hist], [float(x) for x in r.gray]
        s.update((hist, gray))
        yield pd.DataFrame(out, columns=["source_id", "t", "score"])

    return frames.select("source_id", "t", "hist", "gray").groupBy("source_id").applyInPandasWithState(step, "source_id string, t double, score double", "hist array<double>, gray array<double>", "append", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a stream with a watermark: key, start, end, n."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
