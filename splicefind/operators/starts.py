"""Exact starts by local descriptors: mutual neighbours counted in each candidate frame of a window, finalists, a settled start.

Query frames have shot_no and patches (array of descriptors), library frames t and patches.  Matching descriptors to
points of a plane and fitting a plane motion is not part of this; its counts (inliers) can be given by the caller and stand before
the matches in every order.  Only frames inside a shot's own window are fetched and multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicefind.operators.asof import range_join
from splicefind.operators.components import reliable
from splicefind.operators.patches import _bags
from splicefind.operators.retrieval import DIGITS, topk_per_key

# What a start must show to replace another
MIN_MATCHES, MIN_INLIERS, MIN_GAIN, MIN_RATIO = 12, 8, 4, 0.20


def anchors(mains: DataFrame) -> DataFrame:
    """``mains`` (shot_no, q_start, q_end, ...) with anchor: how far behind a start its frame is looked up."""
    return mains.withColumn("anchor", F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.col("q_end") - F.col("q_start")) * 0.1))


def mutual_matches(mains: DataFrame, queries: DataFrame, frames: DataFrame, margin: float = 4.0, slack: float = 0.051, least: float = 0.82, step: float = 0.1, width: float = 64.0) -> DataFrame:
    """(shot_no, start, candidate, matches): for each library frame around a shot's start the number of mutual nearest descriptors.

    ``mains`` has shot_no (once each), start, q_start, q_end; ``queries`` one row a shot: its frame at the anchor.  A candidate is a frame's time
    less the anchor, within ``margin`` (and ``slack``) of the start.  A pair counts when each is the other's nearest (the first of equal ones) and
    their cosine is ``least`` at least.  Frames without descriptors have 0 matches; nulls in keys or times give no row.
    """
    m = anchors(mains.where("shot_no is not null and start is not null and q_start is not null and q_end is not null"))
    m = m.select(F.col("shot_no").cast("long").alias("shot_no"), F.col("start").cast("double").alias("start"), "anchor")
    m = m.withColumns({"_lo": F.greatest(F.lit(0.0), F.col("start") - margin), "_hi": F.col("start") + margin + F.col("anchor") + step})
    have = frames.where("t is not null").select(F.col("t").cast("double").alias("l_t"), "patches")
    rows = range_join(have, m, [], "l_t", "_lo", "_hi", width).withColumn("candidate", F.col("l_t") - F.col("anchor"))
    rows = rows.where(F.abs(F.col("candidate") - F.col("start")) <= margin + slack).select("shot_no", "start", "candidate", F.coalesce("patches", F.array().cast(frames.schema["patches"].dataType)).alias("patches"))
    own = queries.where("shot_no is not null and patches is not null").select(F.col("shot_no").cast("long").alias("of"), "patches")

    def task(key, rows, own):
        counts = np.zeros(len(rows), dtype=np.int64)
        if len(rows) and len(own):
            q, _ = _bags(own["patches"])
            c, size = _bags(rows["patches"])
            ends = np.concatenate([[0], np.cumsum(size)])
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a and len(q):
                    sims = np.round(q @ c[a:b].T, DIGITS)
                    there, back = sims.argmax(axis=1), sims.argmax(axis=0)
                    counts[i] = np.sum((back[there] == np.arange(len(q))) & (sims[np.arange(len(q)), there] >= least))
        return pa.table({"shot_no": rows["shot_no"], "start": rows["start"], "candidate": rows["candidate"], "matches": counts})

    return rows.groupBy("shot_no").cogroup(own.groupBy("of")).applyInArrow(task, "shot_no long, start double, candidate double, matches long")


def _order():
    return [F.desc("inliers"), F.desc("matches"), F.abs(F.col("candidate") - F.col("start")), "candidate"]


def finalists(rows: DataFrame, k: int = 5) -> DataFrame:
    """(shot_no, start, candidate, inliers, matches, rank, current): the k best candidates and the one nearest to the start, each once.

    ``rows`` is what `mutual_matches` gives, with inliers where a caller has them (else the matches stand for them).  Order: inliers, matches, distance to the
    start, time.  ``current`` marks the nearest one (of two the earlier), which keeps its rank when it is not among the best.
    """
    rows = rows if "inliers" in rows.columns else rows.withColumn("inliers", F.col("matches"))
    rows = topk_per_key(rows.where("candidate is not null"), ["shot_no"], _order(), 2**31 - 1)
    now = rows.groupBy("shot_no").agg(F.min_by("rank", F.struct(F.round(F.abs(F.col("candidate") - F.col("start")), 9), "candidate")).alias("_now"))
    out = rows.join(now, "shot_no").withColumn("current", F.col("rank") == F.col("_now")).where((F.col("rank") <= k) | F.col("current"))
    return out.select("shot_no", "start", "candidate", "inliers", "matches", "rank", "current")


def settled_start(rows: DataFrame, matches: int = MIN_MATCHES, inliers: int = MIN_INLIERS, gain: int = MIN_GAIN, ratio: float = MIN_RATIO) -> DataFrame:
    """(shot_no, start, new_start, current_inliers, best_inliers, matches, ratio, moved) of each shot's finalists after a second count.

    ``rows`` has the finalists with inliers, matches, ratio and current.  The best one replaces the start if it has ``matches``, ``ratio`` and
    at least ``inliers`` and ``gain`` more than the current one, and lies 5 ms away or more.
    """
    rows = reliable(rows)
    top = topk_per_key(rows, ["shot_no"], _order(), 1)
    now = rows.where("current").select("shot_no", F.col("inliers").alias("current_inliers"))
    out = top.join(now, "shot_no")
    sure = (F.col("matches") >= matches) & (F.col("inliers") >= F.greatest(F.lit(inliers), F.col("current_inliers") + gain)) & (F.col("ratio") >= ratio)
    moved = F.coalesce(sure & (F.abs(F.col("candidate") - F.col("start")) >= 0.005), F.lit(False))
    return out.select("shot_no", "start", F.when(moved, F.round("candidate", 2)).otherwise(F.col("start")).alias("new_start"), "current_inliers", F.col("inliers").alias("best_inliers"), "matches", F.round("ratio", 4).alias("ratio"), moved.alias("moved"))
