"""Greedy suppression and short-segment merging of one long series, in parallel and with the result of the sequential walk.

Suppression (`spaced`): places are taken from the strongest down, each at least ``apart`` from all taken before.  A row's fate
depends on stronger rows within ``apart`` only, so each range of the series decides what it can see: it gets its own rows and copies of its
neighbours' rows within ``apart`` of its edges, which it cannot decide itself; an own row with an undecided stronger one beside it waits.
Ranges are shifted by half their width each turn, so an edge of one turn is the middle of the next; turns
go on until no row waits.  The strongest waiting row is always decided, so this ends; usually after two or three turns,
at worst after one for each range that one unbroken slope of rising strengths crosses.

Merging (`merge_short`): a cut between two segments of full length is never removed, for segments only grow.  So the series falls into pieces
between such cuts, and each piece is walked by itself.

Rows need distinct places within a series.  Null places or strengths take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.operators import folds
from splicefind.operators.asof import around
from splicefind.operators.components import reliable
from splicefind.operators.timeseries import by_ranges, over

WAITING, KEPT, DROPPED = range(3)
ROWS = 100_000  # rows of a range, about


def numbered_rows(df: DataFrame, keys: list[str], order: str, width: float, out: str = "place") -> DataFrame:
    """``df`` with each row's place in its series (from 0) and the series' rows as ``<out>_n``, counted range by range."""
    part = [*keys, "_b"]
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    size = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    line = W.partitionBy(*keys)
    size = size.select(*part, F.coalesce(F.sum("_n").over(line.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(line).alias(f"{out}_n"))
    rows = rows.withColumn("_i", F.row_number().over(over(part, order)) - 1)
    same = [rows[c].eqNullSafe(size[c]) for c in part]
    joined = rows.join(size, same)
    return joined.select(*[rows[c] for c in df.columns], (F.col("_before") + F.col("_i")).alias(out), F.col(f"{out}_n"))


def decide(at: np.ndarray, strength: np.ndarray, tie: np.ndarray, apart: np.ndarray, state: np.ndarray, own: np.ndarray) -> np.ndarray:
    """States after all that is certain: from the strongest down, dropped beside a kept row, waiting beside a waiting one."""
    by_time = np.argsort(at, kind="stable")
    line, rank = at[by_time], np.empty(len(at), np.int64)
    rank[by_time] = np.arange(len(at))
    silent, doubt = np.zeros(len(at), bool), np.zeros(len(at), bool)
    out = state.copy()
    for i in np.lexsort((at, tie, -strength)):
        if out[i] == WAITING:
            if silent[rank[i]]:
                out[i] = DROPPED
            elif own[i] and not doubt[rank[i]]:
                out[i] = KEPT
        if out[i] != DROPPED:
            a, b = np.searchsorted(line, at[i] - apart[i]), np.searchsorted(line, at[i] + apart[i], side="right")
            (silent if out[i] == KEPT else doubt)[a:b] |= np.abs(line[a:b] - at[i]) < apart[i]
    return out


def spaced(df: DataFrame, keys: list[str], at: str, strength: str, apart: str | float, width: float, tie: str | None = None) -> DataFrame:
    """The rows that the greedy walk keeps (strongest first, of equal ones the smaller ``tie``, then the earlier).

    ``apart`` is a number or a column that is constant in each series; ``width`` the places of a range (at least twice ``apart``
    is taken).  Each turn is a stored table of the rows still in play, kept ones with them.
    """
    gap = F.col(apart) if isinstance(apart, str) else F.lit(float(apart))
    rows = df.where(F.col(at).isNotNull() & F.col(strength).isNotNull())
    rows = reliable(rows.select(*keys, F.col(at).cast("double").alias("_at"), F.col(strength).cast("double").alias("_s"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), gap.cast("double").alias("_apart"), F.lit(WAITING).alias("_state")))
    wide = F.greatest(F.lit(float(width)), 2 * F.col("_apart"))
    names = [*keys, "_at", "_s", "_tie", "_apart", "_state"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def task(key, table):
        state = decide(*(table[c].to_numpy() for c in ("_at", "_s", "_tie", "_apart", "_state", "_own")))
        mine = table["_own"].to_numpy() & (state != DROPPED)
        return table.select(names[:-1]).append_column("_state", pa.array(state.astype(np.int32))).filter(pa.array(mine))

    turn = 0
    while rows.where(F.col("_state") == WAITING).limit(1).count():
        place = F.col("_at") / wide + (0.5 if turn % 2 else 0.0)
        cell = F.floor(place).cast("long")
        into = (place - cell) * wide  # how far into its range a row lies
        near = F.array_compact(F.array(F.struct(cell.alias("r"), F.lit(True).alias("own")), F.when(into <= F.col("_apart"), F.struct((cell - 1).alias("r"), F.lit(False).alias("own"))), F.when(wide - into <= F.col("_apart"), F.struct((cell + 1).alias("r"), F.lit(False).alias("own")))))
        dealt = rows.withColumn("_x", F.explode(near)).select(*names, F.col("_x.r").alias("_r"), F.col("_x.own").alias("_own"))
        rows = reliable(dealt.groupBy(*keys, "_r").applyInArrow(task, kinds))
        turn += 1
    kept = rows.select(*keys, F.col("_at"))
    return df.join(kept, [df[k].eqNullSafe(kept[k]) for k in keys] + [df[at].cast("double") == kept["_at"]], "left_semi")


def _between_safe(df: DataFrame, keys: list[str], at: str, start: str, end: str, full: str, width: float) -> DataFrame:
    """``df`` with _from and _to: the nearest points around each row, or the series' ends, both of whose segments are ``full`` long.

    ``start``, ``end`` and ``full`` are columns that are constant in each series.  A safe point has itself on both sides.
    """
    def sides(rows: DataFrame, part: list[str]) -> DataFrame:
        w = over(part, at)
        return rows.withColumn("_l", F.col(at) - F.coalesce(F.lag(at).over(w), F.col(start))).withColumn("_r", F.coalesce(F.lead(at).over(w), F.col(end)) - F.col(at))

    rows = reliable(by_ranges(df, keys, at, width, 1, sides))
    safe = rows.where((F.col("_l") >= F.col(full)) & (F.col("_r") >= F.col(full))).select(*keys, F.col(at).alias("_safe"))
    near = around(rows.drop("_l", "_r"), safe, keys, at, "_safe", [], width)
    return near.withColumn("_from", F.coalesce(F.col("_prev.at"), F.col(start).cast("double"))).withColumn("_to", F.coalesce(F.col("_next.at"), F.col(end).cast("double"))).drop("_prev", "_next")


def merge_short(df: DataFrame, keys: list[str], at: str, strength: str, end: str, least: str, width: float) -> DataFrame:
    """Cuts left of a series' places 0 .. ``end``: while a segment is shorter than ``least``, the weaker cut beside the first such goes.

    ``end`` and ``least`` are columns that are constant in each series, ``width`` the places of a range.
    """
    near = _between_safe(df.withColumn("_zero", F.lit(0)), keys, at, "_zero", end, least, width)

    def walk(points: list[dict]) -> list[dict]:
        inner = [r for r in points if r["_from"] < r[at] < r["_to"]]
        if not inner:
            return points
        a, b = int(inner[0]["_from"]), int(inner[0]["_to"])
        left = set(folds.merge_short(b - a, [int(r[at]) - a for r in inner], [r[strength] for r in inner], int(inner[0][least])))
        return [r for r in points if not r["_from"] < r[at] < r["_to"] or int(r[at]) - a in left]

    return folds.fold(near, [*keys, "_from"], [at], walk).drop("_from", "_to", "_zero")


def protected(points: list[float], ahead: list[float | None], least: float, marked: float, margin: float) -> list[int]:
    """Indices of the points left while segments are too short: beside a short one the point goes whose other side lacks more.

    ``ahead`` is the first mark at or after each point less ``margin``: a segment with a mark within the margin needs ``marked``, others ``least``.
    The first point stays; the last one goes where the last segment is the one that lacks more.
    """
    left = list(range(len(points)))

    def spare(i: int, j: int) -> float:
        near = ahead[i] is not None and ahead[i] <= points[j] + margin
        return points[j] - points[i] - (marked if near else least)

    going = True
    while going:
        going, i = False, 1
        while i < len(left) - 1:
            before, after = spare(left[i - 1], left[i]), spare(left[i], left[i + 1])
            if before < 0 or after < 0:
                del left[i if before <= after else i + 1]
                going = True
            else:
                i += 1
    return left


def protect_durations(df: DataFrame, keys: list[str], at: str, start: str, end: str, least: float, marked: float, margin: float, width: float, ahead: str = "ahead") -> DataFrame:
    """All points of a series (its two ends among them) that `protected` leaves, walked piece by piece.

    Segments of the larger threshold never lose a point, so points between two such segments bound the pieces.
    """
    near = _between_safe(df.withColumn("_full", F.lit(float(max(least, marked)))), keys, at, start, end, "_full", width).drop("_full")
    # a safe point, or the series' start, opens the piece after it; the piece's closing point is sent there, too
    near = reliable(near)
    opens = near.withColumn("_piece", F.when(F.col(at) < F.col(end), F.col("_from")).otherwise(F.coalesce(F.when(F.col("_from") < F.col(at), F.col("_from")), F.col(start).cast("double"))))
    closing = by_ranges(near.where((F.col("_from") == F.col(at)) | (F.col(at) == F.col(start)) | (F.col(at) == F.col(end))), keys, at, width, 1, lambda rows, part: rows.withColumn("_piece", F.lag(at).over(over(part, at))))
    closing = closing.where(F.col("_piece").isNotNull()).withColumn("_closing", F.lit(True))
    rows = opens.where((F.col(at) < F.col(end))).withColumn("_closing", F.lit(False)).unionByName(closing)

    def walk(points: list[dict]) -> list[dict]:
        kept = protected([r[at] for r in points], [r[ahead] for r in points], least, marked, margin)
        return [points[i] for i in kept if not points[i]["_closing"] or points[i][at] == points[i][end]]

    return folds.fold(rows, [*keys, "_piece"], [at], walk).drop("_from", "_to", "_piece", "_closing")
