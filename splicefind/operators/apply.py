"""Steps that apply a repair or a verdict to located rows, and lookups built on as-of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.operators.asof import asof_forward, nearest, overlap_join, range_join
from splicefind.operators.folds import changes, whole_keys
from splicefind.operators.intervals import neighbours, temporal_outliers
from splicefind.operators.retrieval import bounded, topk_per_key

CELLS = 4_000_000  # cells scored at once


def temporal_ambiguity(rows: DataFrame, keys: list[str], order: str, row: str, near: float = 180.0, far: float = 600.0) -> DataFrame:
    """HIGH rows that are still temporal outliers become MEDIUM; adds ``ambiguous``."""
    odd = temporal_outliers(rows, keys, order, near, far).select(*keys, row, F.lit(True).alias("_odd"))
    out = rows.join(odd, [*keys, row], "left").withColumn("ambiguous", F.coalesce(F.col("_odd") & (F.col("level") == "HIGH"), F.lit(False)))
    return out.withColumn("level", F.when(F.col("ambiguous"), "MEDIUM").otherwise(F.col("level"))).drop("_odd")


def temporal_repair(rows: DataFrame, sims: DataFrame, keys: list[str], order: str, row: str, width: float, n_rows: int, near: float = 180.0, far: float = 600.0, slack: float = 2.0, least_move: float = 1.0) -> DataFrame:
    """Outliers move to the best place in the hull of their neighbours +-``slack``; adds ``repaired``.

    ``sims`` (keys, t, sim) is the series of each row's own query; the best place has the largest mean over
    ``n_rows`` consecutive rows inside the window, none that spans more than the row's width + 2 s, the first on ties.
    Windows come from the positions before any repair.  ``width`` is the bucket of the range join.
    """
    n = neighbours(rows, keys, order).select(*keys, row, (F.least("_pstart", "_nstart") - slack).alias("_lo"), (F.greatest("_pend", "_nend") + slack).alias("_hi"))
    odd = temporal_outliers(rows, keys, order, near, far).select(*keys, row, (F.col("end") - F.col("start")).alias("_w"), ((F.col("start") + F.col("end")) / 2).alias("_mid")).join(n, [*keys, row])
    met = range_join(sims.select(*keys, F.col("t").alias("_t"), "sim"), odd, keys, "_t", "_lo", "_hi", width)
    w = W.partitionBy(*keys, row).orderBy("_t").rowsBetween(0, n_rows - 1)
    met = met.withColumns({"_m": F.round(F.avg("sim").over(w), 9), "_n": F.count("*").over(w), "_e": F.max("_t").over(w)}).where((F.col("_n") == n_rows) & (F.col("_e") - F.col("_t") <= F.col("_w") + 2))
    best = topk_per_key(met, [*keys, row], [F.desc("_m"), "_t"], 1).where(F.abs(F.col("_t") + F.col("_w") / 2 - F.col("_mid")) >= least_move)
    out = rows.join(best.select(*keys, row, F.col("_t").alias("_new"), "_w"), [*keys, row], "left")
    moved = F.col("_new").isNotNull()
    out = out.withColumns({"_a": F.when(moved, F.col("_new")).otherwise(F.col("start")), "_b": F.when(moved, F.col("_new") + F.col("_w")).otherwise(F.col("end")), "repaired": moved})
    return out.drop("start", "end", "_new", "_w").withColumnsRenamed({"_a": "start", "_b": "end"})


def accept_choice(norm: Column, new_start: Column, start: Column, least: float = 0.50, move: float = 0.5) -> Column:
    """A sequence re-rank's choice is taken when it is good enough and really elsewhere."""
    return F.coalesce((norm >= least) & (F.abs(new_start - start) >= move), F.lit(False))


def lookup(wanted: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_at: str, carry: list[str], match: str = "first_ge", most_lag: float | None = None, width: float | None = None) -> DataFrame:
    """Many points at once: the first frame at or after each (else the last one), or the nearest, as struct ``match``.

    ``most_lag`` leaves points without a match whose frame comes later than that.
    """
    if match == "nearest":
        return nearest(wanted, frames, keys, at, frame_at, carry, most_lag, width)
    out = asof_forward(wanted, frames, keys, at, frame_at, carry, fallback_last=most_lag is None, width=width)
    return out if most_lag is None else out.withColumn("match", F.when(F.col("match.at") - F.col(at) <= most_lag, F.col("match")))


def grid_lookup(wanted: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_at: str, carry: list[str], step: float | None = None) -> DataFrame:
    """Points on a grid with holes: first frame at or after each, at most min(step, 0.5) later.

    ``step`` defaults to the smallest distance of two points of a series (1 without one).
    """
    if step is not None:
        return lookup(wanted, frames, keys, at, frame_at, carry, most_lag=min(step, 0.5))
    gap = F.col(at) - F.lag(at).over(W.partitionBy(*keys).orderBy(at))
    steps = wanted.withColumn("_g", gap).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_g") > 1e-6, F.col("_g"))), F.lit(1.0)).alias("_step"))
    out = asof_forward(wanted, frames, keys, at, frame_at, carry, fallback_last=False).join(steps, keys)
    return out.withColumn("match", F.when(F.col("match.at") - F.col(at) <= F.least("_step", F.lit(0.5)), F.col("match"))).drop("_step")


def card_frame(black: Column, bright: Column, spread: Column, area: Column, black_least: float = 0.85, bright_least: float = 0.01, bright_most: float = 0.30, spread_most: float = 48.0, area_least: float = 0.004) -> Column:
    """Dark ground with few, white and solid bright spots; from ratios of a frame (spread and area null without spots)."""
    solid = F.coalesce((spread <= spread_most) & (area >= area_least), F.lit(True))
    return bright.between(bright_least, bright_most) & solid & (black >= black_least)


def flash_frame(mean: Column, bright: Column, mean_least: float = 200.0, bright_least: float = 0.5) -> Column:
    """Bright on average and in most of its pixels."""
    return (mean >= mean_least) & (bright >= bright_least)


CRITERIA = {"S_strict": ("strict", 0.0, "base"), "Z_point": ("point", 0.0, "base"), "T_tol05": ("strict", 0.5, "base"), "R_rec": ("point", 0.5, "base"), "O_overlap": ("strict", 0.0, "overlap"), "A_any": ("strict", 0.0, "any"), "SE_diag": ("wide", 0.0, "base")}


def recall_criteria(truth: DataFrame, results: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Per truth row (truth_id, key, q_start, q_end, start, end) the seven recall criteria side by side.

    ``results`` has key, q_start, q_end, start, end, one row a span and ``result_id``.  The query side counts by plain overlap (strict), also for
    points (point) or with half a second to spare (wide); the truth's window may be half a second wider; a hit is
    base (inside +-2 s, holding the midpoint, or covering 40 %), or an overlap of half a second (any) that is also
    half of the shorter side (overlap).  Without one, summed overlaps of half on both sides count.
    Pairs are made in buckets of ``width`` of the query side.
    """
    r = results.where("end - start > 0.01").select(key, "result_id", F.col("q_start").alias("_qs"), F.col("q_end").alias("_qe"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    # both sides wider than what counts, so that touching spans and points meet, too
    near = truth.withColumns({"_t0": F.col("q_start") - 0.75, "_t1": F.col("q_end") + 0.75})
    r = r.withColumns({"_r0": F.col("_qs") - 0.25, "_r1": F.col("_qe") + 0.25})
    met = overlap_join(near, r, [key], "_t0", "_t1", "_r0", "_r1", width).where((F.col("_qs") <= F.col("q_end") + 0.5) & (F.col("_qe") >= F.col("q_start") - 0.5))
    shared = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    c = F.col
    q = {
        "strict": shared(c("q_start"), c("q_end"), c("_qs"), c("_qe")),
        "wide": shared(c("q_start") - 0.5, c("q_end") + 0.5, c("_qs"), c("_qe")),
    }
    q["point"] = F.when(c("q_end") - c("q_start") < 1e-6, F.when((c("_qs") <= c("q_start")) & (c("q_start") <= c("_qe")), 1e-3).otherwise(0.0)).otherwise(q["strict"])
    size = F.greatest(c("end") - c("start"), F.lit(1e-6))
    over = shared(c("_s"), c("_e"), c("start"), c("end"))
    mid = (c("start") + c("end")) / 2
    flags = {}
    for name, (side, slack, kind) in CRITERIA.items():
        hit = ((c("_s") >= c("start") - slack - 2) & (c("_e") <= c("end") + slack + 2)) | ((c("_s") <= mid) & (c("_e") >= mid)) | (over / size >= 0.4)
        if kind == "any":
            hit = hit | (over >= 0.5)
        elif kind == "overlap":
            hit = hit | ((over >= 0.5) & (over / F.least(F.greatest(c("_e") - c("_s"), F.lit(1e-6)), size) >= 0.5))
        spare = 0.5 if side == "wide" else 0.0
        inside = F.greatest(F.lit(0.0), F.least(c("_qe"), c("q_end") + spare) - F.greatest(c("_qs"), c("q_start") - spare)) / F.greatest(c("q_end") - c("q_start") + 2 * spare, F.lit(1e-6))
        counted = q[side] > 0
        first = c("_first") & counted
        joint = (F.sum(F.when(first, inside).otherwise(0.0)) >= 0.5) & (F.sum(F.when(counted, over / size).otherwise(0.0)) >= 0.5)
        flags[name] = F.coalesce(F.max(hit & counted), F.lit(False)) | F.coalesce(joint, F.lit(False))
    # a result's query side counts once, however many spans it has
    met = met.withColumn("_first", F.row_number().over(W.partitionBy("truth_id", "result_id").orderBy("_s", "_e")) == 1)
    per = met.groupBy("truth_id").agg(*[f.alias(n) for n, f in flags.items()])
    return truth.select("truth_id").join(per, "truth_id", "left").select("truth_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in CRITERIA])


def score_starts(sims: DataFrame, starts: DataFrame, keys: list[str], span: int, columns: int, least: float, row: str = "row", place: str = "place", sim: str = "sim") -> DataFrame:
    """Candidate starts (keys, start) over a similarity table (keys, row, place, sim): coarse, support and refined.

    Each query row's maximum over places [start, start + span]: their mean (coarse), the share of at least ``least``
    (support), and the mean of the maxima within +-1 place of the median best place (refined).  Windows with under
    max(2, span // 3) places give -1 each.

    Cells and starts meet in one shuffle on ``keys``; a task scores all tables of a batch at once.  One key's table of ``columns`` places is
    the unit of memory.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    cells = sims.where(known & F.col(row).isNotNull() & F.col(sim).isNotNull() & F.col(place).between(0, columns - 1))
    cells = cells.select(*keys, F.xxhash64(row).alias("_row"), F.col(place).cast("int").alias("_place"), F.col(sim).cast("double").alias("_sim"), F.lit(None).cast(starts.schema["start"].dataType).alias("start"), F.lit(False).alias("_asked"))
    asked = starts.select(*keys, F.lit(None).cast("long").alias("_row"), F.lit(None).cast("int").alias("_place"), F.lit(None).cast("double").alias("_sim"), "start", F.lit(True).alias("_asked"))
    names = [*keys, "start"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in starts.select(*names).schema) + ", coarse double, support double, refined double"

    def run(batches):
        for table in whole_keys(batches, keys):
            key = np.cumsum(changes(table, keys)) - 1
            ask = table["_asked"].to_numpy().astype(bool)
            wanted = table.filter(pa.array(ask)).select(names).append_column("_k", pa.array(key[ask])).sort_by([("_k", "ascending"), ("start", "ascending")])
            wanted = wanted.filter(pa.array(changes(wanted, ["_k", "start"])))
            of, start = wanted["_k"].to_numpy(), pc.fill_null(wanted["start"].cast("int64"), columns).to_numpy()  # a null start scores nothing
            wanted = wanted.select(names)
            held = table.filter(pa.array(~ask))
            got = _window_scores(key[~ask], held["_row"].to_numpy(), held["_place"].to_numpy(), held["_sim"].to_numpy(), of, start, span, columns, least)
            for name, values in zip(("coarse", "support", "refined"), got, strict=True):
                wanted = wanted.append_column(name, pa.array(values))
            yield from wanted.combine_chunks().to_batches()

    return cells.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _window_scores(key, row, place, sim, of, start, span: int, columns: int, least: float) -> np.ndarray:
    """coarse, support and refined of each start (``of`` its key) over cells (key, row, place, sim); -1 where nothing counts."""
    out = np.full((3, len(start)), -1.0)
    if not len(key):
        return out
    # one line of the grid for each row of a key, a key's lines together
    order = np.lexsort((row, key))
    key, row, place, sim = key[order], row[order], place[order], sim[order]
    line = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) - 1
    line_key = key[np.flatnonzero(np.r_[True, line[1:] != line[:-1]])]
    grid = np.full((len(line_key), columns + span + 1), -np.inf)
    np.maximum.at(grid, (line, place), sim)
    lo, hi = np.maximum(start, 0), np.minimum(columns, start + span + 1)
    ask = np.flatnonzero(hi - lo >= max(2, span // 3))
    a, b = np.searchsorted(line_key, of[ask]), np.searchsorted(line_key, of[ask], side="right")
    offset = np.arange(span + 1)
    for part in bounded((b - a) * (span + 1), CELLS):
        some, n = ask[part], (b - a)[part]
        which = np.repeat(np.arange(len(some)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[part], n)
        left = lo[some][which]
        window = grid[at[:, None], left[:, None] + offset]
        window[offset >= (hi[some][which] - left)[:, None]] = -np.inf
        best = window.max(axis=1)
        full = np.isfinite(best)
        which, window, best = which[full], window[full], best[full]
        rows = np.bincount(which, minlength=len(some))
        met = rows > 0
        out[0, some[met]] = np.bincount(which, best, len(some))[met] / rows[met]
        out[1, some[met]] = np.bincount(which, best >= least, len(some))[met] / rows[met]
        arg = window.argmax(axis=1)
        by = np.lexsort((arg, which))
        begin = np.cumsum(rows) - rows
        low, high = begin[met] + (rows[met] - 1) // 2, begin[met] + rows[met] // 2
        median = np.zeros(len(some), np.int64)
        median[met] = (arg[by][low] + arg[by][high]) // 2
        near = np.abs(offset - np.maximum(median, 0)[which][:, None]) <= 1
        near &= offset >= np.maximum(0, median - 1)[which][:, None]
        fine = np.where(near, window, -np.inf).max(axis=1)
        has = np.isfinite(fine)
        count = np.bincount(which[has], minlength=len(some))
        met = count > 0
        out[2, some[met]] = np.bincount(which[has], fine[has], len(some))[met] / count[met]
    return out


def prior_start(start: Column, end: Column, seed: Column, ok: Column) -> Column:
    """A vote of the shot's own rows moves the start only, and never past the end."""
    return F.when(F.coalesce(ok & (seed < end), F.lit(False)), F.greatest(seed, F.lit(0.0))).otherwise(start)


def anchored(start: Column, end: Column, seed: Column, ok: Column, last: Column) -> tuple[Column, Column]:
    """A vote of the whole batch moves the start and keeps the width, up to the last time."""
    moved = F.coalesce(ok, F.lit(False))
    return F.when(moved, seed).otherwise(start), F.when(moved, F.least(last, seed + (end - start))).otherwise(end)


def strong_subs(subs: Column, least: float = 0.2) -> Column:
    """Sub spans (start, end, cover) without those of little cover."""
    return F.filter(subs, lambda s: F.coalesce(s["cover"] >= least, F.lit(False)))


def found_by_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which one of the columns holds the text, upper and lower case alike."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.where(hit)
