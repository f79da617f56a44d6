"""Shots and scenes of long series: detection, two levels, two passes and fusion of two legs, all dealt by ranges.

A series has keys (not null), distinct times t and a vector a row.  Rows are numbered range by range, local statistics run on
ranges with lent rows, suppression and merging in parallel (`suppress`), windows around cuts are fetched by banded range joins.
No step holds a whole series in one task; ``width`` is the seconds of a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicefind.functions.vectors import as_double, cosine, l1
from splicefind.operators import intervals, suppress
from splicefind.operators.asof import around, asof_forward, nearest, range_join
from splicefind.operators.components import reliable
from splicefind.operators.timeseries import adjacent_distance, by_ranges, is_peak, local_zscore, longest_run_share, over

BAND = 64.0  # rows or seconds of a bucket of the range joins


def _rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fps): one over the median step of a series (``rows`` has t and next_t)."""
    return rows.groupBy(*keys).agg((1 / F.greatest(F.percentile(F.col("next_t") - F.col("t"), F.lit(0.5)), F.lit(1e-9))).alias("fps"))


def distances(df: DataFrame, keys: list[str], width: float, smooth: int = 1) -> DataFrame:
    """Rows but the last of each series with place, place_n, next_t, distance to the next row, smoothed, z and peak."""
    smooth |= 1
    lent = smooth // 2 + max(2 * smooth + 1, 7) // 2 + 3

    def local(rows: DataFrame, part: list[str]) -> DataFrame:
        out = adjacent_distance(rows.withColumn("next_t", F.lead("t").over(over(part, "t"))), part, "t")
        return local_zscore(out, part, "t", "distance", smooth).withColumn("peak", is_peak("smoothed", part, "t"))

    rows = suppress.numbered_rows(df.select(*keys, "t", "feature"), keys, "t", width)
    return reliable(by_ranges(rows, keys, "t", width, lent, local).drop("feature", "mu", "sigma"))


def detect_cuts(df: DataFrame, keys: list[str], width: float, cut_abs: float = 0.30, z: float = 2.0, smooth: int = 1, least_s: float = 1.0, fps: float | None = None) -> DataFrame:
    """(keys, t, prev_t, place, strength): first rows of shots 2..n, with the time of the row before.

    Peaks of the smoothed distance of at least ``cut_abs`` and z-score ``z``, suppressed within ``least_s``.  Kept cuts lie a full length apart, so of the segments only the
    first and the last can be too short, and with each its one cut goes.
    """
    rows = distances(df, keys, width, smooth)
    found = rows.where(F.col("peak") & (F.col("smoothed") >= cut_abs) & (F.col("z") >= z))
    found = found.join(_rate(rows, keys), keys) if fps is None else found.withColumn("fps", F.lit(float(fps)))
    found = found.withColumn("_gap", F.greatest(F.lit(1.0), F.bround(least_s * F.col("fps"), 0)))
    kept = suppress.spaced(reliable(found), keys, "place", "smoothed", "_gap", suppress.ROWS)
    cut = F.col("place") + 1
    return kept.where((cut >= F.col("_gap")) & (F.col("place_n") - cut >= F.col("_gap"))).select(*keys, F.col("next_t").alias("t"), F.col("t").alias("prev_t"), cut.alias("place"), F.col("smoothed").alias("strength"))


def between_cuts(df: DataFrame, cuts: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, shot, place, start, end, n) of a series and its cuts (keys, t, prev_t, place); ends are times of rows."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("t"), F.max("t").alias("_last"), F.count("*").alias("_n"))
    starts = ends.select(*keys, "t", F.lit(None).cast("double").alias("prev_t"), F.lit(0).cast("long").alias("place")).unionByName(cuts.select(*keys, "t", "prev_t", "place"))

    def ahead(rows: DataFrame, part: list[str]) -> DataFrame:
        w = over(part, "t")
        return rows.withColumn("_end", F.lead("prev_t").over(w)).withColumn("_next", F.lead("place").over(w))

    starts = reliable(by_ranges(reliable(starts), keys, "t", width, 1, ahead))
    rows = suppress.numbered_rows(starts, keys, "t", width, "shot").join(ends.drop("t"), keys)
    return rows.select(*keys, F.col("shot").cast("int").alias("shot"), "place", F.col("t").alias("start"), F.coalesce("_end", "_last").alias("end"), (F.coalesce("_next", "_n") - F.col("place")).alias("n"))


def shots(df: DataFrame, keys: list[str], width: float, two_level: bool = False, cut_abs: float = 0.30, z: float = 2.0, smooth: int = 1, least_s: float = 1.0, fps: float | None = None, longest: float = 8.0) -> DataFrame:
    """(keys, shot, start, end, n); ``two_level`` cuts shots of over ``longest`` seconds and at least 4 rows again, with relaxed thresholds."""
    cuts = reliable(detect_cuts(df, keys, width, cut_abs, z, smooth, least_s, fps))
    out = between_cuts(df, cuts, keys, width)
    if two_level:
        long = reliable(out.where((F.col("end") - F.col("start") > longest) & (F.col("n") >= 4)).select(*keys, "shot", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("place").alias("_p")))
        rows = around(df.select(*keys, "t", "feature"), long, keys, "t", "_s", ["shot", "_e", "_p"], width)
        rows = reliable(rows.where(F.col("t") <= F.col("_prev._e")).select(*keys, "t", "feature", F.col("_prev.shot").alias("shot")))
        fine = detect_cuts(rows, [*keys, "shot"], width, cut_abs * 0.75, z * 0.85, smooth, 0.6, fps).join(long.select(*keys, "shot", "_p"), [*keys, "shot"])
        cuts = cuts.select(*keys, "t", "prev_t", "place").unionByName(fine.select(*keys, "t", "prev_t", (F.col("place") + F.col("_p")).alias("place")))
        out = between_cuts(df, cuts, keys, width)
    return out.drop("place")


# ---- gates ------------------------------------------------------------------------------------


def _mean(vectors: Column) -> Column:
    total = F.aggregate(vectors, F.array().cast("array<double>"), lambda acc, v: F.when(F.size(acc) == 0, v).otherwise(F.zip_with(acc, v, lambda x, y: x + y)))
    return F.transform(total, lambda x: x / F.size(vectors))


def block_stats(cands: DataFrame, rows: DataFrame, keys: list[str], k: str, vector: str, before: int | Column, after: int | Column, skip: int | Column, cos: bool = False) -> DataFrame:
    """``cands`` with distance (of the mean vectors before row ``k`` and from ``skip`` rows after it on) and deviation inside the later block.

    ``rows`` has keys, place and the vector.  Only rows of the candidates' bands are read.  L1, or cosine distance (``cos``); fewer
    than two rows in the later block, or none in the earlier, give (0, 9.9).
    """
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    cands = cands.withColumn("_skip", col(skip)).withColumn("_lo", F.col(k) - col(before)).withColumn("_hi", F.col(k) + F.col("_skip") + col(after) - 1)
    met = range_join(rows.select(*keys, F.col("place").alias("_place"), as_double(vector).alias("_v")), cands, keys, "_place", "_lo", "_hi", BAND)
    early, late = F.col("_place") < F.col(k), F.col("_place") >= F.col(k) + F.col("_skip")
    stats = met.groupBy(*keys, k).agg(F.collect_list(F.when(early, F.col("_v"))).alias("_b"), F.collect_list(F.when(late, F.col("_v"))).alias("_a"))
    stats = stats.withColumn("_mb", _mean(F.col("_b"))).withColumn("_ma", _mean(F.col("_a")))
    far = (lambda x, y: 1 - cosine(x, y)) if cos else l1
    ok = (F.size("_b") > 0) & (F.size("_a") > 1)
    stats = stats.select(*keys, k, F.when(ok, far("_mb", "_ma")).otherwise(0.0).alias("distance"), F.when(ok, F.array_max(F.transform("_a", lambda v: far(v, F.col("_ma"))))).otherwise(9.9).alias("deviation"))
    out = cands.drop("_skip", "_lo", "_hi").join(stats, [*keys, k], "left")
    return out.fillna({"distance": 0.0, "deviation": 9.9})


def pixel_gate(marks: DataFrame, pixels: DataFrame, keys: list[str], at: str, width: float, before: int = 4, after: int = 4, skip: int = 2, apart: float = 0.10, steady: float = 0.30) -> DataFrame:
    """``marks`` with pixel_ok: the picture changes for good there.  Series of under three histograms let everything pass.

    ``pixels`` has keys, t, hist; a mark looks at the row after the first at or after it.
    """
    rows = suppress.numbered_rows(pixels.select(*keys, "t", "hist"), keys, "t", width)
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    near = asof_forward(marks, rows.select(*keys, F.col("t").alias("_t"), "place"), keys, at, "_t", ["place"], False, width).join(size, keys, "left")
    near = near.withColumn("_k", F.greatest(F.lit(1), F.least(F.coalesce(F.col("match.place") + 1, F.col("_n")), F.col("_n") - 1)))
    asked = near.select(*keys, "_k").distinct().where("_k is not null")
    stats = block_stats(asked, rows, keys, "_k", "hist", before, after, skip)
    out = near.join(stats, [*keys, "_k"], "left")
    return out.withColumn("pixel_ok", F.coalesce(F.col("_n"), F.lit(0)).__lt__(3) | ((F.col("distance") >= apart) & (F.col("deviation") <= steady))).drop("match", "_n", "_k", "distance", "deviation")


def semantic_gate(marks: DataFrame, rows: DataFrame, keys: list[str], place: str, rate: DataFrame, before_s: float = 4.0, after_s: float = 4.0, skip_s: float = 2.0, apart: float = 0.05, steady: float = 0.20) -> DataFrame:
    """``marks`` (at row ``place``) with semantic_ok: the vectors change for good there.  ``rate`` has keys, fps; ``rows`` place and feature."""
    rows_of = lambda s, least: F.greatest(F.lit(least), F.bround(s * F.col("fps"), 0).cast("int"))
    stats = block_stats(marks.join(rate, keys), rows, keys, place, "feature", rows_of(before_s, 1), rows_of(after_s, 1), rows_of(skip_s, 0), cos=True)
    return stats.withColumn("semantic_ok", (F.col("distance") >= apart) & (F.col("deviation") <= steady)).drop("distance", "deviation", "fps")


# ---- scenes from two legs ---------------------------------------------------------------------


def scene_bounds(df: DataFrame, pixel_cuts: DataFrame, pixels: DataFrame, keys: list[str], width: float, cut_abs: float = 0.30, weight: float = 0.6, apart: float = 0.5, least_s: float = 1.0, fps: float | None = None, gates: dict | None = None) -> DataFrame:
    """(keys, place, t, raw_t, strength): first rows of scenes 2..n out of vector peaks and pixel cuts.

    A vector peak of at least ``cut_abs`` counts with ``weight`` x distance where the pixel or the semantic gate is open; a pixel cut (keys, t), on the nearest row, with 1
    where the pixel gate is.  The strongest stay, ``apart`` seconds from each other, and scenes under ``least_s`` seconds lose
    their weaker side.  ``raw_t`` is the latest pixel cut's own time on that row.  ``gates`` has options of `pixel_gate` and `semantic_gate`.
    """
    gates = gates or {}
    rows = suppress.numbered_rows(df.select(*keys, "t", "feature"), keys, "t", width)
    d = distances(df, keys, width)
    rate = _rate(d, keys)
    peaks = d.where(F.col("peak") & (F.col("distance") >= cut_abs)).select(*keys, (F.col("place") + 1).alias("place"), F.col("place_n"), F.col("next_t").alias("t"), "distance")
    peaks = pixel_gate(peaks.withColumnRenamed("distance", "_d"), pixels, keys, "t", width, **gates.get("pixel", {}))
    peaks = reliable(semantic_gate(reliable(peaks), rows, keys, "place", rate, **gates.get("semantic", {})))
    peaks = peaks.where(F.col("pixel_ok") | F.col("semantic_ok")).select(*keys, "place", "place_n", "t", (weight * F.col("_d")).alias("strength"), F.lit(0).alias("_leg"), F.lit(None).cast("double").alias("raw_t"))
    marks = pixel_gate(pixel_cuts.select(*keys, F.col("t").cast("double").alias("raw_t")), pixels, keys, "raw_t", width, **gates.get("pixel", {})).where("pixel_ok")
    marks = nearest(marks, rows.select(*keys, F.col("t").alias("_t"), "place", "place_n"), keys, "raw_t", "_t", ["place", "place_n"], width=width).where("match.place >= 1")
    marks = marks.groupBy(*keys, F.col("match.place").alias("place"), F.col("match.place_n").alias("place_n"), F.col("match.at").alias("t")).agg(F.max("raw_t").alias("raw_t"))
    both = peaks.unionByName(marks.withColumns({"strength": F.lit(1.0), "_leg": F.lit(1)}))
    best = F.min(F.struct((-F.col("strength")).alias("s"), F.col("_leg").alias("leg"))).alias("_b")  # one row a place: what is weaker at the same place never stays beside it
    both = both.groupBy(*keys, "place", "place_n", "t").agg(best, F.max("raw_t").alias("raw_t")).select(*keys, "place", "place_n", "t", "raw_t", (-F.col("_b.s")).alias("strength"), F.col("_b.leg").alias("_leg"))
    kept = reliable(suppress.spaced(reliable(both), keys, "t", "strength", apart, width, tie="_leg"))
    kept = kept.join(rate, keys) if fps is None else kept.withColumn("fps", F.lit(float(fps)))
    kept = kept.withColumn("_least", F.greatest(F.lit(1), F.bround(least_s * F.col("fps"), 0).cast("int")))
    return suppress.merge_short(kept, keys, "place", "strength", "place_n", "_least", suppress.ROWS).select(*keys, "place", "t", "raw_t", "strength")


def scenes(df: DataFrame, bounds: DataFrame, keys: list[str], width: float, fps: float | None = None) -> DataFrame:
    """(keys, start, end) of a series and its `scene_bounds`: a later pixel time is taken as the start, the last end is one row after the last."""
    rows = distances(df, keys, width) if fps is None else None
    ends = df.groupBy(*keys).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    ends = ends.join(_rate(rows, keys), keys, "left").fillna(1.0, ["fps"]) if fps is None else ends.withColumn("fps", F.lit(float(fps)))
    start = F.when(F.col("raw_t") > F.col("t"), F.col("raw_t")).otherwise(F.col("t"))
    starts = ends.select(*keys, F.col("_first").alias("start")).unionByName(bounds.select(*keys, start.alias("start")))
    starts = by_ranges(starts, keys, "start", width, 1, lambda r, part: r.withColumn("end", F.lead("start").over(over(part, "start"))))
    return starts.join(ends, keys).select(*keys, "start", F.coalesce("end", F.col("_last") + 1 / F.col("fps")).alias("end"))


# ---- two passes -------------------------------------------------------------------------------


def refined_cuts(dense: DataFrame, cuts: DataFrame, keys: list[str], window: int = 20, step: int = 2, margin: float = 0.25) -> DataFrame:
    """(keys, t, refined): each coarse cut moved to the largest step of the dense series around it.

    ``dense`` has keys, t, feature, flash and place; ``cuts`` keys, t and place in the dense series.  Every ``step``-th row of the ``window`` rows on both sides is
    looked at; of equal steps the first counts, at the time of its later row.  A cut stays where under three rows lie around it, or
    where the move would end within ``margin`` of a flash among them.
    """
    spans = cuts.select(*keys, F.col("t").alias("_cut"), F.greatest(F.lit(0), F.col("place") - window).alias("_lo"), (F.col("place") + window).alias("_hi"))
    near = range_join(dense.select(*keys, "place", "t", "feature", "flash"), spans, keys, "place", "_lo", "_hi", BAND).where((F.col("place") - F.col("_lo")) % step == 0)
    part = [*keys, "_cut"]
    pairs = adjacent_distance(near.withColumn("_later", F.lead("t").over(over(part, "place"))), part, "place")
    pick = pairs.groupBy(*part).agg(F.min_by("_later", F.struct(-F.round("distance", 9), "place")).alias("_to"), F.count("*").alias("_n"))
    flashes = near.groupBy(*part).agg(F.collect_list(F.when(F.col("flash"), F.col("t"))).alias("_f"))
    out = cuts.select(*keys, "t").join(pick.join(flashes, part).withColumnRenamed("_cut", "t"), [*keys, "t"], "left")
    ok = (F.col("_n") >= 2) & ~F.exists(F.coalesce("_f", F.array().cast("array<double>")), lambda f: F.abs(f - F.col("_to")) <= margin)
    return out.select(*keys, "t", F.when(F.coalesce(ok, F.lit(False)), F.col("_to")).otherwise(F.col("t")).alias("refined"))


def coarse_cuts(dense: DataFrame, keys: list[str], width: float, fps: float, coarse: int = 6, margin: float = 0.25, delta: float = 80.0, peak: float = 180.0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered dense rows, coarse rows, coarse cuts away from flashes and brightness spikes); cuts carry their dense place."""
    rows = suppress.numbered_rows(dense, keys, "t", width)
    few = rows.where(F.col("place") % coarse == 0)
    cuts = detect_cuts(few, keys, width, fps=fps / coarse, **options).select(*keys, "t", (F.col("place") * coarse).alias("place"))
    spikes = by_ranges(few.select(*keys, "t", "mean"), keys, "t", width, 1, lambda r, part: intervals.spikes(r, part, "t", "mean", delta, peak))
    marks = few.where("flash").select(*keys, F.col("t").alias("_m")).unionByName(spikes.select(*keys, F.col("t").alias("_m")))
    cuts = nearest(reliable(cuts), marks, keys, "t", "_m", [], width=width)
    return rows, few, reliable(cuts.where(F.coalesce(F.abs(F.col("match.at") - F.col("t")) > margin, F.lit(True))).drop("match"))


def drop_after_marked(segments: DataFrame, marks: DataFrame, keys: list[str], width: float, share: float = 0.5) -> DataFrame:
    """``segments`` (keys, start, end) without the one after each that marks (keys, t) fill to ``share`` (at most 1), or itself where it is the last."""
    met = range_join(marks.select(*keys, F.col("t").alias("_m")), segments, keys, "_m", "start", "end", BAND)
    fill = met.groupBy(*keys, "start").agg(F.when(F.count("*") > 1, F.max("_m") - F.min("_m")).otherwise(0.05).alias("_fill"))
    rows = segments.join(fill, [*keys, "start"], "left").withColumn("_hit", F.coalesce(F.col("_fill") / F.greatest(F.lit(1e-6), F.col("end") - F.col("start")) >= share, F.lit(False)))

    def sides(r: DataFrame, part: list[str]) -> DataFrame:
        w = over(part, "start")
        return r.withColumn("_before", F.coalesce(F.lag("_hit").over(w), F.lit(False))).withColumn("_last", F.lead("start").over(w).isNull())

    rows = by_ranges(rows, keys, "start", width, 1, sides)
    return rows.where(~F.col("_before") & ~(F.col("_hit") & F.col("_last"))).drop("_fill", "_hit", "_before", "_last")


def two_pass(dense: DataFrame, keys: list[str], width: float, fps: float, coarse: int = 6, window: int = 20, step: int = 2, least: float = 0.5, marked: float = 1.0, margin: float = 0.25, share: float = 0.5, **options) -> DataFrame:
    """(keys, start, end, n, card_ratio, card_run_ratio): coarse cuts, each refined in the dense series, with short segments merged.

    ``dense`` has keys, t, feature, flash, mean and card at ``fps`` rows a second.  Segments are at least ``least`` seconds long, ``marked`` near a flash;
    one after a flash-filled one goes; n counts coarse rows (one on a bound belongs to both sides), and segments without any vanish.  The series
    runs from 0 to its last time.
    """
    rows, few, cuts = coarse_cuts(dense, keys, width, fps, coarse, margin, **options)
    moved = reliable(refined_cuts(rows, cuts, keys, window, step, margin))
    ends = dense.groupBy(*keys).agg(F.round(F.max("t"), 4).alias("_b")).withColumn("_a", F.lit(0.0))
    points = moved.select(*keys, F.round("refined", 4).alias("t")).unionByName(ends.select(*keys, F.col("_a").alias("t"))).unionByName(ends.select(*keys, F.col("_b").alias("t"))).distinct()
    flashes = few.where("flash").select(*keys, F.col("t").alias("_m"))
    points = asof_forward(points.withColumn("_from_here", F.col("t") - margin), flashes, keys, "_from_here", "_m", [], False, width).withColumn("ahead", F.col("match.at")).drop("match", "_from_here")
    left = reliable(suppress.protect_durations(reliable(points.join(ends, keys)), keys, "t", "_a", "_b", least, marked, margin, width))
    segments = by_ranges(left.select(*keys, F.col("t").alias("start")), keys, "start", width, 1, lambda r, part: r.withColumn("end", F.lead("start").over(over(part, "start"))))
    segments = reliable(drop_after_marked(reliable(segments.where(F.col("end") - F.col("start") >= least)), flashes.withColumnRenamed("_m", "t"), keys, width, share))
    wide = segments.withColumn("_lo", F.col("start") - 1e-4).withColumn("_hi", F.col("end") + 1e-4)
    inside = range_join(few.select(*keys, "t", "card"), wide, keys, "t", "_lo", "_hi", BAND)
    part = [*keys, "start", "end"]
    size = inside.groupBy(*part).agg(F.count("*").alias("n"))
    closer = inside.where((F.col("t") >= F.col("start") - 1e-6) & (F.col("t") <= F.col("end") + 1e-6))
    cards = longest_run_share(closer, part, "t", "card").select(*part, F.col("share").alias("card_ratio"), F.col("run_share").alias("card_run_ratio"))
    return size.join(cards, part, "left").fillna(0.0, ["card_ratio", "card_run_ratio"])
