"""A second opinion on a shot's place: another feature's frames, scanned widely around the main place and scored in windows.

``frames`` (t, feature) holds the second feature along the library, ``queries`` each shot's representatives with the first feature
(``feature``) and the second one (``second``).  Every look is a stated (shot, time): the times are placed on frames by an
as-of join and only these frames are fetched, so the work grows with shots x window, not with the library.
A wide scan steps over +-``radius`` around the main middle (or takes the rows of an index there), and every step's surroundings are looked at more finely in the
same pass; a small walk per shot then picks peaks that lie apart from what is already a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids, dot, l2
from splicefind.operators.asof import asof_forward, range_join
from splicefind.operators.components import reliable
from splicefind.operators.folds import fold
from splicefind.operators.patches import WIDTH, spaced_candidates
from splicefind.operators.retrieval import DIGITS, topk_per_key


def looks(queries: DataFrame, asks: DataFrame, frames: DataFrame, width: float = WIDTH) -> DataFrame:
    """(shot_no, at, score): mean cosine of the shot's second features and the first frame at or after ``at`` (the last beyond the end)."""
    have = frames.where("feature is not null").select(F.col("t").cast("double").alias("_t"), "feature")
    placed = asof_forward(asks.select("shot_no", F.col("at").cast("double").alias("at")).distinct(), have.select("_t"), [], "at", "_t", [], width=width)
    placed = placed.where("match is not null").select("shot_no", "at", F.col("match.at").alias("_t")).join(have, "_t")
    # the mean of dot products is the product with the mean of the unit vectors
    mean = centroids(queries.where("second is not null").select("shot_no", l2("second").alias("second")), ["shot_no"], "second", "_q", unit=False)
    return placed.join(mean, "shot_no").select("shot_no", "at", F.round(dot(l2("feature"), "_q"), DIGITS).alias("score"))


def centres(lo: Column, hi: Column, step: float = 1.0) -> Column:
    """Array of the block centres of [lo, hi], one a ``step``, two at least, to three digits."""
    n = F.greatest(F.lit(2), F.ceil((hi - lo) / step).cast("int"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(lo + (hi - lo) * (i + 0.5) / n, 3)))


def candidate_middles(mains: DataFrame, candidates: DataFrame, wide: bool, clear: float = 0.03, most: int = 6) -> DataFrame:
    """(shot_no, now, half, place, mid): middles that the first feature proposes, the main one among them.

    A clear shot (see `patches.evaluated`) keeps its main middle only, and only where a wide scan follows.
    """
    listed = candidates.groupBy("shot_no").agg(F.array_sort(F.collect_list(F.struct("place", "t", "sim"))).alias("_c"))
    rows = mains.select("shot_no", ((F.col("start") + F.col("end")) / 2).alias("now"), ((F.col("q_end") - F.col("q_start")) / 2).alias("half")).where("now is not null").join(listed, "shot_no", "left")
    rows = rows.withColumn("_c", F.coalesce("_c", F.array().cast(listed.schema["_c"].dataType)))
    first, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    is_clear = F.coalesce((F.abs(first["t"] - F.col("now")) <= 2.0) & (F.round(first["sim"] - F.coalesce(second["sim"], F.lit(0.0)), DIGITS) >= clear), F.lit(False))
    mids = F.transform("_c", lambda c: c["t"])
    mids = F.when(F.forall(mids, lambda m: F.abs(m - F.col("now")) >= 0.5), F.concat(F.array("now"), mids)).otherwise(mids)
    rows = rows.withColumn("_clear", is_clear).withColumn("_m", F.when(is_clear, F.array("now")).otherwise(F.slice(F.array_distinct(mids), 1, most)))
    if not wide:
        rows = rows.where(~F.col("_clear"))
    missed = ~F.exists("_m", lambda m: F.abs(m - F.col("now")) <= 0.5)
    rows = rows.withColumn("_m", F.when(missed, F.concat(F.array("now"), F.slice("_m", 1, most - 1))).otherwise(F.col("_m")))
    return rows.select("shot_no", "now", "half", F.posexplode("_m").alias("place", "mid"))


def scan_steps(mids: DataFrame, radius: float, step: float, end: float | None, index: DataFrame | None) -> DataFrame:
    """(shot_no, now, t): the places that a wide scan looks at, an even grid or the index's rows within the radius."""
    shots = mids.select("shot_no", "now").distinct()
    if index is not None:
        near = shots.withColumn("_lo", F.col("now") - radius).withColumn("_hi", F.col("now") + radius)
        return range_join(index.select(F.col("t").cast("double").alias("t")), near, [], "t", "_lo", "_hi", WIDTH).select("shot_no", "now", "t")
    lo, hi = F.greatest(F.lit(0.0), F.col("now") - radius), F.col("now") + radius
    shots = shots.withColumn("_lo", lo).withColumn("_hi", hi if end is None else F.least(hi, F.lit(end))).where("_hi > _lo")
    n = F.greatest(F.lit(2), F.ceil((F.col("_hi") - F.col("_lo")) / step).cast("int") + 1)
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (n - 1), 3))
    return shots.select("shot_no", "now", F.explode(F.array_distinct(grid)).alias("t")).where(F.abs(F.col("t") - F.col("now")) > 1e-6)


def wide_peaks(mids: DataFrame, queries: DataFrame, frames: DataFrame, radius: float = 90.0, step: float = 2.0, fine: float = 2.0, apart: float = 2.0, k: int = 3, end: float | None = None, index: DataFrame | None = None) -> DataFrame:
    """(shot_no, pick, mid): up to ``k`` peaks of a scan around each main middle.

    Steps are taken from the best down (the earlier first), unless they lie within ``apart`` of the main middle, a candidate or a peak; a peak is the
    best place within ``fine`` of its step.
    """
    steps = reliable(scan_steps(mids, radius, step, end, index))
    hi = F.col("t") + fine
    steps = steps.withColumn("_lo", F.greatest(F.lit(0.0), F.col("t") - fine)).withColumn("_hi", hi if end is None else F.least(hi, F.lit(end))).where("_hi > _lo")
    near = steps.select("shot_no", "t", F.explode(centres(F.col("_lo"), F.col("_hi"))).alias("at"))
    if index is None:
        coarse_asks = steps.select("shot_no", F.col("t").alias("at"))
        scores = reliable(looks(queries, near.select("shot_no", "at").unionByName(coarse_asks), frames))
        coarse = scores
    else:
        scores = looks(queries, near.select("shot_no", "at"), frames)
        coarse = looks(queries, steps.select("shot_no", F.col("t").alias("at")), index)
    tops = near.join(scores, ["shot_no", "at"]).groupBy("shot_no", "t").agg(F.min_by("at", F.struct(-F.col("score"), "at")).alias("peak"))
    taken = mids.groupBy("shot_no").agg(F.collect_list("mid").alias("taken"), F.first("now").alias("_now"))
    rows = tops.join(coarse.select("shot_no", F.col("at").alias("t"), "score"), ["shot_no", "t"]).join(taken, "shot_no")

    def walk(rows: list[dict]) -> list[dict]:
        used, out = [rows[0]["_now"], *rows[0]["taken"]], []
        for r in sorted(rows, key=lambda r: -r["score"]):
            if len(out) < k and all(abs(r["t"] - m) > apart for m in used):
                used.append(r["peak"])
                out.append({"shot_no": r["shot_no"], "pick": len(out), "mid": r["peak"]})
        return out

    return fold(rows, ["shot_no"], ["t"], walk, "pick int, mid double", ["shot_no"])


def second_opinion(mains: DataFrame, queries: DataFrame, library: DataFrame, frames: DataFrame, radius: float = 90.0, margin: float = 0.05, k: int = 5, tolerance: float = 1.5, end: float | None = None, index: DataFrame | None = None) -> DataFrame:
    """Per shot the best other place by the second feature: (shot_no, now, mid, lead, wide, moved, start, end).

    ``mains`` has shot_no, start, end, q_start, q_end.  A place scores the best look within half the shot's length plus ``tolerance`` of it;
    the best other place (the earlier of equal ones) is taken where it leads the main one by ``margin``.  Without
    ``radius`` only the first feature's candidates are looked at, and clear shots give no row.
    """
    mains = mains.where((F.col("end") - F.col("start") > 0.01) & (F.col("q_end") - F.col("q_start") > 0.01))
    proposed = spaced_candidates(centroids(queries, ["shot_no"], out="feature").withColumn("t", F.lit(0.0)), library, k)
    mids = reliable(candidate_middles(mains, proposed, radius > 0).withColumn("wide", F.lit(False)))
    if radius > 0:
        peaks = wide_peaks(mids, queries, frames, radius, end=end, index=index)
        shots = mids.select("shot_no", "now", "half").distinct()
        fresh = shots.join(peaks, "shot_no").select("shot_no", "now", "half", (F.col("pick") + 1000).alias("place"), "mid", F.lit(True).alias("wide"))
        mids = reliable(mids.unionByName(fresh.join(mids.select("shot_no", "mid"), ["shot_no", "mid"], "left_anti")))
    lo, hi = F.greatest(F.lit(0.0), F.col("mid") - F.col("half") - tolerance), F.col("mid") + F.col("half") + tolerance
    asks = mids.withColumn("at", F.explode(centres(lo, hi if end is None else F.least(hi, F.lit(end)))))
    scores = asks.join(looks(queries, asks, frames), ["shot_no", "at"]).groupBy("shot_no", "now", "half", "place", "mid", "wide").agg(F.max("score").alias("score"))
    scores = reliable(scores)
    main = topk_per_key(scores.withColumn("_d", F.abs(F.col("mid") - F.col("now"))), ["shot_no"], ["_d", "place"], 1).select("shot_no", F.col("score").alias("_main"))
    other = topk_per_key(scores.where(F.abs(F.col("mid") - F.col("now")) > 0.5), ["shot_no"], [F.desc("score"), "mid"], 1)
    lead = F.round(F.col("score") - F.col("_main"), DIGITS)
    return other.join(main, "shot_no").select("shot_no", "now", "mid", lead.alias("lead"), "wide", (lead >= margin).alias("moved"), F.round(F.col("mid") - F.col("half"), 3).alias("start"), F.round(F.col("mid") + F.col("half"), 3).alias("end"))
