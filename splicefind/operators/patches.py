"""Re-ranking by late interaction: a frame is a bag of patch vectors, alike as far as each of its patches finds a partner.

Frames have t, feature (one vector) and patches (array of vectors of one length); query frames have shot_no instead of t
(or beside it).  `late_scores` scores stated (shot, time) pairs only: the times are placed on library frames by an as-of
join, the frames of these places fetched by an equi-join, and each shot's task multiplies its own query patches with
its own frames.  So what is read and shuffled grows with the windows asked for, never with shots x library.
Scores are rounded to DIGITS before they are ranked.  Frames without patches take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids, cosine
from splicefind.operators.asof import asof_forward, range_join
from splicefind.operators.components import reliable
from splicefind.operators.folds import fold, spaced_best
from splicefind.operators.retrieval import DIGITS, _matrix, top_k, topk_per_key
from splicefind.operators.timeseries import similarity_runs

BEST = 100  # patches whose maxima are averaged
GLOBAL, PATCH = 0.45, 0.55  # weights of the whole frame and of its patches
WIDTH = 64.0  # seconds of a bucket of the as-of and range joins


def representatives(shots: DataFrame, frames: DataFrame, n: int, digits: int | None = 2) -> DataFrame:
    """(shot_no, i, at, feature, patches): the frames at the centres of n equal blocks of each shot.

    ``shots`` has shot_no, q_start, q_end; ``frames`` the shots' own frames (shot_no, t, feature, patches).
    """
    at = F.col("q_start") + (F.col("q_end") - F.col("q_start")) * (F.col("i") + 0.5) / n
    want = shots.select("shot_no", "q_start", "q_end", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    want = want.select("shot_no", "i", (at if digits is None else F.round(at, digits)).alias("at"))
    have = frames.where("patches is not null").select("shot_no", F.col("t").cast("double").alias("t"), "feature", "patches")
    got = asof_forward(want, have, ["shot_no"], "at", "t", ["feature", "patches"])
    return got.where("match is not null").select("shot_no", "i", "at", "match.feature", "match.patches")


def _bags(column) -> tuple[np.ndarray, np.ndarray]:
    """(all patches as unit rows, number of patches of each frame)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _matrix(column.flatten()), np.asarray(column.value_lengths(), dtype=np.int64)


def _mean_of_best(x: np.ndarray, best: int) -> float:
    return float(np.sort(x)[-best:].mean())


def late_scores(queries: DataFrame, asks: DataFrame, frames: DataFrame, best: int = BEST, width: float = WIDTH) -> DataFrame:
    """(shot_no, at, l_t, cosine, stacked, per_frame) of each distinct (shot_no, at) of ``asks``.

    ``l_t`` is the first frame at or after ``at`` (the last one beyond the end).  ``cosine`` is the mean over the shot's query frames, ``stacked`` the
    mean of the ``best`` largest patch maxima over all its query frames, ``per_frame`` the mean over the query frames of that mean.
    """
    wanted = asks.select("shot_no", F.col("at").cast("double").alias("at")).distinct()
    have = frames.where("patches is not null").select(F.col("t").cast("double").alias("l_t"), "feature", "patches")
    placed = asof_forward(wanted, have.select("l_t"), [], "at", "l_t", [], width=width).where("match is not null")
    rows = placed.select("shot_no", "at", F.col("match.at").alias("l_t")).join(have, "l_t")

    def task(key, rows, queries):
        if not len(queries) or not len(rows):
            return pa.table({"shot_no": pa.array([], pa.int64()), **{n: pa.array([], pa.float64()) for n in ("at", "l_t", "cosine", "stacked", "per_frame")}})
        q, own = _bags(queries["patches"])
        c, size = _bags(rows["patches"])
        upto, ends = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(size)])
        cos = (_matrix(rows["feature"]) @ _matrix(queries["feature"]).T).mean(axis=1)
        stacked, per_frame = [], []
        for a, b in zip(ends, ends[1:]):
            peak = (q @ c[a:b].T).max(axis=1)
            stacked.append(_mean_of_best(peak, best))
            per_frame.append(np.mean([_mean_of_best(peak[x:y], best) for x, y in zip(upto, upto[1:])]))
        return pa.table({"shot_no": rows["shot_no"], "at": rows["at"], "l_t": rows["l_t"], "cosine": np.round(cos, DIGITS), "stacked": np.round(stacked, DIGITS), "per_frame": np.round(per_frame, DIGITS)})

    rows, queries = rows.where(F.size("patches") > 0), queries.where(F.size("patches") > 0)
    rows = rows.select(F.col("shot_no").cast("long").alias("shot_no"), "at", "l_t", "feature", "patches")
    queries = queries.select(F.col("shot_no").cast("long").alias("of"), "feature", "patches")
    return rows.groupBy("shot_no").cogroup(queries.groupBy("of")).applyInArrow(task, "shot_no long, at double, l_t double, cosine double, stacked double, per_frame double")


# ---- candidate windows of the evidence ------------------------------------------------------


def candidate_windows(spans: DataFrame, pool: DataFrame, gap: float = 8.0) -> DataFrame:
    """(shot_no, mid, a, b): evidence spans and runs of the most similar rows, one window for each tenth of a second.

    ``spans`` has shot_no, place, start, end: of spans with one middle the last place stays.  ``pool`` has shot_no, t, sim: its
    runs in similarity order (steps up to ``gap``) join where no span has their middle, of alike ones the first.
    """
    mid = lambda a: F.round(a, 1).alias("mid")
    own = spans.select("shot_no", mid((F.col("start") + F.col("end")) / 2), F.lit(0).alias("_kind"), (-F.col("place")).cast("long").alias("_place"), F.col("start").alias("a"), F.col("end").alias("b"))
    runs = similarity_runs(pool.select("shot_no", "t", "sim"), ["shot_no"], gap)
    runs = runs.groupBy("shot_no", "run").agg(mid(F.avg("t")), F.min("t").alias("a"), (F.max("t") + 1.0).alias("b"))
    every = own.unionByName(runs.select("shot_no", "mid", F.lit(1).alias("_kind"), F.col("run").cast("long").alias("_place"), "a", "b"))
    return topk_per_key(every, ["shot_no", "mid"], ["_kind", "_place"], 1).select("shot_no", "mid", "a", "b")


def ambiguous(best: Column, second: Column, montage: Column, lead: float = 0.10, sure: float = 0.60) -> Column:
    """Is a second look worth it: close rivals, a montage or a weak best span?  ``second`` is null without a rival."""
    return F.coalesce(best - second < lead, F.lit(False)) | F.coalesce(montage, F.lit(False)) | F.coalesce(best < sure, F.lit(False))


def patch_rerank(mains: DataFrame, spans: DataFrame, pool: DataFrame, queries: DataFrame, frames: DataFrame, near: float = 8.0, width: float = 2.0, best: int = BEST) -> DataFrame:
    """Per ambiguous shot the window whose middle frame matches best by patches: (shot_no, mid, score, start, end, moved).

    ``mains`` has shot_no, start, end (null: none, counts as 0) and montage; ``spans`` shot_no, place, start, end, sim; ``queries`` the
    shots' representatives.  Shots that are clear and have one window at most give no row; a
    window within ``near`` of the main one's middle moves nothing.
    """
    windows = reliable(candidate_windows(spans, pool))
    sims = spans.groupBy("shot_no").agg(F.sort_array(F.collect_list(F.coalesce("sim", F.lit(0.0))), asc=False).alias("_s"))
    size = windows.groupBy("shot_no").agg(F.count("*").alias("_n"))
    asked = mains.join(sims, "shot_no", "left").join(size, "shot_no")
    asked = asked.where(ambiguous(F.get("_s", F.lit(0)), F.get("_s", F.lit(1)), F.col("montage")) | (F.col("_n") > 1))
    asks = windows.join(asked.select("shot_no", ((F.coalesce("start", F.lit(0.0)) + F.coalesce("end", F.lit(0.0))) / 2).alias("_now")), "shot_no").withColumn("at", (F.col("a") + F.col("b")) / 2)
    got = asks.join(late_scores(queries, asks, frames, best), ["shot_no", "at"])
    top = topk_per_key(got, ["shot_no"], [F.desc("stacked"), "mid"], 1)
    return top.select(
        "shot_no", "mid", F.col("stacked").alias("score"), F.round(F.col("mid") - width / 2, 2).alias("start"), F.round(F.col("mid") + width / 2, 2).alias("end"),
        (F.abs(F.col("mid") - F.col("_now")) > max(8.0, near)).alias("moved"),
    )


# ---- rescue beside the main place -----------------------------------------------------------


def nearfield_rescue(mains: DataFrame, queries: DataFrame, frames: DataFrame, radius: float = 30.0, stride: float = 4.0, margin: float = 0.075, least_width: float = 0.6, best: int = BEST) -> DataFrame:
    """The best place of an even grid around each main span: (shot_no, at, margin, start, end, moved).

    ``mains`` has shot_no, start, end, q_start, q_end.  Taken when it leads the main place's own score by more than ``margin``; of
    equal places the first.  Shots under ``least_width`` seconds give no row.
    """
    half = int(radius // stride)
    now = mains.where(F.col("q_end") - F.col("q_start") >= least_width).select("shot_no", ((F.col("start") + F.col("end")) / 2).alias("now")).where("now is not null")
    grid = now.withColumn("at", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.greatest(F.lit(0.0), F.round(F.col("now") + k * stride, 2)))))
    scores = late_scores(queries, grid.select("shot_no", "at").unionByName(now.select("shot_no", F.col("now").alias("at"))), frames, best)
    scores = reliable(scores.select("shot_no", "at", F.col("stacked").alias("score")))
    top = topk_per_key(grid.distinct().join(scores, ["shot_no", "at"]), ["shot_no"], [F.desc("score"), "at"], 1)
    out = top.join(scores.select("shot_no", F.col("at").alias("now"), F.col("score").alias("_main")), ["shot_no", "now"])
    lead = F.round(F.col("score") - F.col("_main"), DIGITS)
    return out.select("shot_no", "at", lead.alias("margin"), F.round(F.col("at") - 1, 2).alias("start"), F.round(F.col("at") + 1, 2).alias("end"), ((lead > margin) & (F.abs(F.col("at") - F.col("now")) <= radius)).alias("moved"))


# ---- refinement of several candidates --------------------------------------------------------


def spaced_candidates(centres: DataFrame, library: DataFrame, k: int = 5, apart: float = 3.0) -> DataFrame:
    """(shot_no, place, t, sim): per shot the k most similar library rows that lie ``apart`` from each other, greedily.

    Each pick silences at most as many rows as the library's densest stretch of three buckets of ``apart`` has, so the best
    (k - 1) x that number + 1 rows of the exact top k hold all picks.
    """
    cells = library.where("feature is not null and t is not null").groupBy(F.floor(F.col("t") / apart).alias("b")).agg(F.count("*").alias("n"))
    around = cells.select(F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "n").groupBy("b").agg(F.sum("n").alias("n"))
    most = around.agg(F.max("n").alias("n")).first()["n"] or 0
    hits = top_k(centres, library, (k - 1) * most + 1).select("shot_no", F.col("l_t").alias("t"), "sim")
    return fold(hits, ["shot_no"], ["t"], lambda rows: [{**r, "place": i} for i, r in enumerate(spaced_best(rows, k, apart))], "place int")


def evaluated(mains: DataFrame, candidates: DataFrame, clear: float = 0.03, most: int = 6) -> DataFrame:
    """(shot_no, now, is_clear, place, mid): the middles to look at, in order.

    ``candidates`` is the spaced list.  A shot is clear when its first candidate lies within 2 s of the main middle and leads the second by ``clear``: then only
    the first two and the main middle are looked at.  The main middle goes first where no candidate lies within 0.5 s of it.
    """
    listed = candidates.groupBy("shot_no").agg(F.array_sort(F.collect_list(F.struct("place", "t", "sim"))).alias("_c"))
    rows = mains.select("shot_no", ((F.col("start") + F.col("end")) / 2).alias("now")).where("now is not null").join(listed, "shot_no", "left")
    rows = rows.withColumn("_c", F.coalesce("_c", F.array().cast(listed.schema["_c"].dataType)))
    first, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    is_clear = F.coalesce((F.abs(first["t"] - F.col("now")) <= 2.0) & (F.round(first["sim"] - F.coalesce(second["sim"], F.lit(0.0)), DIGITS) >= clear), F.lit(False))
    mids = F.transform("_c", lambda c: c["t"])
    mids = F.when(F.forall(mids, lambda m: F.abs(m - F.col("now")) >= 0.5), F.concat(F.array("now"), mids)).otherwise(mids)
    rows = rows.withColumn("is_clear", is_clear).withColumn("_m", mids)
    few = F.array_compact(F.array(F.get("_m", F.lit(0)), F.get("_m", F.lit(1)), F.col("now")))
    rows = rows.withColumn("_m", F.array_distinct(F.when(F.col("is_clear"), few).otherwise(F.slice("_m", 1, most))))
    return rows.select("shot_no", "now", "is_clear", F.posexplode("_m").alias("place", "mid"))


def window_grid(mids: DataFrame, radius: float, per_second: float = 1.0, least: int = 6, end: float | None = None) -> DataFrame:
    """``mids`` with one row per block centre ``at`` of [mid - radius, mid + radius], cut at 0 and at ``end``."""
    lo, hi = F.greatest(F.lit(0.0), F.col("mid") - radius), F.col("mid") + radius
    rows = mids.withColumn("_lo", lo).withColumn("_hi", hi if end is None else F.least(hi, F.lit(end))).where("_hi > _lo")
    rows = rows.withColumn("_n", F.greatest(F.lit(least), F.floor((F.col("_hi") - F.col("_lo")) * per_second).cast("int")))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("at", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_i") + 0.5) / F.col("_n")).drop("_lo", "_hi", "_n", "_i")


def vote(places: DataFrame, queries: DataFrame, library: DataFrame, tolerance: float = 1.0, width: float = WIDTH) -> DataFrame:
    """(shot_no, mid, vote): mean over the query frames of the best cosine where each would lie if the shot's middle lay at ``mid``.

    ``places`` has shot_no, mid, q_mid; ``queries`` shot_no, i, at, feature.  Frames without a library row within the tolerance do
    not count; without any the vote is 0.
    """
    want = places.join(queries.select("shot_no", "i", F.col("at").alias("_q"), F.col("feature").alias("_f")), "shot_no").withColumn("_at", F.col("_q") + F.col("mid") - F.col("q_mid"))
    want = want.select("shot_no", "mid", "i", "_f", (F.col("_at") - tolerance).alias("_lo"), (F.col("_at") + tolerance).alias("_hi"))
    met = range_join(library.select(F.col("t").cast("double").alias("_t"), "feature"), want, [], "_t", "_lo", "_hi", width)
    each = met.groupBy("shot_no", "mid", "i").agg(F.max(F.round(cosine("feature", "_f"), DIGITS)).alias("_s"))
    return places.join(each.groupBy("shot_no", "mid").agg(F.avg("_s").alias("_v")), ["shot_no", "mid"], "left").select("shot_no", "mid", F.coalesce("_v", F.lit(0.0)).alias("vote"))


def switched(lead: Column, vote_lead: Column, margin: float = 0.05, vote_margin: float = 0.05) -> Column:
    """A strong lead switches by itself, half of it only where the vote agrees."""
    return (lead >= margin) | ((lead >= margin / 2) & (vote_lead >= vote_margin))


def patch_refine(mains: DataFrame, queries: DataFrame, library: DataFrame, frames: DataFrame, k: int = 5, radius: float = 5.0, end: float | None = None, best: int = BEST) -> DataFrame:
    """Several candidates of each shot looked at closely: (shot_no, now, mid, lead, vote_lead, moved, start, end).

    ``mains`` has shot_no, start, end, q_start, q_end; ``queries`` the shots' representatives (shot_no, i, at, feature, patches).  A moved shot's new span is as
    wide as the shot; its old one is the first of its sub spans.  Shots whose main place has no score give no row.
    """
    mains = mains.where((F.col("end") - F.col("start") > 0.01) & (F.col("q_end") - F.col("q_start") > 0.01))
    mids = evaluated(mains, spaced_candidates(centroids(queries, ["shot_no"], out="feature").withColumn("t", F.lit(0.0)), library, k))
    grid = reliable(window_grid(mids, radius, end=end))
    scores = grid.join(late_scores(queries, grid, frames, best), ["shot_no", "at"])
    scores = scores.withColumn("_s", F.round(GLOBAL * F.col("cosine") + PATCH * F.col("per_frame"), DIGITS)).groupBy("shot_no", "now", "place", "mid").agg(F.max("_s").alias("score"))
    scores = reliable(scores)
    top = topk_per_key(scores, ["shot_no"], [F.desc("score"), "place"], 1).select("shot_no", "now", "mid", "score")
    main = topk_per_key(scores.where(F.abs(F.col("mid") - F.col("now")) <= 0.5), ["shot_no"], [F.desc("place")], 1).select("shot_no", F.col("score").alias("_main"))
    out = reliable(top.join(main, "shot_no").join(mains.select("shot_no", "q_start", "q_end"), "shot_no"))
    q_mid = ((F.col("q_start") + F.col("q_end")) / 2).alias("q_mid")
    votes = reliable(vote(out.select("shot_no", F.explode(F.array_distinct(F.array("mid", "now"))).alias("mid"), q_mid), queries, library))
    out = out.join(votes, ["shot_no", "mid"]).join(votes.select("shot_no", F.col("mid").alias("now"), F.col("vote").alias("_now")), ["shot_no", "now"])
    lead, vote_lead = F.round(F.col("score") - F.col("_main"), DIGITS), F.round(F.col("vote") - F.col("_now"), DIGITS)
    half = (F.col("q_end") - F.col("q_start")) / 2
    moved = switched(lead, vote_lead) & (F.abs(F.col("mid") - F.col("now")) > 0.5)
    return out.select("shot_no", "now", "mid", lead.alias("lead"), vote_lead.alias("vote_lead"), moved.alias("moved"), F.round(F.col("mid") - half, 3).alias("start"), F.round(F.col("mid") + half, 3).alias("end"))
