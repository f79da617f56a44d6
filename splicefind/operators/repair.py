"""Re-ranking and repair operators: places of best similarity, pools, projections, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.operators.asof import nearest, range_join
from splicefind.operators.components import reliable
from splicefind.operators.retrieval import nearest_apart, top_k, topk_per_key
from splicefind.operators.suppress import numbered_rows
from splicefind.operators.timeseries import by_ranges, over


def best_window(sims: DataFrame, keys: list[str], rows: int, width: float, t: str = "t", sim: str = "sim") -> DataFrame:
    """Start of the ``rows`` consecutive rows with the best mean similarity; blocks over width + 2 s are skipped, first wins."""
    w = over(keys, t).rowsBetween(0, rows - 1)
    got = sims.withColumn("_m", F.round(F.avg(sim).over(w), 9)).withColumn("_n", F.count("*").over(w)).withColumn("_e", F.max(t).over(w))
    got = got.where((F.col("_n") == rows) & (F.col("_e") - F.col(t) <= width + 2))
    return topk_per_key(got, keys, [F.desc("_m"), t], 1).select(*keys, F.col(t).alias("start"), (F.col(t) + width).alias("end"), F.col("_m").alias("mean_sim"))


def span_mean(spans: DataFrame, sims: DataFrame, keys: list[str], row: str, width: float, t: str = "t", sim: str = "sim") -> DataFrame:
    """Mean similarity of the rows in each closed span; null without any."""
    met = range_join(sims.select(*keys, t, sim), spans, keys, t, "start", "end", width).groupBy(*keys, row).agg(F.avg(sim).alias("mean_sim"))
    return spans.join(met, [*keys, row], "left")


def aligned_max(wanted: DataFrame, sims: DataFrame, keys: list[str], row: str, at: str, tolerance: float, t: str = "t", sim: str = "sim") -> DataFrame:
    """For each wanted position the largest similarity within +-tolerance, 0 without one."""
    spans = wanted.withColumn("_lo", F.col(at) - tolerance).withColumn("_hi", F.col(at) + tolerance)
    met = range_join(sims.select(*keys, F.col(t).alias("_t"), sim), spans, keys, "_t", "_lo", "_hi", max(4 * tolerance, 1.0)).groupBy(*keys, row).agg(F.max(sim).alias("best"))
    return wanted.join(met, [*keys, row], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def start_shift(curve: DataFrame, keys: list[str], current: str, band: float = 0.03, gain: float = 0.04, most: float = 2.0, t: str = "t", score: str = "score") -> DataFrame:
    """Per series the start to take: of positions within ``band`` of the best the one nearest to the current (earlier on ties).

    Accepted for a gain of at least ``gain`` over the current place and a move of at most ``most``.
    ``curve`` has keys, current, t, score.
    """
    rows = curve.withColumn("_top", F.max(score).over(W.partitionBy(*keys))).withColumn("_d", F.abs(F.col(t) - F.col(current)))
    now = topk_per_key(rows, keys, ["_d", t], 1).select(*keys, F.col(score).alias("now"))
    pick = topk_per_key(rows.where(F.col(score) >= F.col("_top") - band), keys, ["_d", t], 1).select(*keys, current, F.col(t).alias("best_t"), F.col(score).alias("best"))
    out = pick.join(now, keys)
    ok = (F.col("best") - F.col("now") >= gain) & (F.abs(F.col("best_t") - F.col(current)) <= most)
    return out.withColumn("new_start", F.when(ok, F.col("best_t")).otherwise(F.col(current)))


def coarse_skip(gain: Column, move: Column, least: float = 0.04, most: float = 2.0) -> Column:
    """A coarse pass shows that a dense one cannot pay."""
    return (gain < 0.5 * least) & (F.abs(move) <= most)


def pool_frames(centroids: DataFrame, scenes: DataFrame, frames: DataFrame, best: int = 5, budget: int = 120, gate: float = 0.40) -> DataFrame:
    """Library frames of each shot's most similar scenes, up to a running budget: (shot_no, scene_no, rank, sim, t).

    ``centroids`` has shot_no, t, feature; ``scenes`` scene_no, start, end, feature (half open).  Scenes
    below ``gate`` are left out; frames past the budget are thinned evenly within the scene that meets it.
    """
    hit = top_k(centroids, scenes.withColumn("t", F.col("scene_no").cast("double")), best).where(F.col("sim") >= gate)
    hit = hit.select("shot_no", F.col("l_t").cast("long").alias("scene_no"), "rank", "sim")
    rows = range_join(frames.select("t"), scenes.select("scene_no", "start", "end"), [], "t", "start", "end", 60.0, closed=False)
    size = rows.groupBy("scene_no").agg(F.count("*").alias("n"))
    plan = hit.join(size, "scene_no").withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("shot_no").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = plan.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("n"), budget - F.col("_before"))))
    numbered = rows.withColumn("_i", F.row_number().over(W.partitionBy("scene_no").orderBy("t")) - 1)
    met = plan.where("_take > 0").join(numbered.select("scene_no", "t", "_i"), "scene_no")
    # the k-th of m evenly spaced rows of n is int(k (n - 1) / (m - 1))
    step = F.when(F.col("_take") > 1, (F.col("n") - 1) / (F.col("_take") - 1))
    k = F.ceil(F.col("_i") / step - 1e-9)
    even = F.when(F.col("_take") == F.col("n"), True).when(F.col("_take") == 1, F.col("_i") == 0).otherwise((k < F.col("_take")) & (F.floor(k * step + 1e-9) == F.col("_i")))
    return met.where(even).select("shot_no", "scene_no", "rank", "sim", "t")


def uniqueness(df: DataFrame, keys: list[str], order: str, radius: int = 1, feature: str = "feature", width: float = 4096.0) -> DataFrame:
    """How alike the nearest other neighbourhood is: the largest cosine of +-radius blocks that do not overlap (keys, order, nearest).

    Neighbourhoods are built on ranges of ``width`` of the order.
    """
    def local(rows: DataFrame, part: list[str]) -> DataFrame:
        w = over(part, order).rowsBetween(-radius, radius)
        return rows.withColumn("_hood", F.flatten(F.collect_list(feature).over(w))).withColumn("_rows", F.count("*").over(w))

    rows = by_ranges(numbered_rows(df.select(*keys, order, feature), keys, order, width, "_place"), keys, order, width, radius, local)
    rows = reliable(rows.where(F.col("_rows") == 2 * radius + 1).select(*keys, order, "_place", "_hood"))
    met = nearest_apart(rows, keys, "_place", 2 * radius, "_hood")
    return rows.drop("_hood").join(met, [*keys, "_place"]).select(*keys, order, "nearest")


def rank_of_truth(ranked: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Best rank (1 first, ties share) that a true row has in each group; null without one."""
    r = ranked.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(F.desc(score))))
    return r.groupBy(*keys).agg(F.min(F.when(F.col(truth), F.col("_r"))).alias("best_rank"))


def cross_cut(distances: DataFrame, keys: list[str], least: float = 0.5, rows: int = 3) -> DataFrame:
    """Largest lag distance of each shot, its time and how many pass ``least``; null for shots of under ``rows`` rows."""
    d = distances.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("distance").alias("peak"), F.min_by("t", F.struct(-F.col("distance"), "t")).alias("at"), F.sum((F.col("distance") > least).cast("long")).alias("cuts"))
    ok = F.col("_n") >= rows - 1
    return d.select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("peak", "at", "cuts")])


def promote_anchor(main: DataFrame, subs: DataFrame, key: str, least: float = 0.35, lead: float = 0.15) -> DataFrame:
    """The sub span with the best text similarity replaces the main one when it reaches ``least`` and leads by ``lead``.

    ``main`` has key, start, end, text_sim; ``subs`` also pool (true for recall pools, which never promote).
    """
    best = topk_per_key(subs.where("not pool"), [key], [F.desc("text_sim"), "start"], 1).select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text_sim").alias("_x"))
    out = main.join(best, key, "left")
    ok = F.coalesce((F.col("_x") >= least) & (F.col("_x") >= F.col("text_sim") + lead), F.lit(False))
    return out.select(key, F.when(ok, F.col("_s")).otherwise(F.col("start")).alias("start"), F.when(ok, F.col("_e")).otherwise(F.col("end")).alias("end"), ok.alias("promoted"))


def change_score(df: DataFrame, keys: list[str], order: str, hist: str = "hist", gray: str = "gray") -> DataFrame:
    """Half the L1 of consecutive histograms plus half the mean absolute pixel change (of 255)."""
    w = over(keys, order)
    rows = df.withColumn("_h", F.lag(hist).over(w)).withColumn("_g", F.lag(gray).over(w)).where("_h is not null")
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("score", 0.5 * gap(hist, "_h") + 0.5 * gap(gray, "_g") / F.greatest(F.size(gray), F.lit(1)) / 255).drop("_h", "_g")


def least_duration(segments: DataFrame, marks: DataFrame, keys: list[str], margin: float = 0.2, usual: float = 0.5, marked: float = 1.0) -> DataFrame:
    """Add least_s: ``marked`` where a mark lies within the segment +-margin, else ``usual``."""
    mid = segments.withColumn("_m", (F.col("start") + F.col("end")) / 2)
    near = nearest(mid, marks.select(*keys, F.col("mark").alias("_k")), keys, "_m", "_k", [])
    hit = F.abs(F.col("match.at") - F.col("_m")) <= (F.col("end") - F.col("start")) / 2 + margin
    return near.withColumn("least_s", F.when(F.coalesce(hit, F.lit(False)), marked).otherwise(usual)).drop("match", "_m")


def project_children(parents: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """Children of each parent (key, q_start, q_end, start, end) at its cut times, projected one to one.

    Adds child, and keeps the parent's spans as parent_start, parent_end.
    """
    c = cuts.groupBy(key).agg(F.array_sort(F.collect_set("cut")).alias("_c"))
    p = parents.join(c, key, "left")
    inside = F.filter(F.coalesce("_c", F.array().cast("array<double>")), lambda x: (x > F.col("q_start")) & (x < F.col("q_end")))
    edges = F.concat(F.array("q_start"), inside, F.array("q_end"))
    p = p.withColumn("_e", edges).withColumn("child", F.explode(F.sequence(F.lit(0), F.size("_e") - 2)))
    a, b = F.get("_e", F.col("child")), F.get("_e", F.col("child") + 1)
    return p.select(key, "child", a.alias("q_start"), b.alias("q_end"), (F.col("start") + (a - F.col("q_start"))).alias("start"), (F.col("start") + (b - F.col("q_start"))).alias("end"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))


def median_offset(df: DataFrame, keys: list[str], offset: str, near: float = 1.5) -> DataFrame:
    """Median of the offsets and the share within +-near of it."""
    m = df.groupBy(*keys).agg(F.percentile(offset, F.lit(0.5)).alias("offset"), F.collect_list(offset).alias("_o"))
    return m.withColumn("agree", F.size(F.filter("_o", lambda x: F.abs(x - F.col("offset")) <= near)) / F.size("_o")).drop("_o")


def identity_verdict(similarity: Column, faces_a: Column, faces_b: Column, centre: float = 0.51, band: float = 0.10) -> Column:
    """same or different outside the band around the centre, with one face on each side; else unknown."""
    sure = (faces_a == 1) & (faces_b == 1) & (F.abs(similarity - centre) > band)
    return F.when(~F.coalesce(sure, F.lit(False)), "unknown").when(similarity > centre, "same").otherwise("different")


def pick_by_score(candidates: DataFrame, key: str, margin: float = 0.05, weak_margin: float = 0.025, vote_margin: float = 0.05) -> DataFrame:
    """Best other candidate (key, start, main, global_sim, patch_sim, vote): switch when 0.45 global + 0.55 patch leads enough."""
    rows = candidates.withColumn("score", 0.45 * F.col("global_sim") + 0.55 * F.col("patch_sim"))
    main = rows.where("main").select(key, F.col("start").alias("main_start"), F.col("score").alias("main_score"), F.col("vote").alias("main_vote"))
    other = topk_per_key(rows.where("not main"), [key], [F.desc("score"), "start"], 1).select(key, F.col("start").alias("other_start"), F.col("score").alias("other_score"), F.col("vote").alias("other_vote"))
    out = main.join(other, key, "left")
    lead = F.col("other_score") - F.col("main_score")
    switch = F.coalesce((lead >= margin) | ((lead >= weak_margin) & (F.col("other_vote") - F.col("main_vote") >= vote_margin)), F.lit(False))
    return out.select(key, F.when(switch, F.col("other_start")).otherwise(F.col("main_start")).alias("start"), switch.alias("switched"))
