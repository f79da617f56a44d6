"""Evidence clusters, fine localisation, candidates and offset votes (all declarative)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import cosine
from splicefind.operators.asof import range_join
from splicefind.operators.retrieval import topk_per_key
from splicefind.operators.timeseries import gap_clusters, over, runs, smoothed3


def evidence_clusters(hits: DataFrame, gap: float = 15.0, least_rows: int = 2, least_sim: float = 0.40) -> DataFrame:
    """Gap clusters of each shot's best hits: (shot_no, cluster_no, start, end, n, mean_sim) of the significant ones.

    ``hits`` has shot_no, q_t, l_t, sim, one row per query row.
    """
    c = gap_clusters(hits, ["shot_no"], "l_t", gap, ["q_t"])
    spans = c.groupBy("shot_no", "cluster_no").agg(F.min("l_t").alias("start"), F.max("l_t").alias("end"), F.count("*").alias("n"), F.avg("sim").alias("mean_sim"))
    return spans.where((F.col("n") >= least_rows) & (F.col("mean_sim") >= least_sim))


def evidence_mode(clusters: DataFrame, shots: DataFrame) -> DataFrame:
    """Per shot: clusters kept, rows they hold, their share of the shot's rows, dispersion of means and the mode."""
    per = clusters.groupBy("shot_no").agg(F.count("*").alias("n_strong"), F.sum("n").alias("rows_in"), F.stddev_pop("mean_sim").alias("dispersion"))
    out = shots.groupBy("shot_no").agg(F.count("*").alias("nq")).join(per, "shot_no", "left")
    n = F.coalesce("n_strong", F.lit(0))
    mode = F.when(n >= 2, "montage").when(n == 1, "clean").otherwise("empty")
    return out.select("shot_no", "nq", n.cast("long").alias("n_strong"), (F.coalesce("rows_in", F.lit(0)) / F.col("nq")).alias("qcov"), F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), mode.alias("mode"))


def window_cover(spans: DataFrame, queries: DataFrame, library: DataFrame, keys: list[str], start: str = "start", end: str = "end", pad: float = 15.0, feature: str = "feature") -> DataFrame:
    """(keys, t, cover): each library row of a padded span with its best similarity to the shot's query rows."""
    wide = spans.select(*keys, F.greatest(F.lit(0.0), F.col(start) - pad).alias("lo"), (F.col(end) + pad).alias("hi"))
    rows = range_join(library.select(F.col("t").cast("double").alias("t"), F.col(feature).alias("_f")), wide, [], "t", "lo", "hi", max(4 * pad, 1.0))
    shots = queries.groupBy("shot_no").agg(F.collect_list(feature).alias("_qs"))
    best = F.array_max(F.transform("_qs", lambda q: cosine(q, "_f")))
    return rows.join(shots, "shot_no").select(*keys, "t", "lo", "hi", F.round(best, 9).alias("cover"))


def coverage_runs(cover: DataFrame, keys: list[str], least: float = 0.4, rows: int = 2, island_gap: float = 5.0, full_s: float = 4.0, tight_s: float = 15.0) -> DataFrame:
    """Fine localisation of each span from its cover series: longest run, its quality and all run statistics."""
    c = cover.withColumn("cs", F.round(smoothed3("cover", keys, "t"), 9))
    c = c.withColumn("flag", F.col("cs") >= least)
    totals = c.groupBy(*keys).agg(F.avg(F.col("flag").cast("double")).alias("best_cover"), (F.max("hi") - F.max("lo")).alias("window_s"))
    r = runs(c, keys, "t", "flag").groupBy(*keys, "run").agg(
        F.min("t").alias("run_start"), F.max("t").alias("run_end"), F.count("*").alias("len"), F.avg("cs").alias("mean_sim"), F.max("cover").alias("peak_sim"), F.max_by("t", F.struct("cs", -F.col("t"))).alias("peak_t")
    )
    w = over(keys, "run")
    strong = F.col("len") >= rows
    before = F.last(F.when(strong, F.col("run_end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("gap", F.col("run_start") - F.lag("run_end").over(w)).withColumn("island", strong & F.coalesce(F.col("run_start") - before >= island_gap, F.lit(False)))
    stats = r.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum(strong.cast("long")).alias("n_significant"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("largest_gap"), F.max("island").alias("multi_island"), F.sum("len").alias("covered"))
    best = topk_per_key(r, keys, [F.desc("len"), "run_start"], 1).drop("rank", "run", "gap", "island")
    run_s = F.col("run_end") - F.col("run_start")
    penalty = F.when(F.col("multi_island") | (F.col("len") <= 1), 0.25).otherwise(1.0)
    out = best.join(stats, keys).join(totals, keys)
    return out.select(
        *keys, "best_cover", "n_runs", "n_significant", "largest_gap", "multi_island", "run_start", "run_end", F.col("len").alias("run_len"), "mean_sim", "peak_sim",
        (F.col("len") / F.col("covered")).alias("coverage_quality"), (run_s / F.col("window_s")).alias("span_coverage"), (F.least(run_s / full_s, F.lit(1.0)) * penalty).alias("stability"),
        F.greatest(F.col("run_start"), F.col("peak_t") - tight_s / 2).alias("tight_start"), F.least(F.col("run_end"), F.col("peak_t") + tight_s / 2).alias("tight_end"),
    )


def candidate_metrics(hits: DataFrame, keys: list[str], floor: float = 0.38, scene_gap: float = 10.0, alpha: float = 0.5) -> DataFrame:
    """Metrics and score of each cluster of hits: representatives are the best hit of each query row."""
    reps = topk_per_key(hits, [*keys, "q_t"], [F.desc("sim"), "l_t"], 1, "_r")
    w = over(keys, "q_t")
    reps = reps.withColumn("_up", (F.col("l_t") >= F.lag("l_t").over(w) - 1e-6).cast("double"))
    per_rep = reps.groupBy(*keys).agg(F.count("*").alias("n_reps"), F.coalesce(F.avg("_up"), F.lit(1.0)).alias("consistency"), F.avg((F.col("sim") >= floor).cast("double")).alias("qcov"))
    steps = hits.withColumn("_far", (F.col("l_t") - F.lag("l_t").over(over(keys, ["l_t", "q_t"])) > scene_gap).cast("long"))
    per = steps.groupBy(*keys).agg(
        F.min("l_t").alias("start"), F.max("l_t").alias("end"), F.max("sim").alias("peak_sim"), F.avg("sim").alias("mean_sim"), F.count("*").alias("hit_count"), F.stddev_pop("sim").alias("sim_std"), (F.coalesce(F.sum("_far"), F.lit(0)) + 1).alias("scene_div")
    )
    score = F.col("mean_sim") * F.sqrt("hit_count") * (0.5 + 0.5 * F.col("consistency")) * F.pow("n_reps", F.lit(alpha))
    return per.join(per_rep, keys).withColumn("rank_score", score)


def offset_vote(hits: DataFrame, bucket: float = 0.05, around: int = 1, weight: str = "sim") -> DataFrame:
    """Per shot: the weighted centroid of the fullest offset bucket and its neighbours, support and spread.

    ``hits`` has one row per query row; the projection is l_t - (q_t - first q_t).
    """
    first = F.min("q_t").over(W.partitionBy("shot_no"))
    votes = hits.withColumn("proj", F.col("l_t") - (F.col("q_t") - first)).withColumn("bucket", F.bround(F.col("proj") / bucket).cast("long"))
    sums = votes.groupBy("shot_no", "bucket").agg(F.round(F.sum(weight), 9).alias("w"))
    best = topk_per_key(sums, ["shot_no"], [F.desc("w"), "bucket"], 1).select("shot_no", F.col("bucket").alias("best"))
    near = F.abs(F.col("bucket") - F.col("best")) <= around
    v = votes.join(best, "shot_no").withColumn("_w", F.when(near, F.col(weight)))
    out = v.groupBy("shot_no", "best").agg(
        (F.sum(F.col("_w") * F.col("proj")) / F.sum("_w")).alias("seed"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("proj") * F.col("proj")).alias("_sq"),
        (F.count("_w") / F.count("*")).alias("support"), F.count("_w").alias("votes_in"), F.count("*").alias("votes"), F.collect_list("proj").alias("_projs"),
    )
    wide = F.size(F.filter("_projs", lambda p: F.abs(p - F.col("seed")) <= 1.5)) / F.col("votes")
    return out.select("shot_no", F.col("best").alias("bucket"), "seed", "support", "votes_in", "votes", F.sqrt(F.greatest(F.col("_sq") / F.col("_sw") - F.col("seed") * F.col("seed"), F.lit(0.0))).alias("spread"), wide.alias("wide_support"))


def vote_verdict(votes: DataFrame, current: DataFrame, duration: float, least_rows: int = 2, support: float = 0.2, most_shift: float = 4.0) -> DataFrame:
    """Accept a seed or name the first gate that rejects it; ``current`` has shot_no and start."""
    v = votes.join(current, "shot_no")
    reason = (
        F.when(F.col("votes") < least_rows, "few_rows").when(F.col("support") < support, "low_support").when(F.abs(F.col("seed") - F.col("start")) > most_shift, "large_shift")
        .when((F.col("seed") < 0) | (F.col("seed") > duration), "out_of_range").otherwise("accepted")
    )
    return v.withColumn("reason", reason).withColumn("new_start", F.when(F.col("reason") == "accepted", F.col("seed")).otherwise(F.col("start")))


def global_anchor(votes: DataFrame, duration: float, least_rows: int = 2, support: float = 0.1, wide: float = 0.5, most_spread: float | None = None) -> DataFrame:
    """The global anchor's gates: rows, support, votes, wide support, optional spread, range; no cap on the move."""
    spread = F.lit(False) if most_spread is None else F.col("spread") > most_spread
    reason = (
        F.when(F.col("votes") < least_rows, "few_rows").when(F.col("support") < support, "low_support").when(F.col("votes_in") < 1, "no_votes").when(F.col("wide_support") < wide, "narrow")
        .when(spread, "spread").when((F.col("seed") < 0) | (F.col("seed") > duration), "out_of_range").otherwise("accepted")
    )
    return votes.withColumn("reason", reason)


def quality_weights(df: DataFrame, keys: list[str], channels: dict[str, float], least: float = 0.2) -> DataFrame:
    """Add weight: per-series min-max of each channel (constant channels 1), weighted sum, clipped to [least, 1]."""
    w = W.partitionBy(*keys)
    total = F.lit(0.0)
    for name, share in channels.items():
        lo, hi = F.min(name).over(w), F.max(name).over(w)
        total = total + share * F.when(hi > lo, (F.col(name) - lo) / (hi - lo)).otherwise(1.0)
    return df.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(least), total)))


def near_scenes(scenes: DataFrame, most_apart: float = 60.0, least: float = 0.60, feature: str = "feature") -> DataFrame:
    """Edges (a, b) between scenes whose centres are close in time and whose vectors are alike."""
    s = scenes.withColumn("_c", (F.col("start") + F.col("end")) / 2)
    cell = F.floor(F.col("_c") / most_apart)
    a = s.select(F.col("scene_no").alias("a"), F.col("_c").alias("ca"), F.col(feature).alias("fa"), cell.alias("_b"))
    b = s.select(F.col("scene_no").alias("b"), F.col("_c").alias("cb"), F.col(feature).alias("fb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_b"))
    met = a.join(b, "_b").where((F.col("a") < F.col("b")) & (F.abs(F.col("ca") - F.col("cb")) <= most_apart))
    return met.where(F.round(cosine("fa", "fb"), 9) >= least).select("a", "b")
