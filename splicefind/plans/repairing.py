"""Registered queries over repair operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.functions import scalars
from splicefind.functions import vectors as V
from splicefind.operators import grading, repair, retrieval
from splicefind.operators import timeseries as ts
from splicefind.plans import fixtures as fx
from splicefind.plans.editing import _SHOT, _shots


def relocated(spark, d):
    return retrieval.best_windows(fx.shots(spark, d), fx.library(spark, d), 4, 4.0).withColumn("mean_sim", F.round("mean_sim", 6))


def span_means(spark, d):
    s = fx.spans(spark, d).select("shot_no", F.col("cluster_no").cast("long").alias("cluster_no"), "start", "end")
    sims = retrieval.window_sims(s, fx.shots(spark, d), fx.library(spark, d), "start", "end", 30.0)
    return repair.span_mean(s, sims, ["shot_no"], "cluster_no", 30.0).select("shot_no", "cluster_no", F.round("mean_sim", 6).alias("mean_sim"))


def aligned_scores(spark, d):
    want = fx.shots(spark, d).select("shot_no", F.col("t").alias("q"), (F.col("t") * 7 % 450.0 + 0.5).alias("at")).distinct()
    near = want.select("shot_no", (F.col("at") - 1.5).alias("lo"), (F.col("at") + 1.5).alias("hi"))
    sims = retrieval.window_sims(near, fx.shots(spark, d), fx.library(spark, d), "lo", "hi", 6.0)
    return repair.aligned_max(want, sims, ["shot_no"], "q", "at", 1.5).select("q", scalars.sql_round("best", 6).alias("best"))


def start_shifts(spark, d):
    now = fx.shots(spark, d).select("shot_no", (F.col("shot_no") * 10 + 7.0).alias("current")).distinct()
    near = now.select("shot_no", (F.col("current") - 15).alias("lo"), (F.col("current") + 15).alias("hi"))
    curve = retrieval.window_sims(near, fx.shots(spark, d), fx.library(spark, d), "lo", "hi", 30.0).join(now, "shot_no")
    return repair.start_shift(curve, ["shot_no"], "current", 0.03, 0.01, 10.0, "t", "sim").select("shot_no", "new_start", F.round("best", 6).alias("best"), F.round("now", 6).alias("now"))


def pool_frames(spark, d):
    q = V.centroids(fx.shots(spark, d), ["shot_no"], out="feature").withColumn("t", F.col("shot_no").cast("double"))
    out = repair.pool_frames(q, fx.scenes(spark, d), fx.library(spark, d), 5, 50, -1.0)
    return out.groupBy("shot_no", "scene_no", "rank").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def uniqueness(spark, d):
    rows = fx.library(spark, d).withColumn("k", F.lit(0))
    return repair.uniqueness(rows, ["k"], "t").select("t", F.round("nearest", 6).alias("nearest"))


def truth_ranks(spark, d):
    h = fx.hits(spark, d, 10).withColumn("truth", F.abs(F.col("l_t") - F.col("q_t")) <= 100)
    return repair.rank_of_truth(h, ["shot_no"], "sim", "truth").select("shot_no", "best_rank")


def cross_cuts(spark, d):
    dist = ts.adjacent_distance(fx.shots(spark, d), ["shot_no"]).withColumn("distance", F.round("distance", 9))
    return repair.cross_cut(dist, ["shot_no"], 0.95).select("shot_no", F.round("peak", 6).alias("peak"), "at", "cuts")


def promoted_anchors(spark, d):
    s = _shots(spark, d)
    main = s.select("o_orderkey", "start", "end", F.col("score").alias("text_sim"))
    subs = s.select("o_orderkey", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.round(1 - F.col("score"), 4).alias("text_sim"), (F.col("i") % 3 == 0).alias("pool"))
    return repair.promote_anchor(main, subs, "o_orderkey").select("o_orderkey", F.round("start", 4).alias("start"), "promoted")


def split_children(spark, d):
    s = _shots(spark, d).select("o_orderkey", F.col("i").cast("double").alias("q_start"), (F.col("i") + 4).cast("double").alias("q_end"), "start", "end")
    cuts = s.select("o_orderkey", F.explode(F.array(F.col("q_start") + 1.5, F.col("q_start") + 2.5, F.col("q_end") + 1)).alias("cut"))
    return repair.project_children(s, cuts, "o_orderkey").select("o_orderkey", "child", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def median_offsets(spark, d):
    s = _shots(spark, d).withColumn("off", F.round(F.col("start") - F.col("i") * 100, 2))
    return repair.median_offset(s, ["o_custkey"], "off", 200.0).select("o_custkey", F.round("offset", 4).alias("offset"), F.round("agree", 6).alias("agree"))


def switched_candidates(spark, d):
    s = _shots(spark, d)
    c = s.select("o_custkey", "start", (F.col("i") == 1).alias("main"), "score", F.round(F.pmod(F.col("start") / 13, F.lit(1.0)), 4).alias("p"), F.round(F.pmod(F.col("start") / 17, F.lit(1.0)), 4).alias("vote"))
    return repair.pick_by_score(c.withColumnsRenamed({"score": "global_sim", "p": "patch_sim"}), "o_custkey")


def bounded_spans(spark, d):
    s = _shots(spark, d)
    a, b = grading.bound_span("start", F.col("end") + 10, "score")
    kept, level = grading.moment_gate("score", F.col("i") % 2 == 0, F.lit("high"))
    return s.select("o_orderkey", F.round(a, 4).alias("a"), F.round(b, 4).alias("b"), kept.alias("kept"), level.alias("level"), grading.weak("score", F.col("score") / 2).alias("weak"), repair.identity_verdict(F.col("score"), F.lit(1), (F.col("i") % 3)).alias("verdict"), grading.accept_repair("score", F.lit(0.8)).alias("accepted"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_SIMS = f"{fx.LIB}, {fx.QRY}, sims AS (SELECT q.shot_no, l.t, max(round(list_cosine_similarity(q.f, l.f), 9)) AS sim FROM qry q, lib l GROUP BY ALL)"
SQL = {
    "relocated": f"""WITH {_SIMS}, w AS (SELECT shot_no, t, round(avg(sim) OVER k, 9) AS m, count(*) OVER k AS n, max(t) OVER k AS e FROM sims WINDOW k AS (PARTITION BY shot_no ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), r AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY m DESC, t) AS z FROM w WHERE n = 4 AND e - t <= 6)
SELECT shot_no, t AS start, t + 4 AS "end", round(m, 6) AS mean_sim FROM r WHERE z = 1""",
    "span_means": f"""WITH {fx.SPANS}, sims AS (SELECT q.shot_no, l.t, max(round(list_cosine_similarity(q.f, l.f), 9)) AS sim FROM qry q, lib l GROUP BY ALL)
SELECT s.shot_no, CAST(s.cluster_no AS BIGINT) AS cluster_no, round(avg(sim), 6) AS mean_sim FROM spans s LEFT JOIN sims ON sims.shot_no = s.shot_no AND t BETWEEN s.s AND s.e GROUP BY s.shot_no, s.cluster_no""",
    "aligned_scores": f"WITH {_SIMS}, w AS (SELECT shot_no, t AS q, (t * 7) % 450 + 0.5 AS pt FROM qry) SELECT q, round(coalesce(max(sim), 0), 6) AS best FROM w LEFT JOIN sims ON sims.shot_no = w.shot_no AND abs(sims.t - pt) <= 1.5 GROUP BY q",
    "start_shifts": f"""WITH {_SIMS}, c AS (SELECT *, shot_no * 10 + 7.0 AS cur, abs(t - (shot_no * 10 + 7.0)) AS dd FROM sims WHERE abs(t - (shot_no * 10 + 7.0)) <= 15), k AS (SELECT *, max(sim) OVER (PARTITION BY shot_no) AS top, row_number() OVER (PARTITION BY shot_no ORDER BY dd, t) AS z FROM c),
n AS (SELECT shot_no, sim AS now FROM k WHERE z = 1), p AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY dd, t) AS y FROM k WHERE sim >= top - 0.03)
SELECT p.shot_no, CAST(CASE WHEN sim - now >= 0.01 AND abs(t - cur) <= 10 THEN t ELSE cur END AS DOUBLE) AS new_start, round(sim, 6) AS best, round(now, 6) AS now FROM p JOIN n ON n.shot_no = p.shot_no WHERE y = 1""",
    "uniqueness": f"""WITH {fx.LIB}, l AS (SELECT t, f, row_number() OVER (ORDER BY t) AS i FROM lib), b AS (SELECT x.i, x.t, list_concat(list_concat(p.f, x.f), n.f) AS v FROM l x JOIN l p ON p.i = x.i - 1 JOIN l n ON n.i = x.i + 1)
SELECT a.t, round(max(round(list_cosine_similarity(a.v, b.v), 9)), 6) AS nearest FROM b a JOIN b ON abs(a.i - b.i) > 2 GROUP BY a.t""",
    "truth_ranks": f"WITH {fx.hits_sql(10)}, r AS (SELECT *, rank() OVER (PARTITION BY shot_no ORDER BY sim DESC) AS z FROM hits) SELECT shot_no, CAST(min(z) FILTER (abs(l_t - q_t) <= 100) AS INTEGER) AS best_rank FROM r GROUP BY shot_no",
    "cross_cuts": f"""WITH {fx.QRY}, x AS (SELECT shot_no, t, f, lead(f) OVER (PARTITION BY shot_no ORDER BY t) AS g FROM qry), k AS (SELECT shot_no, t, round(1 - list_cosine_similarity(f, g), 9) AS dd FROM x WHERE g IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY dd DESC, t) AS z FROM k)
SELECT shot_no, round(max(dd), 6) AS peak, max(CASE WHEN z = 1 THEN t END) AS "at", count(*) FILTER (dd > 0.95) AS cuts FROM r GROUP BY shot_no HAVING count(*) >= 2""",
    "promoted_anchors": f"WITH {_SHOT}, k AS (SELECT *, i % 3 <> 0 AND round(1 - score, 4) >= 0.35 AND round(1 - score, 4) >= score + 0.15 AS ok FROM shot) SELECT o_orderkey, round(CASE WHEN ok THEN s + 1 ELSE s END, 4) AS start, ok AS promoted FROM k",
    "split_children": f"""WITH {_SHOT}, c AS (SELECT o_orderkey, s, unnest([0, 1, 2]) AS child FROM shot) SELECT o_orderkey, CAST(child AS INTEGER) AS child, round(s + [0, 1.5, 2.5][child + 1], 4) AS start, round(s + [1.5, 2.5, 4][child + 1], 4) AS "end" FROM c""",
    "median_offsets": f"WITH {_SHOT}, o AS (SELECT o_custkey, round(s - i * 100, 2) AS x FROM shot), m AS (SELECT o_custkey, median(x) AS md FROM o GROUP BY 1) SELECT o_custkey, round(md, 4) AS \"offset\", round(avg(CAST(abs(x - md) <= 200 AS INTEGER)), 6) AS agree FROM o JOIN m USING (o_custkey) GROUP BY o_custkey, md",
    "switched_candidates": f"""WITH {_SHOT}, c AS (SELECT o_custkey, i, s, 0.45 * score + 0.55 * round((s / 13) % 1, 4) AS sc, round((s / 17) % 1, 4) AS v FROM shot), m AS (SELECT * FROM c WHERE i = 1), o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY sc DESC, s) AS z FROM c WHERE i > 1),
k AS (SELECT m.o_custkey, m.s AS ms, o.s AS os, coalesce(o.sc - m.sc >= 0.05 OR (o.sc - m.sc >= 0.025 AND o.v - m.v >= 0.05), false) AS sw FROM m LEFT JOIN o ON o.o_custkey = m.o_custkey AND z = 1) SELECT o_custkey, CASE WHEN sw THEN os ELSE ms END AS start, sw AS switched FROM k""",
    "bounded_spans": f"""WITH {_SHOT}, k AS (SELECT *, least(e + 10 - s, least(15, greatest(2, 4 * score))) AS w FROM shot) SELECT o_orderkey, round((s + e + 10) / 2 - w / 2, 4) AS a, round((s + e + 10) / 2 + w / 2, 4) AS b, CASE WHEN i % 2 = 0 THEN score >= 0.4 ELSE score >= 0.2 END AS kept, CASE WHEN i % 2 = 0 THEN 'high' ELSE 'low' END AS level,
score < 0.3 AND score / 2 < 0.45 AS weak, CASE WHEN NOT (i % 3 = 1 AND abs(score - 0.51) > 0.1) THEN 'unknown' WHEN score > 0.51 THEN 'same' ELSE 'different' END AS verdict, score >= 0.6 AND 0.8 - score <= 0.25 AS accepted FROM k""",
}
