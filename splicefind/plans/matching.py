"""Registered queries: retrieval, clusters, localisation, votes and series; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.functions import vectors as V
from splicefind.operators import asof, localize, retrieval
from splicefind.operators import timeseries as ts
from splicefind.operators.components import connected_components
from splicefind.plans import fixtures as fx

R = lambda c, n=6: F.round(c, n).alias(c if isinstance(c, str) else "x")


def cosine_topk(spark, d):
    return fx.hits(spark, d, 5).select("shot_no", "q_t", "l_t", R("sim"), "rank")


def evidence_clusters(spark, d):
    return fx.spans(spark, d).select("shot_no", F.col("cluster_no").cast("long").alias("cluster_no"), "start", "end", "n", R("mean_sim"))


def evidence_modes(spark, d):
    out = localize.evidence_mode(fx.spans(spark, d), fx.shots(spark, d))
    return out.select("shot_no", "nq", "n_strong", R("qcov"), R("dispersion"), "mode")


def coverage_runs(spark, d):
    keys = ["shot_no", "cluster_no"]
    cover = localize.window_cover(fx.spans(spark, d), fx.shots(spark, d), fx.library(spark, d), keys)
    out = localize.coverage_runs(cover, keys, fx.LEAST)
    rounded = ("best_cover", "mean_sim", "peak_sim", "coverage_quality", "span_coverage", "stability")
    return out.select("shot_no", F.col("cluster_no").cast("long").alias("cluster_no"), *[R(c) if c in rounded else c for c in out.columns if c not in keys])


def candidate_rank(spark, d):
    hits = ts.gap_clusters(fx.hits(spark, d, 10), ["shot_no"], "l_t", 15.0, ["q_t"])
    out = localize.candidate_metrics(hits, ["shot_no", "cluster_no"], fx.LEAST)
    names = ("peak_sim", "mean_sim", "sim_std", "consistency", "qcov", "rank_score")
    return out.select("shot_no", F.col("cluster_no").cast("long").alias("cluster_no"), *[R(c) if c in names else c for c in out.columns[2:]])


def offset_vote(spark, d):
    out = localize.offset_vote(fx.hits(spark, d, 1))
    return out.select("shot_no", "bucket", R("seed"), R("support"), "votes_in", "votes", R("spread", 4), R("wide_support"))


def vote_verdicts(spark, d):
    votes = localize.offset_vote(fx.hits(spark, d, 1))
    now = fx.hits(spark, d, 1).groupBy("shot_no").agg(F.min("l_t").alias("start"))
    out = localize.vote_verdict(votes, now, 2000.0, support=0.05, most_shift=100.0)
    return out.select("shot_no", "start", R("new_start"), "reason")


def global_anchor(spark, d):
    out = localize.global_anchor(localize.offset_vote(fx.hits(spark, d, 5)), 2000.0, support=0.02, wide=0.03)
    return out.select("shot_no", R("seed"), "reason")


def _line(spark, d):
    """The whole library as one series."""
    return fx.library(spark, d).withColumn("k", F.lit(0))


def adjacent_distance(spark, d):
    out = ts.by_ranges(_line(spark, d), ["k"], "t", 150.0, 1, ts.adjacent_distance)
    return out.select("t", R("distance"))


def local_peaks(spark, d):
    def peaks(rows, keys):
        rows = ts.adjacent_distance(rows, keys).withColumn("x", F.round("distance", 9))
        return rows.withColumn("p", ts.is_peak("x", keys, "t")).withColumn("o", ts.parabola_offset("x", keys, "t"))

    rows = ts.by_ranges(_line(spark, d), ["k"], "t", 150.0, 2, peaks)
    return rows.where("p").select("t", F.round("x", 6).alias("x"), F.round("o", 5).alias("offset"))


def adaptive_peaks(spark, d):
    return ts.adaptive_peaks(fx.series(spark, d), ["user_id"], "seq", "x", 10.0, 2.0).select("user_id", "seq", R("x"), R("median"))


def local_zscore(spark, d):
    out = ts.local_zscore(fx.series(spark, d), ["user_id"], "seq", "x", 3)
    return out.select("user_id", "seq", R("smoothed"), R("mu"), R("sigma", 4), R("z", 3))


def smooth_cover(spark, d):
    return fx.series(spark, d).withColumn("cs", ts.smoothed3("x", ["user_id"], "seq")).select("user_id", "seq", R("cs"))


def run_shares(spark, d):
    out = ts.longest_run_share(fx.series(spark, d).withColumn("flag", F.col("x") >= 20), ["user_id"], "seq", "flag")
    return out.select("user_id", "n", R("share"), R("run_share"))


def block_gate(spark, d):
    out = ts.by_ranges(_line(spark, d), ["k"], "t", 150.0, 5, lambda rows, keys: ts.block_gate(rows, keys, "t", "feature"))
    return out.select("t", R("block_distance", 5), R("block_deviation", 5))


def scene_centroids(spark, d):
    s = fx.scenes(spark, d)
    return s.select("scene_no", "start", "end", F.round(F.col("feature")[0], 6).alias("f0"), F.round(F.col("feature")[63], 6).alias("f63"), F.size("feature").cast("long").alias("dim"))


def scene_topk(spark, d):
    q = V.centroids(fx.shots(spark, d), ["shot_no"], out="feature").withColumn("t", F.col("shot_no").cast("double"))
    s = fx.scenes(spark, d)
    best = retrieval.top_k(q, s.withColumn("t", F.col("scene_no").cast("double")), 5)
    rows = asof.range_join(fx.library(spark, d).select("t"), s.select("scene_no", "start", "end"), [], "t", "start", "end", 50.0, closed=False)
    n = rows.groupBy("scene_no").agg(F.count("*").alias("frames"))
    return best.join(n, best.l_t == n.scene_no).select("shot_no", "scene_no", R("sim"), "rank", "frames")


def event_components(spark, d):
    s = fx.scenes(spark, d)
    label = connected_components(s, localize.near_scenes(s, 60.0, 0.1), "scene_no")
    return label.groupBy("component").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def mutual_nn(spark, d):
    return retrieval.mutual_nearest(fx.shots(spark, d), fx.library(spark, d), fx.LEAST).select("q_t", "l_t", R("sim"))


def set_similarity(spark, d):
    return retrieval.set_similarity(fx.shots(spark, d), fx.library(spark, d)).select("shot_no", R("forward"), R("backward"), R("symmetric"))


def patch_score(spark, d):
    return retrieval.patch_score(fx.shots(spark, d), fx.library(spark, d), 10).select("shot_no", R("score"), "n")


def grid_sample(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", ts.epoch_seconds("ts").alias("s"))
    return asof.grid_sample(e, ["user_id"], "s", 86400.0, 0.0, ["event_id"]).select("user_id", F.col("cell").cast("long").alias("cell"), "event_id")


def _pair(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", "event_type", ts.epoch_seconds("ts").alias("s"))
    return e.where("event_type = 'click'").select("user_id", "event_id", "s"), e.where("event_type = 'purchase'").groupBy("user_id", F.col("s").alias("ps")).agg(F.min("event_id").alias("found"))


def asof_forward(spark, d):
    a, b = _pair(spark, d)
    return asof.asof_forward(a, b, ["user_id"], "s", "ps", ["found"]).select("event_id", F.col("match.found").alias("found"))


def asof_nearest(spark, d):
    a, b = _pair(spark, d)
    return asof.nearest(a, b, ["user_id"], "s", "ps", ["found"], 86400.0 * 3).select("event_id", F.col("match.found").alias("found"))


def event_sessions(spark, d):
    out = ts.sessions(fx.table(spark, d, "events"), "user_id", "ts", 21600.0, ["event_id"])
    return out.select("user_id", F.col("session_no").cast("long").alias("session_no"), "start", "end", "n")


def scene_votes(spark, d):
    """Frames vote for their scene with what their similarity has over 0.1."""
    h = fx.hits(spark, d, 10).withColumn("scene_no", F.floor(F.col("l_t") / 20).cast("long"))
    return h.groupBy("shot_no", "scene_no").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("sim") - 0.1)), 4).alias("vote"))


def weighted_votes(spark, d):
    e = fx.table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value", F.hour("ts").cast("double").alias("h"))
    return localize.quality_weights(e, ["user_id"], {"value": 0.6, "h": 0.4}).select("event_id", R("weight"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "R"}

_H1, _H5, _H10 = fx.hits_sql(1), fx.hits_sql(5), fx.hits_sql(10)
_VOTE = """v AS (SELECT *, l_t - (q_t - min(q_t) OVER (PARTITION BY shot_no)) AS proj FROM hits),
b AS (SELECT *, CAST(round_even(proj / 0.05, 0) AS BIGINT) AS bucket FROM v),
best AS (SELECT shot_no, bucket AS best FROM (SELECT shot_no, bucket, row_number() OVER (PARTITION BY shot_no ORDER BY sw DESC, bucket) AS r FROM (SELECT shot_no, bucket, round(sum(sim), 9) AS sw FROM b GROUP BY ALL)) WHERE r = 1),
j AS (SELECT b.*, best.best, CASE WHEN abs(bucket - best) <= 1 THEN sim END AS w FROM b JOIN best USING (shot_no)),
s AS (SELECT shot_no, best AS bucket, sum(w * proj) / sum(w) AS seed, count(w) / count(*) AS support, count(w) AS votes_in, count(*) AS votes, sqrt(greatest(sum(w * proj * proj) / sum(w) - (sum(w * proj) / sum(w)) ** 2, 0)) AS spread FROM j GROUP BY shot_no, best),
ws AS (SELECT v.shot_no, count(*) FILTER (abs(v.proj - s.seed) <= 1.5) / count(*) AS wide_support FROM v JOIN s ON s.shot_no = v.shot_no GROUP BY v.shot_no),
vote AS (SELECT s.*, ws.wide_support FROM s JOIN ws ON ws.shot_no = s.shot_no)"""
_DIST = f"{fx.LIB}, dist AS (SELECT t, 1 - list_cosine_similarity(f, nf) AS d FROM (SELECT t, f, lead(f) OVER (ORDER BY t) AS nf FROM lib) WHERE nf IS NOT NULL)"
_PAIRS = """e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS s FROM events),
a AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT user_id, s AS ps, min(event_id) AS found FROM e WHERE event_type = 'purchase' GROUP BY ALL)"""


def _pad(x: str, r: int, part: str = "user_id", order: str = "seq") -> str:
    w = f"PARTITION BY {part} ORDER BY {order}"
    whole = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"((sum({x}) OVER ({w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + greatest({r} - seq, 0) * first_value({x}) OVER {whole} + greatest({r} - (count(*) OVER {whole} - 1 - seq), 0) * last_value({x}) OVER {whole}) / {2 * r + 1})"


SQL = {
    "cosine_topk": f"WITH {_H5} SELECT shot_no, q_t, l_t, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM hits",
    "evidence_clusters": f"WITH {fx.SPANS} SELECT shot_no, CAST(cluster_no AS BIGINT) AS cluster_no, s AS start, e AS \"end\", n, round(mean_sim, 6) AS mean_sim FROM spans",
    "evidence_modes": f"""WITH {fx.SPANS}, p AS (SELECT shot_no, count(*) AS k, sum(n) AS m, stddev_pop(mean_sim) AS sd FROM spans GROUP BY shot_no), q AS (SELECT shot_no, count(*) AS nq FROM qry GROUP BY shot_no)
SELECT q.shot_no, nq, coalesce(k, 0) AS n_strong, round(coalesce(m, 0) / nq, 6) AS qcov, round(coalesce(sd, 0), 6) AS dispersion, CASE WHEN k >= 2 THEN 'montage' WHEN k = 1 THEN 'clean' ELSE 'empty' END AS mode FROM q LEFT JOIN p ON p.shot_no = q.shot_no""",
    "coverage_runs": f"""WITH {fx.SPANS}, win AS (SELECT shot_no, cluster_no, greatest(0, s - 15) AS lo, e + 15 AS hi FROM spans),
c AS (SELECT w.shot_no, w.cluster_no, l.t, any_value(lo) AS lo, any_value(hi) AS hi, round(max(list_cosine_similarity(q.f, l.f)), 9) AS cover FROM win w JOIN lib l ON l.t BETWEEN lo AND hi JOIN qry q ON q.shot_no = w.shot_no GROUP BY ALL),
m AS (SELECT *, round(CASE WHEN count(*) OVER (PARTITION BY shot_no, cluster_no) < 3 THEN avg(cover) OVER (PARTITION BY shot_no, cluster_no) ELSE avg(cover) OVER (PARTITION BY shot_no, cluster_no ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 9) AS cs FROM c),
fl AS (SELECT *, cs >= {fx.LEAST} AS flag, coalesce(lag(cs) OVER (PARTITION BY shot_no, cluster_no ORDER BY t) >= {fx.LEAST}, false) AS pf FROM m),
tot AS (SELECT shot_no, cluster_no, avg(CAST(flag AS DOUBLE)) AS best_cover, max(hi) - max(lo) AS ws FROM fl GROUP BY ALL),
nr AS (SELECT *, sum(CASE WHEN flag AND NOT pf THEN 1 ELSE 0 END) OVER (PARTITION BY shot_no, cluster_no ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM fl),
r AS (SELECT shot_no, cluster_no, run, min(t) AS a, max(t) AS b, count(*) AS len, avg(cs) AS ms, max(cover) AS pk, arg_max(t, cs * 1e9 - t * 1e-7) AS pt FROM nr WHERE flag GROUP BY ALL),
g AS (SELECT *, a - lag(b) OVER w AS gap, len >= 2 AND coalesce(a - max(CASE WHEN len >= 2 THEN b END) OVER (PARTITION BY shot_no, cluster_no ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 5, false) AS isl, row_number() OVER (PARTITION BY shot_no, cluster_no ORDER BY len DESC, a) AS k FROM r WINDOW w AS (PARTITION BY shot_no, cluster_no ORDER BY run)),
st AS (SELECT shot_no, cluster_no, count(*) AS n_runs, count(*) FILTER (len >= 2) AS n_significant, coalesce(max(gap), 0) AS largest_gap, bool_or(isl) AS multi_island, sum(len) AS cv FROM g GROUP BY ALL)
SELECT g.shot_no, CAST(g.cluster_no AS BIGINT) AS cluster_no, round(best_cover, 6) AS best_cover, n_runs, n_significant, largest_gap, multi_island, a AS run_start, b AS run_end, len AS run_len, round(ms, 6) AS mean_sim, round(pk, 6) AS peak_sim,
round(len / cv, 6) AS coverage_quality, round((b - a) / ws, 6) AS span_coverage, round(least((b - a) / 4, 1) * CASE WHEN multi_island OR len <= 1 THEN 0.25 ELSE 1 END, 6) AS stability, greatest(a, pt - 7.5) AS tight_start, least(b, pt + 7.5) AS tight_end
FROM g JOIN st USING (shot_no, cluster_no) JOIN tot USING (shot_no, cluster_no) WHERE k = 1""",
    "candidate_rank": f"""WITH {_H10}, {fx.CLUSTERS}, rp AS (SELECT *, row_number() OVER (PARTITION BY shot_no, cluster_no, q_t ORDER BY sim DESC, l_t) AS r FROM clus),
up AS (SELECT *, CAST(l_t >= lag(l_t) OVER (PARTITION BY shot_no, cluster_no ORDER BY q_t) - 1e-6 AS INTEGER) AS u FROM rp WHERE r = 1),
pr AS (SELECT shot_no, cluster_no, count(*) AS n_reps, coalesce(avg(u), 1) AS consistency, avg(CAST(sim >= {fx.LEAST} AS INTEGER)) AS qcov FROM up GROUP BY ALL),
sg AS (SELECT *, CAST(l_t - lag(l_t) OVER (PARTITION BY shot_no, cluster_no ORDER BY l_t, q_t) > 10 AS INTEGER) AS far FROM clus),
p AS (SELECT shot_no, cluster_no, min(l_t) AS start, max(l_t) AS "end", max(sim) AS peak_sim, avg(sim) AS mean_sim, count(*) AS hit_count, stddev_pop(sim) AS sim_std, CAST(coalesce(sum(far), 0) + 1 AS BIGINT) AS scene_div FROM sg GROUP BY ALL)
SELECT p.shot_no, CAST(p.cluster_no AS BIGINT) AS cluster_no, start, "end", round(peak_sim, 6) AS peak_sim, round(mean_sim, 6) AS mean_sim, hit_count, round(sim_std, 6) AS sim_std, scene_div, n_reps, round(consistency, 6) AS consistency, round(qcov, 6) AS qcov,
round(mean_sim * sqrt(hit_count) * (0.5 + 0.5 * consistency) * sqrt(n_reps), 6) AS rank_score FROM p JOIN pr USING (shot_no, cluster_no)""",
    "offset_vote": f"WITH {_H1}, {_VOTE} SELECT shot_no, bucket, round(seed, 6) AS seed, round(support, 6) AS support, votes_in, votes, round(spread, 4) AS spread, round(wide_support, 6) AS wide_support FROM vote",
    "vote_verdicts": f"""WITH {_H1}, {_VOTE}, c AS (SELECT shot_no, min(l_t) AS start FROM hits GROUP BY 1), x AS (SELECT *, CASE WHEN votes < 2 THEN 'few_rows' WHEN support < 0.05 THEN 'low_support' WHEN abs(seed - start) > 100 THEN 'large_shift' WHEN seed < 0 OR seed > 2000 THEN 'out_of_range' ELSE 'accepted' END AS reason FROM vote JOIN c USING (shot_no))
SELECT shot_no, start, round(CASE WHEN reason = 'accepted' THEN seed ELSE start END, 6) AS new_start, reason FROM x""",
    "global_anchor": f"""WITH {_H5}, {_VOTE} SELECT shot_no, round(seed, 6) AS seed, CASE WHEN votes < 2 THEN 'few_rows' WHEN support < 0.02 THEN 'low_support' WHEN votes_in < 1 THEN 'no_votes' WHEN wide_support < 0.03 THEN 'narrow' WHEN seed < 0 OR seed > 2000 THEN 'out_of_range' ELSE 'accepted' END AS reason FROM vote""",
    "adjacent_distance": f"WITH {_DIST} SELECT t, round(d, 6) AS distance FROM dist",
    "local_peaks": f"""WITH {_DIST}, r AS (SELECT t, round(d, 9) AS x, lag(round(d, 9)) OVER (ORDER BY t) AS a, lead(round(d, 9)) OVER (ORDER BY t) AS c FROM dist)
SELECT t, round(x, 6) AS x, round(CASE WHEN abs(a - 2 * x + c) > 1e-12 THEN greatest(-1.0, least(1.0, 0.5 * (a - c) / (a - 2 * x + c))) ELSE 0 END, 5) AS "offset" FROM r WHERE x >= a AND x >= c""",
    "adaptive_peaks": f"""WITH {fx.SERIES}, m AS (SELECT *, median(x) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med, lag(x) OVER (PARTITION BY user_id ORDER BY seq) AS a, lead(x) OVER (PARTITION BY user_id ORDER BY seq) AS c FROM ser)
SELECT user_id, CAST(seq AS INTEGER) AS seq, round(x, 6) AS x, round(med, 6) AS median FROM m WHERE x >= a AND x >= c AND x >= 10 AND x >= 2 * med""",
    "local_zscore": f"""WITH {fx.SERIES}, a AS (SELECT user_id, seq, {_pad("x", 1)} AS sm FROM ser), b AS (SELECT *, {_pad("sm", 3)} AS mu, {_pad("(sm * sm)", 3)} AS sq FROM a), c AS (SELECT *, sqrt(greatest(sq - mu * mu, 0)) AS sd FROM b)
SELECT user_id, CAST(seq AS INTEGER) AS seq, round(sm, 6) AS smoothed, round(mu, 6) AS mu, round(sd, 4) AS sigma, round((sm - mu) / greatest(sd, 1e-4), 3) AS z FROM c""",
    "smooth_cover": f"""WITH {fx.SERIES} SELECT user_id, CAST(seq AS INTEGER) AS seq, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN avg(x) OVER (PARTITION BY user_id) ELSE avg(x) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) AS cs FROM ser""",
    "run_shares": f"""WITH {fx.SERIES}, f AS (SELECT *, x >= 20 AS flag, seq - row_number() OVER (PARTITION BY user_id, x >= 20 ORDER BY seq) AS g FROM ser), r AS (SELECT user_id, max(k) AS m FROM (SELECT user_id, g, count(*) AS k FROM f WHERE flag GROUP BY ALL) GROUP BY user_id)
SELECT s.user_id, n, round(sh, 6) AS share, round(coalesce(m, 0) / n, 6) AS run_share FROM (SELECT user_id, count(*) AS n, avg(CAST(flag AS INTEGER)) AS sh FROM f GROUP BY 1) s LEFT JOIN r ON r.user_id = s.user_id""",
    "block_gate": f"""WITH {fx.LIB}, p AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, f FROM lib), u AS (SELECT t, rn, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS i FROM p),
m AS (SELECT *, avg(x) OVER (PARTITION BY i ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, avg(x) OVER (PARTITION BY i ORDER BY rn ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS a FROM u),
d AS (SELECT t, rn, sum(abs(a - b)) AS dist FROM m GROUP BY ALL), v AS (SELECT rn, max(s) AS dev FROM (SELECT m.rn, u.rn AS r2, sum(abs(u.x - m.a)) AS s FROM m JOIN u ON u.i = m.i AND u.rn BETWEEN m.rn + 2 AND m.rn + 5 GROUP BY ALL) GROUP BY rn)
SELECT t, round(coalesce(dist, 0), 5) AS block_distance, round(CASE WHEN dist IS NULL THEN 9.9 ELSE dev END, 5) AS block_deviation FROM d LEFT JOIN v USING (rn)""",
    "scene_centroids": f"WITH {fx.SCENES} SELECT scene_no, s AS start, e AS \"end\", round(f[1], 6) AS f0, round(f[64], 6) AS f63, CAST(len(f) AS BIGINT) AS dim FROM scenes",
    "scene_topk": f"""WITH {fx.SCENES}, {fx.QRY}, qp AS (SELECT shot_no, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS p FROM qry), qm AS (SELECT shot_no, list(x ORDER BY p) AS m FROM (SELECT shot_no, p, avg(x) AS x FROM qp GROUP BY ALL) GROUP BY 1),
k AS (SELECT shot_no, scene_no, round(list_cosine_similarity(m, f), 9) AS sim, s, e FROM qm, scenes), r AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, scene_no) AS rank FROM k)
SELECT shot_no, scene_no, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM lib WHERE t >= s AND t < e) AS frames FROM r WHERE rank <= 5""",
    "event_components": f"""WITH RECURSIVE {fx.SCENES}, ed AS (SELECT a.scene_no AS a, b.scene_no AS b FROM scenes a, scenes b WHERE a.scene_no <> b.scene_no AND abs((a.s + a.e) / 2 - (b.s + b.e) / 2) <= 60 AND round(list_cosine_similarity(a.f, b.f), 9) >= 0.1),
reach(n, m) AS (SELECT scene_no, scene_no FROM scenes UNION SELECT ed.b, reach.m FROM reach JOIN ed ON ed.a = reach.n), lab AS (SELECT n, min(m) AS component FROM reach GROUP BY n)
SELECT component, min(s) AS start, max(e) AS "end", count(*) AS n FROM lab JOIN scenes ON scene_no = n GROUP BY component""",
    "mutual_nn": f"""WITH {_H1}, back AS (SELECT l_t, q_t FROM (SELECT l.t AS l_t, q.t AS q_t, row_number() OVER (PARTITION BY l.t ORDER BY round(list_cosine_similarity(q.f, l.f), 9) DESC, q.t) AS r FROM lib l, qry q) WHERE r = 1)
SELECT q_t, l_t, round(sim, 6) AS sim FROM hits JOIN back USING (q_t, l_t) WHERE sim >= {fx.LEAST}""",
    "set_similarity": f"""WITH {_H1}, fw AS (SELECT shot_no, avg(sim) AS f FROM hits GROUP BY 1), bk AS (SELECT shot_no, avg(m) AS b FROM (SELECT q.shot_no, l.t, max(round(list_cosine_similarity(q.f, l.f), 9)) AS m FROM qry q, lib l GROUP BY ALL) GROUP BY 1)
SELECT shot_no, round(f, 6) AS forward, round(b, 6) AS backward, round((f + b) / 2, 6) AS symmetric FROM fw JOIN bk USING (shot_no)""",
    "patch_score": f"WITH {_H1} SELECT shot_no, round(avg(sim), 6) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, q_t) AS k FROM hits) WHERE k <= 10 GROUP BY shot_no",
    "grid_sample": "SELECT user_id, cell, event_id FROM (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS cell, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 86400) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "asof_forward": f"""WITH {_PAIRS}, m AS (SELECT a.event_id, arg_min(found, ps) FILTER (ps >= a.s) AS f, arg_max(found, ps) AS l FROM a LEFT JOIN p ON p.user_id = a.user_id GROUP BY a.event_id) SELECT event_id, coalesce(f, l) AS found FROM m""",
    "asof_nearest": f"""WITH {_PAIRS}, m AS (SELECT a.event_id, found, abs(ps - a.s) AS g, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(ps - a.s), ps) AS k FROM a LEFT JOIN p ON p.user_id = a.user_id) SELECT event_id, CASE WHEN g <= 259200 THEN found END AS found FROM m WHERE k = 1""",
    "event_sessions": """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM events), c AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 21600 THEN 1 ELSE 0 END AS b FROM e), n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM c)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(s) AS start, max(s) AS "end", count(*) AS n FROM n GROUP BY user_id, session_no""",
    "scene_votes": f"WITH {_H10} SELECT shot_no, CAST(floor(l_t / 20) AS BIGINT) AS scene_no, round(sum(greatest(0, sim - 0.1)), 4) AS vote FROM hits GROUP BY ALL",
    "weighted_votes": """WITH e AS (SELECT user_id, event_id, value AS v, CAST(hour(ts) AS DOUBLE) AS h FROM events WHERE value IS NOT NULL), m AS (SELECT *, min(v) OVER w AS lv, max(v) OVER w AS hv, min(h) OVER w AS lh, max(h) OVER w AS hh FROM e WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(least(1, greatest(0.2, 0.6 * CASE WHEN hv > lv THEN (v - lv) / (hv - lv) ELSE 1 END + 0.4 * CASE WHEN hh > lh THEN (h - lh) / (hh - lh) ELSE 1 END)), 6) AS weight FROM m""",
}
