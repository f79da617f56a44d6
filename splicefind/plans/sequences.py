"""Registered queries over sequential folds; SQL walks the same steps by recursion where it can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from splicefind.operators import folds, intervals, timeseries
from splicefind.operators.timeseries import epoch_seconds
from splicefind.plans import fixtures as fx
from splicefind.plans.editing import _E, _SHOT, _sessions, _shots


def spaced_peaks(spark, d):
    s = fx.series(spark, d).withColumn("at", F.col("seq").cast("double"))
    kept = folds.fold(s, ["user_id"], ["seq"], lambda r: [r[i] for i in folds.keep_strongest([x["at"] for x in r], [x["x"] for x in r], 3.0)])
    return kept.select("user_id", "seq", F.round("x", 6).alias("x"))


def short_merge(spark, d):
    def run(rows):
        cuts = folds.merge_short(len(rows), [i for i, r in enumerate(rows) if i and r["x"] >= 15], [r["x"] for i, r in enumerate(rows) if i and r["x"] >= 15], 4)
        return [rows[i] for i in cuts]

    return folds.fold(fx.series(spark, d), ["user_id"], ["seq"], run)


def continuity_clusters(spark, d):
    h = fx.hits(spark, d, 10).drop("rank")
    return folds.fold(h, ["shot_no"], ["l_t", "q_t"], lambda r: folds.continuity_clusters(r, floor=fx.LEAST), "cluster int").withColumn("sim", F.round("sim", 6))


def similarity_runs(spark, d):
    h = fx.hits(spark, d, 5).groupBy("shot_no", F.col("l_t").alias("t")).agg(F.max("sim").alias("sim"))
    return timeseries.similarity_runs(h, ["shot_no"]).select("shot_no", "t", F.round("sim", 6).alias("sim"), "run")


def spaced_topk(spark, d):
    h = fx.hits(spark, d, 10).groupBy("shot_no", F.col("l_t").alias("t")).agg(F.max("sim").alias("sim"))
    return folds.fold(h, ["shot_no"], ["t"], folds.spaced_best).select("shot_no", "t", F.round("sim", 6).alias("sim"))


def moment_align(spark, d):
    """Each shot aligned with the 40 s around its best hit."""
    best = fx.hits(spark, d, 1).groupBy("shot_no").agg(F.max_by("l_t", F.struct("sim", -F.col("l_t"))).alias("c"))
    shots = fx.shots(spark, d).groupBy("shot_no").agg(F.sort_array(F.collect_list(F.struct("t", "feature"))).alias("q"))
    lib = fx.library(spark, d)
    near = lib.withColumn("b", F.explode(F.array(*[F.floor(F.col("t") / 40) + k for k in (-1, 0, 1)]))).join(best.withColumn("b", F.floor(F.col("c") / 40)), "b").where(F.abs(F.col("t") - F.col("c")) <= 20)
    wins = near.groupBy("shot_no").agg(F.sort_array(F.collect_list(F.struct("t", "feature"))).alias("r"))

    def run(rows):
        out = []
        for x in rows:
            q, r = x["q"], x["r"]
            got = folds.align_moments(np.array([v["feature"] for v in q]), np.array([v["feature"] for v in r]), [v["t"] for v in q], [v["t"] for v in r], least=0.05)
            out += [{"shot_no": x["shot_no"], **g} for g in got]
        return out

    return folds.fold(shots.join(wins, "shot_no"), ["shot_no"], ["shot_no"], run, "q_start double, q_end double, start double, end double, score double, label string", ["shot_no"])


def sequence_rerank(spark, d):
    s = _shots(spark, d)
    c = s.withColumn("candidates", F.array(F.struct("start", "score"), F.struct((F.col("end") * 0.7).alias("start"), F.lit(0.6).alias("score")), F.struct((F.col("end") + 90).alias("start"), F.lit(0.4).alias("score"))))

    def run(rows):
        plain = [{"o_custkey": r["o_custkey"], "o_orderkey": r["o_orderkey"], "edited_mid": float(r["i"]), "candidates": [(x["start"], x["score"]) for x in r["candidates"]]} for r in rows]
        return folds.sequence_rerank(plain)

    return folds.fold(c, ["o_custkey"], ["i"], run, "choice double, norm double, changed boolean", ["o_custkey", "o_orderkey"])


def iou_dedup(spark, d):
    s = _sessions(spark, d).where("end > start").withColumn("q_start", F.col("start")).withColumn("cover", F.col("n") / 10).withColumn("sim", F.lit(0.5))
    return folds.fold(s, ["grp"], ["sid"], lambda r: folds.iou_dedup(r, 0.3, 20)).select("grp", "sid", "n")


def subspan_gate(spark, d):
    s = _sessions(spark, d).where("end > start").withColumn("q_start", F.col("start")).withColumn("cover", F.col("n") / 10).withColumn("sim", F.col("n") / 20)
    return folds.fold(s, ["grp"], ["sid"], lambda r: folds.gate_subspans(r, keep=10))


def claim_gate(spark, d):
    s = _shots(spark, d).withColumn("q_start", F.col("i").cast("double")).withColumn("q_end", F.col("i") + F.lit(1.0)).withColumn("level", F.lit("HIGH"))
    return folds.fold(s, ["o_custkey"], ["i"], lambda r: folds.claim_gate(r, 0.2), "dup_share double, duplicate boolean").withColumn("dup_share", F.round("dup_share", 6))


def shift_repeats(spark, d):
    out = folds.fold(_shots(spark, d), ["o_custkey"], ["i"], lambda r: folds.shift_repeats(r, 60.0, 1000.0), "shifted boolean")
    return out.select("o_orderkey", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "shifted")


def timeline_prior(spark, d):
    s = _shots(spark, d).withColumn("spans", F.array(F.struct("start", "end", F.lit(0.5).alias("cover")), F.struct((F.col("start") * 0.5).alias("start"), (F.col("start") * 0.5 + 4).alias("end"), F.lit(0.45).alias("cover"))))

    def run(rows):
        return folds.timeline_prior([{**r, "spans": [(x["start"], x["end"], x["cover"]) for x in r["spans"]]} for r in rows])

    return folds.fold(s, ["o_custkey"], ["i"], run, "pick int", ["o_custkey", "o_orderkey"])


def boundary_split(spark, d):
    """Each customer's spans cut at the places that the prices of all parts mark."""
    s = _shots(spark, d).withColumn("q_start", F.col("i").cast("double")).withColumn("q_end", F.col("i") + F.lit(1.0)).withColumn("one", F.lit(1))
    marks = fx.table(spark, d, "part").select(F.lit(1).alias("one"), F.round(F.pmod("p_retailprice", F.lit(1000.0)), 1).alias("at")).distinct()
    out = intervals.split_at(s, marks, ["one"], "o_orderkey", 10.0)
    return out.select("o_orderkey", "piece", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("q_start", 4).alias("q_start"), F.round("q_end", 4).alias("q_end"))


def trim_overlaps(spark, d):
    s = _shots(spark, d).withColumn("q_start", F.col("i").cast("double")).withColumn("q_end", F.col("i") + F.lit(1.0))
    return folds.fold(s, ["o_custkey"], ["i"], folds.trim_overlaps, "inserted boolean")


def conflict_repair(spark, d):
    """Clashing spans of a customer moved within the similarities that its order lines give."""
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    series = lines.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.round(F.pmod("l_extendedprice", F.lit(1000.0)), 2).alias("t"), (F.col("l_discount") * 10).cast("double").alias("sim")))).alias("series"))
    # two plain arrays, on a customer's first row only
    series = series.select("o_custkey", F.struct(F.col("series.t").alias("t"), F.col("series.sim").alias("sim")).alias("series"))
    rows = _shots(spark, d).join(series, "o_custkey", "left").withColumn("series", F.when(F.col("i") == 1, F.col("series")))
    return folds.fold(rows, ["o_custkey"], ["i"], lambda r: folds.repair_conflicts(r, least=0.2, good=0.3), "moved boolean", ["o_custkey", "o_orderkey", "i", "start", "end", "score"])


def progress_frames(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", epoch_seconds("ts").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("percent"))
    return folds.fold(e, ["user_id"], ["ts", "event_id"], lambda r: folds.debounce(r, 7200.0))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
_H5 = f"{fx.hits_sql(5)}, h AS (SELECT shot_no, l_t AS t, max(sim) AS sim FROM hits GROUP BY ALL)"
SQL = {
    "similarity_runs": f"""WITH {_H5}, k AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY shot_no ORDER BY sim DESC, t) > 8 THEN 1 ELSE 0 END AS b FROM h)
SELECT shot_no, t, round(sim, 6) AS sim, CAST(sum(b) OVER (PARTITION BY shot_no ORDER BY sim DESC, t ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run FROM k""",
    "boundary_split": f"""WITH {_SHOT}, m AS (SELECT DISTINCT round(p_retailprice % 1000, 1) AS pt FROM part), c AS (SELECT o_orderkey, s, e, i, pt FROM shot JOIN m ON pt > s + 0.5 AND pt < e - 0.5 WHERE e - s > 1),
n AS (SELECT *, coalesce(lead(pt) OVER (PARTITION BY o_orderkey ORDER BY pt), e) - pt AS w FROM c), b AS (SELECT o_orderkey, s, e, i, pt FROM n WHERE w >= 0.5 UNION ALL SELECT o_orderkey, s, e, i, s FROM shot),
p AS (SELECT *, row_number() OVER k - 1 AS z, count(*) OVER (PARTITION BY o_orderkey) AS n, lead(pt) OVER k AS nx FROM b WINDOW k AS (PARTITION BY o_orderkey ORDER BY pt))
SELECT o_orderkey, CAST(CASE WHEN n > 1 THEN z ELSE -1 END AS INTEGER) AS piece, round(pt, 4) AS start, round(coalesce(nx, e), 4) AS "end", round(i + (pt - s) / (e - s), 4) AS q_start, round(i + (coalesce(nx, e) - s) / (e - s), 4) AS q_end FROM p""",
    "spaced_peaks": f"""WITH RECURSIVE {fx.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, seq) AS z FROM ser),
w AS (SELECT user_id, seq, x, z, [seq] AS kept, true AS ok FROM r WHERE z = 1 UNION ALL
  SELECT r.user_id, r.seq, r.x, r.z, CASE WHEN len(list_filter(kept, lambda k: abs(k - r.seq) < 3)) = 0 THEN list_append(kept, r.seq) ELSE kept END, len(list_filter(kept, lambda k: abs(k - r.seq) < 3)) = 0 FROM w JOIN r ON r.user_id = w.user_id AND r.z = w.z + 1)
SELECT user_id, CAST(seq AS INTEGER) AS seq, round(x, 6) AS x FROM w WHERE ok""",
    "spaced_topk": f"""WITH RECURSIVE {fx.hits_sql(10)}, h AS (SELECT shot_no, l_t AS t, max(sim) AS sim FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, t) AS z FROM h),
w AS (SELECT shot_no, t, sim, z, [t] AS kept, true AS ok FROM r WHERE z = 1 UNION ALL
  SELECT r.shot_no, r.t, r.sim, r.z, CASE WHEN len(kept) < 5 AND len(list_filter(kept, lambda k: abs(k - r.t) < 3)) = 0 THEN list_append(kept, r.t) ELSE kept END, len(kept) < 5 AND len(list_filter(kept, lambda k: abs(k - r.t) < 3)) = 0 FROM w JOIN r ON r.shot_no = w.shot_no AND r.z = w.z + 1)
SELECT shot_no, t, round(sim, 6) AS sim FROM w WHERE ok""",
    "iou_dedup": f"""WITH RECURSIVE {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, sid) AS z FROM ses WHERE e > s),
w AS (SELECT grp, sid, n, z, [{{'a': s, 'b': e}}] AS kept, true AS ok FROM r WHERE z = 1 UNION ALL
  SELECT r.grp, r.sid, r.n, r.z, CASE WHEN c.ok THEN list_append(kept, {{'a': r.s, 'b': r.e}}) ELSE kept END, c.ok FROM w JOIN r ON r.grp = w.grp AND r.z = w.z + 1,
  LATERAL (SELECT len(kept) < 20 AND len(list_filter(kept, lambda k: greatest(0, least(k.b, r.e) - greatest(k.a, r.s)) / (greatest(k.b, r.e) - least(k.a, r.s)) > 0.3)) = 0 AS ok) c)
SELECT grp, sid, n FROM w WHERE ok""",
    "shift_repeats": f"""WITH RECURSIVE {_SHOT}, w AS (SELECT o_custkey, o_orderkey, i, s AS a, e AS b, false AS sh FROM shot WHERE i = 1 UNION ALL
  SELECT t.o_custkey, t.o_orderkey, t.i, CASE WHEN c.sh THEN w.b ELSE t.s END, CASE WHEN c.sh THEN w.b + (t.e - t.s) ELSE t.e END, c.sh FROM w JOIN shot t ON t.o_custkey = w.o_custkey AND t.i = w.i + 1, LATERAL (SELECT abs(t.s - w.a) <= 60 AND w.b > t.s AND w.b + (t.e - t.s) <= 1000 AS sh) c)
SELECT o_orderkey, round(a, 4) AS start, round(b, 4) AS "end", sh AS shifted FROM w""",
    "timeline_prior": f"""WITH RECURSIVE {_SHOT}, w AS (SELECT o_custkey, o_orderkey, i, (s + e) / 2 AS m, 0 AS pick FROM shot WHERE i = 1 UNION ALL
  SELECT t.o_custkey, t.o_orderkey, t.i, CASE WHEN c.pick = 1 THEN t.s * 0.5 + 2 ELSE (t.s + t.e) / 2 END, c.pick FROM w JOIN shot t ON t.o_custkey = w.o_custkey AND t.i = w.i + 1, LATERAL (SELECT CASE WHEN abs((t.s + t.e) / 2 - w.m) > 45 AND abs((t.s * 0.5 + (t.s * 0.5 + 4)) / 2 - w.m) <= 45 THEN 1 ELSE 0 END AS pick) c)
SELECT o_custkey, o_orderkey, CAST(pick AS INTEGER) AS pick FROM w""",
    "short_merge": f"""WITH RECURSIVE {fx.SERIES}, c AS (SELECT user_id, list({{'e': seq, 'p': x}} ORDER BY seq) FILTER (seq > 0 AND x >= 15) AS c, count(*) AS n FROM ser GROUP BY 1),
w AS (SELECT user_id, list_concat([{{'e': CAST(0 AS BIGINT), 'p': CAST('inf' AS DOUBLE)}}], coalesce(c, []), [{{'e': n, 'p': CAST('inf' AS DOUBLE)}}]) AS k FROM c
  UNION ALL SELECT user_id, list_filter(k, lambda y, i: i <> h.g) FROM w, LATERAL (SELECT list_filter(range(1, len(k)), lambda i: k[i + 1].e - k[i].e < 4)[1] AS j) f,
  LATERAL (SELECT CASE WHEN k[f.j].p <= k[f.j + 1].p AND f.j > 1 OR f.j + 1 = len(k) THEN f.j ELSE f.j + 1 END AS g) h WHERE len(k) > 2 AND f.j IS NOT NULL),
d AS (SELECT user_id, unnest(arg_min(k, len(k))).e AS seq FROM w GROUP BY 1)
SELECT user_id, CAST(seq AS INTEGER) AS seq, x FROM d JOIN ser USING (user_id, seq) WHERE seq > 0""",
    "claim_gate": f"""WITH RECURSIVE {_SHOT}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, i) AS z FROM shot),
w AS (SELECT o_custkey, CAST(0 AS BIGINT) AS z, CAST([] AS STRUCT(a DOUBLE, b DOUBLE)[]) AS cl, CAST(NULL AS BIGINT) AS o_orderkey, CAST(0 AS DOUBLE) AS dup, false AS gone FROM (SELECT DISTINCT o_custkey FROM shot)
  UNION ALL SELECT r.o_custkey, r.z, CASE WHEN h.v > 0.2 THEN cl ELSE list_append(cl, {{'a': r.s, 'b': r.e}}) END, r.o_orderkey, h.v, h.v > 0.2 FROM w JOIN r ON r.o_custkey = w.o_custkey AND r.z = w.z + 1,
  LATERAL (SELECT list_sort(list_filter(list_transform(cl, lambda k: {{'a': greatest(k.a, r.s), 'b': least(k.b, r.e), 't': CAST(0 AS DOUBLE)}}), lambda k: k.b > k.a)) AS l) g,
  LATERAL (SELECT CASE WHEN r.e > r.s THEN least(1.0, list_reduce(list_concat([{{'a': CAST(-1e18 AS DOUBLE), 'b': CAST(-1e18 AS DOUBLE), 't': CAST(0 AS DOUBLE)}}], g.l), lambda x, y: {{'a': x.a, 'b': greatest(x.b, y.b), 't': x.t + greatest(0.0, y.b - greatest(y.a, x.b))}}).t / (r.e - r.s)) ELSE 0 END AS v) h)
SELECT r.o_custkey, r.o_orderkey, CAST(i AS INTEGER) AS i, s AS start, e AS "end", CASE WHEN gone THEN 0 ELSE score END AS score, CAST(i AS DOUBLE) AS q_start, i + 1.0 AS q_end, CASE WHEN gone THEN 'LOW' ELSE 'HIGH' END AS level, round(dup, 6) AS dup_share, gone AS duplicate FROM w JOIN r ON r.o_custkey = w.o_custkey AND r.z = w.z""",
    "subspan_gate": f"""WITH RECURSIVE {_E}, v AS (SELECT * FROM ses WHERE e > s), g AS (SELECT * FROM v WHERE n / 10 >= 0.45 OR n / 20 >= 0.45), b AS (SELECT * FROM g UNION ALL SELECT * FROM (SELECT * FROM v WHERE grp NOT IN (SELECT grp FROM g) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, sid) = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, sid) AS z FROM b),
w AS (SELECT grp, sid, z, [{{'a': s, 'b': e}}] AS kept, true AS ok FROM r WHERE z = 1 UNION ALL
  SELECT r.grp, r.sid, r.z, CASE WHEN c.ok THEN list_append(kept, {{'a': r.s, 'b': r.e}}) ELSE kept END, c.ok FROM w JOIN r ON r.grp = w.grp AND r.z = w.z + 1,
  LATERAL (SELECT len(kept) < 10 AND len(list_filter(kept, lambda k: greatest(0, least(k.b, r.e) - greatest(k.a, r.s)) / (greatest(k.b, r.e) - least(k.a, r.s)) > 0.6)) = 0 AS ok) c)
SELECT v.grp, v.sid, s AS start, e AS "end", n, s AS q_start, n / 10 AS cover, n / 20 AS sim FROM w JOIN v ON v.sid = w.sid AND v.grp = w.grp WHERE ok""",
    "progress_frames": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, event_type AS stage, value AS percent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, ts AS last, stage, true AS pub FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CASE WHEN h.p THEN e.ts ELSE last END, CASE WHEN h.p THEN e.stage ELSE w.stage END, h.p FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1, LATERAL (SELECT e.percent >= 100 OR e.stage IS DISTINCT FROM w.stage OR e.ts - last >= 7200 AS p) h)
SELECT user_id, event_id, ts, stage, percent FROM (SELECT e.*, pub, lead(pub) OVER (PARTITION BY e.user_id ORDER BY e.i) AS nx FROM e JOIN w ON w.user_id = e.user_id AND w.i = e.i) WHERE pub OR coalesce(nx, true)""",
    "continuity_clusters": f"""WITH RECURSIVE {fx.hits_sql(10)}, r AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY l_t, q_t) AS z FROM hits),
w AS (SELECT shot_no, q_t, l_t, sim, z, [{{'q': q_t, 'l': l_t, 's': sim}}] AS cur, 0 AS cluster FROM r WHERE z = 1
  UNION ALL SELECT r.shot_no, r.q_t, r.l_t, r.sim, r.z, CASE WHEN j.ok THEN c.all_of ELSE [c.me] END, CASE WHEN j.ok THEN cluster ELSE cluster + 1 END FROM w JOIN r ON r.shot_no = w.shot_no AND r.z = w.z + 1,
  LATERAL (SELECT {{'q': r.q_t, 'l': r.l_t, 's': r.sim}} AS me, list_append(cur, {{'q': r.q_t, 'l': r.l_t, 's': r.sim}}) AS all_of) c,
  LATERAL (SELECT list_sort(list_filter(c.all_of, lambda x, i: len(list_filter(c.all_of, lambda y, k: y.q = x.q AND (y.s > x.s OR (y.s = x.s AND k < i)))) = 0)) AS b) b,
  LATERAL (SELECT list_avg(list_transform(b.b, lambda x: x.s)) >= {fx.LEAST} AND len(list_filter(range(2, len(b.b) + 1), lambda k: b.b[k].l < b.b[k - 1].l - 1e-6
    OR (b.b[k].q - b.b[k - 1].q > 0.01 AND (b.b[k].l - b.b[k - 1].l) / (b.b[k].q - b.b[k - 1].q) NOT BETWEEN 0 AND 90))) = 0 AS on_) o,
  LATERAL (SELECT (r.l_t - w.l_t <= 10 OR (r.l_t - w.l_t <= 15 AND o.on_)) AND r.l_t - cur[1].l <= 60 AS ok) j)
SELECT shot_no, q_t, l_t, round(sim, 6) AS sim, CAST(cluster AS INTEGER) AS cluster FROM w""",
    "sequence_rerank": f"""WITH RECURSIVE {_SHOT}, c AS (SELECT o_custkey, o_orderkey, i, count(*) OVER (PARTITION BY o_custkey) AS n, [s, e * 0.7, e + 90] AS m, list_transform([score, CAST(0.6 AS DOUBLE), CAST(0.4 AS DOUBLE)], lambda x: x / greatest(score, 0.6)) AS r FROM shot),
f AS (SELECT o_custkey, i, m, r, list_append(r, CAST(-0.3 AS DOUBLE)) AS v, CAST(NULL AS INTEGER[]) AS tr FROM c WHERE i = 1
  UNION ALL SELECT c.o_custkey, c.i, c.m, c.r, list_append(list_transform(g.g, lambda x: list_max(x)), list_max(f.v) - 0.3), list_append(list_transform(g.g, lambda x: list_position(x, list_max(x))), list_position(f.v, list_max(f.v)))
  FROM f JOIN c ON c.o_custkey = f.o_custkey AND c.i = f.i + 1, LATERAL (SELECT list_transform([1, 2, 3], lambda j: list_append(list_transform([1, 2, 3], lambda k: f.v[k] + c.r[j] - 0.001 * greatest(0, f.m[k] - c.m[j])), f.v[4] - 0.3 + c.r[j] - 0.001 * greatest(0, c.i - c.m[j]))) AS g) g),
b AS (SELECT f.o_custkey, f.i, tr, list_position(v, list_max(v)) AS k FROM f JOIN (SELECT o_custkey, max(i) AS i FROM c GROUP BY 1) l ON l.o_custkey = f.o_custkey AND l.i = f.i
  UNION ALL SELECT f.o_custkey, f.i, f.tr, b.tr[b.k] FROM b JOIN f ON f.o_custkey = b.o_custkey AND f.i = b.i - 1)
SELECT c.o_custkey, c.o_orderkey, CAST(CASE WHEN n >= 2 AND k <= 3 THEN k - 1 END AS INTEGER) AS choice, CASE WHEN n >= 2 AND k <= 3 THEN c.r[k] END AS norm, n >= 2 AND k <= 3 AND abs(c.m[k] - c.m[1]) > 0.5 AS changed FROM c JOIN b ON b.o_custkey = c.o_custkey AND b.i = c.i""",
    "trim_overlaps": f"""WITH RECURSIVE {_SHOT}, n AS (SELECT o_custkey, list({{'k': o_orderkey, 'a': s, 'b': e, 'p': CAST(i AS DOUBLE), 'q': i + CAST(1 AS DOUBLE), 'x': false}} ORDER BY i) AS todo FROM shot GROUP BY 1),
w AS (SELECT o_custkey, todo, todo[1:0] AS done FROM n
  UNION ALL SELECT o_custkey, CASE WHEN z.tail AND c.lo THEN list_concat([z.t, c.c], c.rest) WHEN z.tail THEN list_concat([z.t], c.rest) ELSE c.rest END,
    CASE WHEN c.l IS NULL THEN [c.c] WHEN z.tail AND c.lo THEN list_append(c.before, z.o) WHEN c.lo THEN list_concat(c.before, [z.o, z.i]) ELSE list_concat(c.before, [z.i, z.o]) END
  FROM w, LATERAL (SELECT todo[1] AS c, todo[2:] AS rest, done[len(done)] AS l, done[1:len(done) - 1] AS before, coalesce(done[len(done)].a <= todo[1].a, true) AS lo) c,
  LATERAL (SELECT CASE WHEN c.lo THEN c.l ELSE c.c END AS o, CASE WHEN c.lo THEN c.c ELSE c.l END AS i, c.l IS NOT NULL AND c.c.p - c.l.q <= 0.05 AND least(c.l.b, c.c.b) > greatest(c.l.a, c.c.a) AS met) m,
  LATERAL (SELECT m.o.a AS a, m.o.b AS b, m.i.a AS c, m.i.b AS d, least(greatest((m.i.a + m.o.b) / 2, m.o.a + 0.04), m.i.b - 0.04) AS mid) v,
  LATERAL (SELECT CASE WHEN NOT m.met THEN 'none' WHEN v.b < v.d THEN CASE WHEN v.mid - v.a >= 0.04 AND v.d - v.mid >= 0.04 THEN 'shared' ELSE 'none' END
    WHEN v.c - v.a >= 0.04 AND v.b - v.d >= 0.04 THEN 'both' WHEN v.c - v.a >= 0.04 THEN 'head' WHEN v.b - v.d >= 0.04 THEN 'tail' WHEN v.b - v.a >= 0.08 THEN 'half' ELSE 'none' END AS how, m.o.p + (m.o.q - m.o.p) * (v.c - v.a) / greatest(v.b - v.a, 1e-9) AS at) h,
  LATERAL (SELECT h.how = 'both' AS tail, {{'k': m.o.k, 'a': v.d, 'b': v.b, 'p': h.at, 'q': m.o.q, 'x': true}} AS t,
    {{'k': m.o.k, 'a': CASE WHEN h.how = 'tail' THEN v.d ELSE v.a END, 'b': CASE WHEN h.how IN ('both', 'head') THEN v.c WHEN h.how = 'half' THEN (v.a + v.b) / 2 WHEN h.how = 'shared' THEN v.mid ELSE v.b END, 'p': m.o.p, 'q': CASE WHEN h.how = 'both' THEN h.at ELSE m.o.q END, 'x': m.o.x}} AS o,
    {{'k': m.i.k, 'a': CASE h.how WHEN 'tail' THEN v.a WHEN 'half' THEN (v.a + v.b) / 2 WHEN 'shared' THEN v.mid ELSE v.c END, 'b': CASE WHEN h.how IN ('head', 'half') THEN v.b ELSE v.d END, 'p': m.i.p, 'q': m.i.q, 'x': m.i.x}} AS i) z
  WHERE len(todo) > 0),
d AS (SELECT o_custkey, unnest(done) AS c FROM w WHERE len(todo) = 0)
SELECT d.o_custkey, o_orderkey, CAST(i AS INTEGER) AS i, score, CAST(format('{{:.3f}}', c.a) AS DOUBLE) AS start, CAST(format('{{:.3f}}', c.b) AS DOUBLE) AS "end", CAST(format('{{:.3f}}', c.p) AS DOUBLE) AS q_start, CAST(format('{{:.3f}}', c.q) AS DOUBLE) AS q_end, c.x AS inserted FROM d JOIN shot ON shot.o_orderkey = c.k""",
}
