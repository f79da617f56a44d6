"""Registered queries of false hits, support, shots inside located spans, exact starts, ordered search and stage tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.operators import apply, evaluate, ordered, shot_split, starts
from splicefind.operators.components import reliable
from splicefind.plans import fixtures as fx
from splicefind.plans.editing import _SHOT, _shots
from splicefind.plans.refining import _COS, _bags
from splicefind.sources.stage_cache import StageCache, fingerprint

HARD, DEPTH = -0.12, 0.12  # the test vectors are nearly orthogonal
SPLIT = {"hard": HARD, "depth": DEPTH, "agree": 0.4, "near": 12.0, "margin": 0.02}
LEAST = 0.3  # cosine of mutual neighbours among eights of a vector
ORDER = {"coarse": 0.060, "support": 0.65, "refined": 0.030, "reaches": (3.0, 8.0), "back": 2.0, "lock": 2}


def _part(spark, d):
    """Odd spans of a customer are true (or, in the second use, not in the library), even ones are found; every seventh order says that it is not there."""
    s = _shots(spark, d).withColumns({"q_start": F.col("i").cast("double"), "q_end": F.when(F.col("i") % 2 == 1, F.col("i") + 2.0).otherwise(F.col("i") + F.when(F.col("o_orderkey") % 3 == 0, 1.5).otherwise(0.9))})
    found = s.where("i % 2 = 0").withColumn("rejected", F.col("o_orderkey") % 7 == 0)
    return s.where("i % 2 = 1"), found.withColumn("start", F.when(F.col("o_orderkey") % 5 == 0, F.col("end") - 0.005).otherwise(F.col("start")))


def false_hits(spark, d):
    """Spans that are not in the library and what was found for them all the same."""
    negative, found = _part(spark, d)
    return evaluate.false_hits(negative.withColumnRenamed("o_orderkey", "negative_id"), found, "o_custkey", 4.0)


def span_support(spark, d):
    truth, found = _part(spark, d)
    return evaluate.supported(found, truth, "o_custkey", "o_orderkey", 60.0)


def valley_shots(spark, d):
    """The shots of each query film by steps and valleys of its rows."""
    return shot_split.cut_shots(fx.shots(spark, d), ["shot_no"], HARD, DEPTH)


def _parents(spark, d):
    best = fx.hits(spark, d, 1).groupBy("shot_no").agg(F.max_by("l_t", F.struct("sim", -F.col("l_t"))).alias("c"))
    ends = fx.shots(spark, d).groupBy("shot_no").agg(F.min("t").alias("q_start"), (F.max("t") + 1).alias("q_end"))
    start = F.greatest(F.lit(0.0), F.col("c") - F.lit(10.0))
    return best.join(ends, "shot_no").select("shot_no", "q_start", "q_end", start.alias("start"), (start + F.when(F.expr("shot_no % 35 = 5"), 0.0).otherwise(20.0)).alias("end"))


def shot_splits(spark, d):
    """Spans around each film's best hit as their shots, those moved whose rows agree."""
    out = shot_split.split_shots(_parents(spark, d), fx.shots(spark, d), fx.library(spark, d), "shot_no", **SPLIT)
    return out.select("shot_no", "child", "q_start", "q_end", "start", "end", "refined", "parent_start")


def _matched(spark, d):
    p = _parents(spark, d)
    first = _bags(fx.shots(spark, d)).join(p.select("shot_no", F.col("q_start").alias("t")), ["shot_no", "t"]).select("shot_no", "patches")
    return starts.mutual_matches(p, first, _bags(fx.library(spark, d)), least=LEAST, step=1.0)


def start_matches(spark, d):
    return _matched(spark, d)


def start_finalists(spark, d):
    return starts.finalists(_matched(spark, d)).select("shot_no", "start", "candidate", "matches", "rank", "current")


def settled_starts(spark, d):
    """The finalists counted a second time by cosines of a higher bound; what is left of the matches are the inliers."""
    last = reliable(starts.finalists(_matched(spark, d)).drop("inliers"))
    p = _parents(spark, d)
    first = _bags(fx.shots(spark, d)).join(p.select("shot_no", F.col("q_start").alias("t")), ["shot_no", "t"]).select("shot_no", "patches")
    again = starts.mutual_matches(p, first, _bags(fx.library(spark, d)), least=LEAST + 0.15, step=1.0).select("shot_no", "candidate", F.col("matches").alias("inliers"))
    rows = last.join(again, ["shot_no", "candidate"]).withColumn("ratio", F.col("inliers") / F.greatest(F.col("matches"), F.lit(1)))
    return starts.settled_start(rows, matches=2, inliers=1, gain=1)


def ordered_starts(spark, d):
    """Customers' order lines as films: places of 40 columns scored for each order, then placed in order."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("place"), F.col("l_discount").cast("double").alias("sim")).join(o, "l_orderkey")
    sims = reliable(lines.groupBy("o_custkey", "o_orderdate", "l_orderkey", F.col("l_linenumber").alias("row"), "place").agg(F.max("sim").alias("sim")))
    keys = ["o_custkey", "o_orderdate", "l_orderkey"]
    scored = apply.score_starts(sims, sims.select(*keys, F.col("place").alias("start")), keys, 6, 40, 0.05)
    lists = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.round("coarse", 9).alias("coarse"), F.round("support", 9).alias("support"), F.round("refined", 9).alias("refined")))).alias("candidates"))
    films = lists.withColumn("duration", F.lit(2.0))
    return ordered.ordered_search(films, ["o_custkey"], ["o_orderdate", "l_orderkey"], 40.0, ["o_custkey", "l_orderkey"], **ORDER)


def cached_stages(spark, d):
    """The shots of `valley_shots` by way of a stage table: built by the first run on these tables, read back by later ones."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/_stages"
    key = fingerprint(spark, [f"{d}/embeddings.parquet"], hard=HARD, depth=DEPTH)
    return StageCache(spark, root).stage(key, "shots", lambda: valley_shots(spark, d))


def sub_spans(spark, d):
    """Three sub spans a located span, those of enough cover kept with their places."""
    s = _shots(spark, d)
    part = lambda k: F.struct((F.col("start") + k).alias("start"), (F.col("end") + k).alias("end"), F.round(F.pmod(F.col("score") * (k + 1), F.lit(1.0)), 4).alias("cover"))
    kept = s.withColumn("subs", apply.strong_subs(F.array(*[part(k) for k in range(3)]), 0.5))
    return kept.select("o_orderkey", F.explode("subs").alias("x")).select("o_orderkey", F.round("x.start", 4).alias("start"), F.round("x.end", 4).alias("end"), "x.cover")


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_PART = f"""{_SHOT}, a AS (SELECT *, i * 1.0 AS qs, CASE WHEN i % 2 = 1 THEN i + 2.0 ELSE i + CASE WHEN o_orderkey % 3 = 0 THEN 1.5 ELSE 0.9 END END AS qe FROM shot),
tr AS (SELECT * FROM a WHERE i % 2 = 1), fd AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN e - 0.005 ELSE s END AS s) FROM a WHERE i % 2 = 0 AND o_orderkey % 7 <> 0) WHERE e - s > 0.01)"""
_C = _COS.format(a="lf", b="f")
_VALLEY = f"""fr AS (SELECT shot_no, t, f, round({_C}, 9) AS c FROM (SELECT *, lag(f) OVER (PARTITION BY shot_no ORDER BY t) AS lf FROM qry)),
fc AS (SELECT *, coalesce(c < {HARD}, false) OR coalesce(c < least(pc, nc) - {DEPTH} AND pc IS NOT NULL AND nc IS NOT NULL, false) AS cut FROM (SELECT *, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM fr WINDOW w AS (PARTITION BY shot_no ORDER BY t))),
fp AS (SELECT *, count(*) OVER (PARTITION BY shot_no, piece) AS n, row_number() OVER (PARTITION BY shot_no, piece ORDER BY t) AS z FROM (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY shot_no ORDER BY t) AS piece FROM fc)),
fs AS (SELECT shot_no, t, f, CAST(sum(CAST(n >= 2 AND z = 1 AS INT)) OVER (PARTITION BY shot_no ORDER BY t) - 1 AS INT) AS shot FROM fp)"""
_PARENTS = f"""{fx.hits_sql(1)}, par AS (SELECT shot_no, q0, q1, greatest(0.0, c - 10) AS s, greatest(0.0, c - 10) + CASE WHEN shot_no % 35 = 5 THEN 0.0 ELSE 20.0 END AS e
  FROM (SELECT shot_no, arg_max(l_t, (sim, -l_t)) AS c FROM hits GROUP BY 1) JOIN (SELECT shot_no, min(t) AS q0, max(t) + 1 AS q1 FROM qry GROUP BY 1) USING (shot_no))"""
_SIM = _COS.format(a="a.f", b="l.f")


def _matches_sql(least: float, name: str) -> str:
    """CTE ``name`` (shot_no, start, candidate, matches)."""
    return f"""{name}_c AS (SELECT shot_no, s, l.t - least(0.25, (q1 - q0) * 0.1) AS cand, q.f AS qf, l.f AS lf FROM par JOIN qry q USING (shot_no) JOIN lib l ON l.t BETWEEN greatest(0.0, s - 4) AND s + 4 + least(0.25, (q1 - q0) * 0.1) + 1 WHERE q.t = q0),
{name}_p AS (SELECT c.shot_no, c.s, c.cand, i, j, round({_COS.format(a="qf[i * 8 + 1 : i * 8 + 8]", b="lf[j * 8 + 1 : j * 8 + 8]")}, 9) AS v FROM {name}_c c, range(8) x(i), range(8) y(j) WHERE abs(cand - s) <= 4.051),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY shot_no, cand, i ORDER BY v DESC, j) AS a, row_number() OVER (PARTITION BY shot_no, cand, j ORDER BY v DESC, i) AS b FROM {name}_p),
{name} AS (SELECT shot_no, s AS start, cand AS candidate, count(*) FILTER (a = 1 AND b = 1 AND v >= {least}) AS matches FROM {name}_r GROUP BY ALL)"""


_FINAL = f"""{_matches_sql(LEAST, "mm")}, rk AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY matches DESC, abs(candidate - start), candidate) AS rank, row_number() OVER (PARTITION BY shot_no ORDER BY round(abs(candidate - start), 9), candidate) AS near FROM mm),
fin AS (SELECT shot_no, start, candidate, matches, CAST(rank AS INTEGER) AS rank, near = 1 AS current FROM rk WHERE rank <= 5 OR near = 1)"""
_SHOTS_SQL = f"WITH {fx.QRY}, {_VALLEY} SELECT shot_no, shot, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM fs WHERE shot >= 0 GROUP BY ALL"
SQL = {
    "false_hits": f"""WITH {_PART} SELECT t.o_orderkey AS negative_id, count(f.o_orderkey) AS spans, count(f.o_orderkey) > 0 AS false_hit
FROM tr t LEFT JOIN fd f ON f.o_custkey = t.o_custkey AND greatest(0, least(t.qe, f.qe) - greatest(t.qs, f.qs)) / greatest(1e-6, t.qe - t.qs) >= 0.5 GROUP BY 1""",
    "span_support": f"""WITH {_PART} SELECT f.o_orderkey, EXISTS (SELECT 1 FROM tr t WHERE t.o_custkey = f.o_custkey AND (greatest(0, least(t.e, f.e) - greatest(t.s, f.s)) / greatest(1e-6, f.e - f.s) >= 0.3 OR (f.s + f.e) / 2 BETWEEN t.s - 15 AND t.e + 15)) AS supported FROM fd f""",
    "valley_shots": _SHOTS_SQL,
    "cached_stages": _SHOTS_SQL,
    "sub_spans": f"""WITH {_SHOT} SELECT o_orderkey, round(s + k, 4) AS start, round(e + k, 4) AS "end", round((score * (k + 1)) % 1, 4) AS cover FROM shot, range(3) r(k) WHERE round((score * (k + 1)) % 1, 4) >= 0.5""",
    "start_matches": f"WITH {_PARENTS}, {_matches_sql(LEAST, 'mm')} SELECT * FROM mm",
    "start_finalists": f"WITH {_PARENTS}, {_FINAL} SELECT * FROM fin",
    "settled_starts": f"""WITH {_PARENTS}, {_FINAL}, {_matches_sql(LEAST + 0.15, "m2")}, g AS (SELECT f.*, m2.matches AS inliers, m2.matches / greatest(f.matches, 1) AS ratio FROM fin f JOIN m2 ON m2.shot_no = f.shot_no AND m2.candidate = f.candidate),
top AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY inliers DESC, matches DESC, abs(candidate - start), candidate) AS z FROM g),
o AS (SELECT t.*, n.inliers AS cur, t.matches >= 2 AND t.inliers >= greatest(1, n.inliers + 1) AND t.ratio >= 0.2 AND abs(t.candidate - t.start) >= 0.005 AS moved FROM top t JOIN g n ON n.shot_no = t.shot_no AND n.current WHERE z = 1)
SELECT shot_no, start, CASE WHEN moved THEN round(candidate, 2) ELSE start END AS new_start, cur AS current_inliers, inliers AS best_inliers, matches, round(ratio, 4) AS ratio, moved FROM o""",
    "shot_splits": f"""WITH {_PARENTS}, {_VALLEY}, fit AS (SELECT * FROM par WHERE e - s > 0.01),
sp AS (SELECT *, lead(s0) OVER (PARTITION BY shot_no ORDER BY shot) AS nx, count(*) OVER (PARTITION BY shot_no) AS n FROM (SELECT shot_no, shot, min(t) AS s0, max(t) AS s1 FROM fs WHERE shot >= 0 GROUP BY ALL)),
kd AS (SELECT x.*, b0 - q0 + s AS p0, b1 - q0 + s AS p1, (s + e) / 2 AS mid FROM (SELECT sp.shot_no, shot, s0, s1, q0, q1, s, e, coalesce((s1 + nx) / 2, q1) AS b1, coalesce(lag((s1 + nx) / 2) OVER (PARTITION BY sp.shot_no ORDER BY shot), q0) AS b0 FROM sp JOIN fit ON fit.shot_no = sp.shot_no WHERE n >= 2) x),
a AS (SELECT kd.*, fs.t, fs.f FROM fs JOIN kd ON kd.shot_no = fs.shot_no AND kd.shot = greatest(fs.shot, 0)),
bs AS (SELECT a.shot_no, a.shot, a.t, arg_max(l.t, (round({_SIM}, 9), -l.t)) - a.t AS off FROM a JOIN lib l ON l.t BETWEEN mid - 30 AND mid + 30 GROUP BY a.shot_no, a.shot, a.t),
md AS (SELECT shot_no, shot, median(off) AS med, list(off) AS offs FROM bs GROUP BY ALL),
mv AS (SELECT a.*, med - (s - q0) AS d FROM a JOIN md ON md.shot_no = a.shot_no AND md.shot = a.shot WHERE len(offs) >= 2 AND len(list_filter(offs, lambda o: abs(o - med) <= {SPLIT["near"]})) / len(offs) >= {SPLIT["agree"]} AND abs(med - (s - q0)) >= 0.5),
ty AS (SELECT *, p0 + (p1 - p0) * (t - s0) / greatest(1e-9, s1 - s0) + way * d AS pos FROM mv, range(2) w(way)),
vs AS (SELECT a.shot_no, a.shot, a.way, a.d, coalesce(max(round({_SIM}, 9)), 0) AS v FROM ty a LEFT JOIN lib l ON l.t BETWEEN greatest(mid - 30, pos - 1) AND least(mid + 30, pos + 1) GROUP BY a.shot_no, a.shot, a.way, a.d, a.t),
tk AS (SELECT shot_no, shot, d FROM vs GROUP BY ALL HAVING round(avg(v) FILTER (way = 1) - avg(v) FILTER (way = 0), 9) > {SPLIT["margin"]}),
ch AS (SELECT kd.shot_no, kd.shot AS child, round(b0, 3) AS q_start, round(b1, 3) AS q_end, round(p0 + coalesce(d, 0), 3) AS start, round(greatest(p1 + coalesce(d, 0), p0 + coalesce(d, 0) + 0.05), 3) AS "end", d IS NOT NULL AS refined, s AS parent_start FROM kd LEFT JOIN tk ON tk.shot_no = kd.shot_no AND tk.shot = kd.shot WHERE kd.shot_no IN (SELECT shot_no FROM bs))
SELECT * FROM ch UNION ALL SELECT shot_no, 0, q0, q1, s, e, false, s FROM par WHERE shot_no NOT IN (SELECT shot_no FROM ch)""",
    "ordered_starts": f"""WITH RECURSIVE sm AS (SELECT o_custkey, o_orderdate, l_orderkey, l_linenumber AS r, l_partkey % 40 AS c, max(CAST(l_discount AS DOUBLE)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
w AS (SELECT DISTINCT l_orderkey, c AS a, c AS lo, least(40, c + 7) AS hi FROM sm),
ce AS (SELECT w.*, r, c, v FROM w JOIN sm USING (l_orderkey) WHERE hi - lo >= 2 AND c >= lo AND c < hi),
tp AS (SELECT l_orderkey, a, r, max(v) AS b, arg_min(c, (-v, c)) - any_value(lo) AS g FROM ce GROUP BY ALL),
pr AS (SELECT l_orderkey, a, avg(b) AS coarse, avg(CAST(b >= 0.05 AS DOUBLE)) AS support, floor(median(g)) AS m FROM tp GROUP BY ALL),
fi AS (SELECT l_orderkey, a, avg(x) AS refined FROM (SELECT ce.l_orderkey, ce.a, r, max(v) AS x FROM ce JOIN pr ON pr.l_orderkey = ce.l_orderkey AND pr.a = ce.a WHERE c BETWEEN lo + greatest(0, m - 1) AND lo + m + 1 GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT w.l_orderkey, CAST(w.a AS DOUBLE) AS s, round(coalesce(coarse, -1), 9) AS ca, round(coalesce(support, -1), 9) AS cb, round(coalesce(refined, -1), 9) AS cc FROM w LEFT JOIN pr ON pr.l_orderkey = w.l_orderkey AND pr.a = w.a LEFT JOIN fi ON fi.l_orderkey = w.l_orderkey AND fi.a = w.a),
li AS (SELECT l_orderkey, list({{'k': -ca, 's': s, 'a': ca, 'b': cb, 'c': cc}} ORDER BY ca DESC, s) AS c FROM sc GROUP BY 1),
fm AS (SELECT o_custkey, l_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey) AS i, c FROM (SELECT DISTINCT o_custkey, o_orderdate, l_orderkey FROM sm) JOIN li USING (l_orderkey)),
wk AS (SELECT o_custkey, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS VARCHAR) AS reg, 0 AS run, false AS lock FROM (SELECT DISTINCT o_custkey FROM fm)
 UNION ALL SELECT fm.o_custkey, fm.i, fm.l_orderkey, g.x.s, g.x.reg, CASE WHEN g.x IS NULL THEN 0 WHEN wk.p IS NULL THEN 1 WHEN g.x.s >= wk.p - 1e-6 THEN wk.run + 1 ELSE 0 END,
  g.x IS NOT NULL AND (wk.lock OR CASE WHEN wk.p IS NULL THEN 1 WHEN g.x.s >= wk.p - 1e-6 THEN wk.run + 1 ELSE 0 END >= {ORDER["lock"]})
 FROM wk JOIN fm ON fm.o_custkey = wk.o_custkey AND fm.i = wk.i + 1, LATERAL (SELECT list_filter([
   CASE WHEN wk.p IS NOT NULL THEN {{'reg': '3', 'x': list_filter(fm.c, lambda k: k.s >= greatest(0.0, wk.p + 2 - 2) AND k.s <= least(40.0, wk.p + 2 + 3) - 2)[1]}} END,
   CASE WHEN wk.p IS NOT NULL THEN {{'reg': '8', 'x': list_filter(fm.c, lambda k: k.s >= greatest(0.0, wk.p + 2 - 2) AND k.s <= least(40.0, wk.p + 2 + 8) - 2)[1]}} END,
   {{'reg': CASE WHEN wk.p IS NULL THEN 'global' ELSE 'rest' END, 'x': fm.c[1]}}],
   lambda y: y.x IS NOT NULL AND y.x.a >= {ORDER["coarse"]} AND y.x.b >= {ORDER["support"]} AND y.x.c >= {ORDER["refined"]} AND NOT (wk.p IS NOT NULL AND wk.lock AND y.x.s < wk.p - 2))[1] AS y) h,
  LATERAL (SELECT CASE WHEN h.y IS NULL THEN NULL ELSE {{'s': h.y.x.s, 'reg': h.y.reg}} END AS x) g)
SELECT o_custkey, l_orderkey, p AS placed, CASE WHEN p IS NOT NULL THEN least(40.0, p + 2) END AS placed_end, reg AS region, run AS in_order, lock AS locked FROM wk WHERE i > 0""",
}
