"""Registered queries over applied repairs, lookups, predicates and evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions import scalars as S
from splicefind.operators import apply, folds, grading, intervals, repair, timeseries
from splicefind.operators.asof import nearest
from splicefind.plans import fixtures as fx
from splicefind.plans.editing import _E, _NB, _SHOT, _sessions, _shots


def _level(score):
    return F.when(score >= 0.75, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")


def ambiguous_rows(spark, d):
    s = _shots(spark, d).withColumn("level", _level(F.col("score")))
    return apply.temporal_ambiguity(s, ["o_custkey"], "i", "o_orderkey", 180.0, 300.0).select("o_orderkey", "level", "ambiguous")


def temporal_repairs(spark, d):
    """Outliers moved within the similarities that the customer's order lines give."""
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    sims = lines.groupBy("o_custkey", F.round(F.pmod("l_extendedprice", F.lit(1000.0)), 2).alias("t")).agg(F.max(F.col("l_discount").cast("double")).alias("sim"))
    out = apply.temporal_repair(_shots(spark, d), sims, ["o_custkey"], "i", "o_orderkey", 100.0, 1, 180.0, 300.0)
    return out.select("o_orderkey", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "repaired")


def batched_lookup(spark, d):
    """First event of a user at or after each of its orders' minutes (users and customers of one number)."""
    want = _shots(spark, d).select(F.col("o_custkey").alias("k"), "o_orderkey", "start")
    have = _shots(spark, d).select(F.col("o_custkey").alias("k"), "end", F.col("o_orderkey").alias("found"))
    out = apply.lookup(want, have, ["k"], "start", "end", ["found"], width=100.0)
    return out.select("o_orderkey", F.col("match.at").alias("at"))


def sparse_grid(spark, d):
    want = _shots(spark, d).select(F.col("o_custkey").alias("k"), "o_orderkey", F.floor("start").cast("double").alias("t"))
    have = _shots(spark, d).select(F.col("o_custkey").alias("k"), F.round(F.col("start") - 0.25, 2).alias("f"))
    out = apply.grid_lookup(want, have, ["k"], "t", "f", [], 2.0)
    return out.select("o_orderkey", F.col("match.at").alias("at"))


def span_iou(spark, d):
    w = W.partitionBy("o_custkey").orderBy("i")
    s = _shots(spark, d).withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w))
    return s.select("o_orderkey", F.round(intervals.iou("start", "end", "s2", "e2"), 6).alias("iou"))


def answerable_rows(spark, d):
    s = _shots(spark, d).withColumns({"excluded": F.col("o_orderkey") % 3 == 0, "manual": F.when(F.col("o_orderkey") % 5 == 0, True), "end": F.when(F.col("o_orderkey") % 7 != 0, F.col("end"))})
    return s.select("o_orderkey", grading.answerable(s).alias("ok"))


def frame_times(spark, d):
    p = fx.table(spark, d, "part")
    return p.select("p_partkey", S.micros(F.col("p_partkey") / 8).alias("us"), F.round(S.frames_to_seconds("p_size", F.lit(24000), F.lit(1001)), 9).alias("seconds"))


def least_durations(spark, d):
    s = _shots(spark, d).select("o_custkey", "o_orderkey", "start", "end")
    marks = _shots(spark, d).select("o_custkey", (F.floor(F.col("start") / 5) * 5.0).alias("mark")).distinct()
    return repair.least_duration(s, marks, ["o_custkey"]).select("o_orderkey", "least_s")


def coarse_skips(spark, d):
    s = _shots(spark, d)
    return s.select("o_orderkey", repair.coarse_skip(F.col("score") / 10, F.col("start") % 7 - 3.5).alias("skip"))


def frame_verdicts(spark, d):
    s = _shots(spark, d)
    bright = F.round(F.col("score") / 2, 4)
    card = apply.card_frame(1 - bright, bright, F.when(F.col("i") % 2 == 0, F.pmod("start", F.lit(96.0))), F.when(F.col("i") % 2 == 0, F.col("score") / 50))
    return s.select("o_orderkey", card.alias("card"), apply.flash_frame(F.col("start") / 4, F.col("score")).alias("flash"))


def accepted_choices(spark, d):
    s = _shots(spark, d)
    return s.select("o_orderkey", apply.accept_choice(F.col("score"), F.floor("start").cast("double"), F.col("start")).alias("taken"))


def criteria(spark, d):
    s = _shots(spark, d)
    truth = s.where("i % 2 = 1").select(F.col("o_orderkey").alias("truth_id"), "o_custkey", "start", "end", F.col("i").cast("double").alias("q_start"), F.when(F.col("o_orderkey") % 4 == 0, F.col("i")).otherwise(F.col("i") + 3).cast("double").alias("q_end"))
    results = s.where("i % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("result_id"), (F.col("start") - 100).alias("start"), (F.col("end") + 200).alias("end"), F.col("i").cast("double").alias("q_start"), (F.col("i") + 1).cast("double").alias("q_end"))
    return apply.recall_criteria(truth, results, "o_custkey")


def start_scores(spark, d):
    """Scores of starts over the similarity table of each customer: rows are order lines of one number, places their days."""
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    sims = lines.groupBy("o_custkey", F.col("l_linenumber").alias("row"), F.pmod("l_partkey", F.lit(40)).cast("int").alias("place")).agg(F.max(F.col("l_discount").cast("double")).alias("sim"))
    starts = sims.select("o_custkey", (F.col("place") - 1).alias("start"))
    out = apply.score_starts(sims, starts, ["o_custkey"], 6, 40, 0.05)
    return out.select("o_custkey", "start", *[F.round(c, 6).alias(c) for c in ("coarse", "support", "refined")])


def matched_truths(spark, d):
    """Greedy one-to-one matches of each customer's odd spans with its even ones."""
    s = _shots(spark, d)

    def run(rows):
        truth, found = [r for r in rows if r["i"] % 2], [r for r in rows if not r["i"] % 2]
        return [{"o_custkey": rows[0]["o_custkey"], "truth": truth[a]["o_orderkey"], "found": found[b]["o_orderkey"]} for a, b in folds.match_one_to_one([r["start"] for r in found], [r["start"] for r in truth], 120.0)]

    return folds.fold(s, ["o_custkey"], ["i"], run, "truth long, found long", ["o_custkey"])


def boundary_ap(spark, d):
    """Average precision and recall of each customer's even starts, ranked by score, against its odd ones, at three tolerances."""
    s = _shots(spark, d).withColumn("q_start", F.col("i").cast("double")).withColumn("q_end", F.when(F.col("i") % 2 == 1, F.col("i") + 2.0).otherwise(F.col("i") + 1.5))

    def run(rows):
        truth, found = [r for r in rows if r["i"] % 2], [{**r, "place": r["i"]} for r in rows if not r["i"] % 2]
        pairs = [(delta, folds.boundary_precision(found, truth, delta)) for delta in (30.0, 120.0, 400.0)]
        return [{"o_custkey": rows[0]["o_custkey"], "delta": delta, "n": len(truth), "ap": round(ap, 6), "recall": round(recall, 6)} for delta, (ap, recall) in pairs]

    return folds.fold(s, ["o_custkey"], ["i"], run, "delta double, n long, ap double, recall double", ["o_custkey"])


def box_nms(spark, d):
    """Boxes of a customer's spans that no stronger kept one covers."""
    s = _shots(spark, d).withColumn("x", F.pmod("start", F.lit(50.0)))

    def run(rows):
        kept = folds.box_nms([(r["x"], 0.0, r["x"] + 20, 20.0, r["score"]) for r in rows])
        return [rows[i] for i in kept]

    return folds.fold(s, ["o_custkey"], ["i"], run, columns=["o_custkey", "o_orderkey"])


def strided_rows(spark, d):
    return timeseries.every(fx.series(spark, d), ["user_id"], "seq", 3).select("user_id", "seq")


def even_rows(spark, d):
    return timeseries.evenly(fx.series(spark, d), ["user_id"], "seq", 5).select("user_id", "seq")


def snapped_rows(spark, d):
    """Each session start of a group on the nearest session start of the next one, however far."""
    s = _sessions(spark, d)
    grid = s.select(((F.col("grp") + 1) % 10).alias("grp"), F.col("start").alias("g"))
    return nearest(s.select("grp", "sid", "start"), grid, ["grp"], "start", "g", [], width=24.0).select("sid", F.col("match.at").alias("at"))


def prior_starts(spark, d):
    s = _shots(spark, d)
    seed, ok = F.col("start") + F.col("i") - 3, F.col("score") > 0.5
    a, b = apply.anchored(F.col("start"), F.col("end"), seed, ok, F.lit(900.0))
    return s.select("o_orderkey", F.round(apply.prior_start(F.col("start"), F.col("end"), seed, ok), 4).alias("start"), F.round(a, 4).alias("moved_start"), F.round(b, 4).alias("moved_end"))


def kept_subs(spark, d):
    """Sub spans left after weak ones go, in the rows that the claim gate keeps."""
    s = _shots(spark, d)
    subs = F.array(*[F.struct((F.col("start") + k).alias("start"), (F.col("end") + k).alias("end"), F.round(F.pmod(F.col("score") * (k + 1), F.lit(1.0)), 4).alias("cover")) for k in range(3)])
    return s.select("o_orderkey", F.size(apply.strong_subs(subs, 0.5)).cast("long").alias("n"))


def text_lookup(spark, d):
    """Orders of the parts whose name or brand holds a text, found by their keys."""
    parts = apply.found_by_text(fx.table(spark, d, "part"), ["p_name", "p_brand"], "1")
    lines = fx.table(spark, d, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return lines.groupBy("l_partkey").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_LV = "CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END"
_ODD = "abs(nm - pm) <= 180 AND least(abs(m - pm), abs(m - nm)) >= 300"


def _criteria() -> str:
    out = []
    for name, (side, slack, kind) in apply.CRITERIA.items():
        more = {"base": "false", "any": "o >= 0.5", "overlap": "o >= 0.5 AND o / least(greatest(re - rs, 1e-6), sz) >= 0.5"}[kind]
        spare = 0.5 if side == "wide" else 0.0
        part = f"greatest(0, least(pe, qe + {spare}) - greatest(ps, qs - {spare})) / greatest(qe - qs + {2 * spare}, 1e-6)"
        out.append(f"coalesce(bool_or(q_{side} > 0 AND ((rs >= s - {slack} - 2 AND re <= e + {slack} + 2) OR (rs <= (s + e) / 2 AND re >= (s + e) / 2) OR o / sz >= 0.4 OR ({more}))), false) OR coalesce(sum(CASE WHEN q_{side} > 0 THEN {part} ELSE 0 END) >= 0.5 AND sum(CASE WHEN q_{side} > 0 THEN o / sz ELSE 0 END) >= 0.5, false) AS {name}")
    return ", ".join(out)


_AP_MEET = "least(x.i + 2, f.i + 1.5) - greatest(x.i, f.i) >= 0.5 AND abs(f.s - x.s) <= delta"
_LINES = "ln AS (SELECT o_custkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_discount AS DOUBLE) AS dc FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SQL = {
    "boundary_ap": f"""WITH RECURSIVE {_SHOT}, t AS (SELECT o_custkey, list({{'i': i, 's': s}} ORDER BY i) AS ts, count(*) AS n FROM shot WHERE i % 2 = 1 GROUP BY 1),
f AS (SELECT o_custkey, i, s, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, i) AS z FROM shot WHERE i % 2 = 0),
w AS (SELECT o_custkey, ts, n, delta, 0::BIGINT AS z, []::BIGINT[] AS took FROM t, (SELECT unnest([30.0, 120.0, 400.0])::DOUBLE AS delta) UNION ALL
  SELECT w.o_custkey, ts, n, delta, f.z, CASE WHEN c.p IS NULL THEN took ELSE list_append(took, c.p) END FROM w JOIN f ON f.o_custkey = w.o_custkey AND f.z = w.z + 1, LATERAL (SELECT list_filter(ts, lambda x: NOT list_contains(took, x.i) AND {_AP_MEET})[1].i AS p) c),
b AS (SELECT o_custkey, delta, any_value(n) AS n, max(len(took)) AS k FROM w GROUP BY ALL),
r AS (SELECT o_custkey, delta, count(*) AS k FROM (SELECT DISTINCT x.o_custkey, x.i, delta FROM shot x JOIN f ON f.o_custkey = x.o_custkey, (SELECT unnest([30.0, 120.0, 400.0])::DOUBLE AS delta) WHERE x.i % 2 = 1 AND {_AP_MEET}) GROUP BY ALL)
SELECT b.o_custkey, b.delta, n, round(b.k / n, 6) AS ap, round(coalesce(r.k, 0) / n, 6) AS recall FROM b LEFT JOIN r ON r.o_custkey = b.o_custkey AND r.delta = b.delta""",
    "strided_rows": f"WITH {fx.SERIES} SELECT user_id, CAST(seq AS INTEGER) AS seq FROM ser WHERE seq % 3 = 0",
    "even_rows": f"WITH {fx.SERIES}, n AS (SELECT user_id, count(*) AS n FROM ser GROUP BY 1) SELECT user_id, CAST(seq AS INTEGER) AS seq FROM ser JOIN n USING (user_id) WHERE n <= 5 OR seq IN (SELECT CAST(floor(k * (n - 1) / 4 + 1e-9) AS BIGINT) FROM range(5) t(k))",
    "snapped_rows": f"WITH {_E} SELECT a.sid, arg_min(b.s, (abs(b.s - a.s), b.s)) AS \"at\" FROM ses a LEFT JOIN ses b ON (b.grp + 1) % 10 = a.grp GROUP BY a.sid",
    "prior_starts": f"WITH {_SHOT} SELECT o_orderkey, round(CASE WHEN score > 0.5 AND s + i - 3 < e THEN greatest(s + i - 3, 0) ELSE s END, 4) AS start, round(CASE WHEN score > 0.5 THEN s + i - 3 ELSE s END, 4) AS moved_start, round(CASE WHEN score > 0.5 THEN least(900, s + i - 3 + (e - s)) ELSE e END, 4) AS moved_end FROM shot",
    "kept_subs": f"WITH {_SHOT} SELECT o_orderkey, CAST(round(score % 1, 4) >= 0.5 AS BIGINT) + CAST(round((score * 2) % 1, 4) >= 0.5 AS BIGINT) + CAST(round((score * 3) % 1, 4) >= 0.5 AS BIGINT) AS n FROM shot",
    "text_lookup": "SELECT l_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1') GROUP BY l_partkey",
    "ambiguous_rows": f"WITH {_NB}, k AS (SELECT *, {_LV} AS lv, coalesce({_ODD}, false) AS odd FROM nb) SELECT o_orderkey, CASE WHEN odd AND lv = 'HIGH' THEN 'MEDIUM' ELSE lv END AS level, odd AND lv = 'HIGH' AS ambiguous FROM k",
    "temporal_repairs": f"""WITH {_NB}, {_LINES}, sm AS (SELECT o_custkey, round(l_extendedprice % 1000, 2) AS t, max(dc) AS sim FROM ln GROUP BY ALL), odd AS (SELECT *, least(ps, ns) - 2 AS lo, greatest(pe, ne) + 2 AS hi FROM nb WHERE {_ODD}),
b AS (SELECT o_orderkey, t, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(sim, 9) DESC, t) AS z FROM odd JOIN sm ON sm.o_custkey = odd.o_custkey AND t BETWEEN lo AND hi), f AS (SELECT o_orderkey, t FROM b WHERE z = 1)
SELECT nb.o_orderkey, round(CASE WHEN abs(t + (e - s) / 2 - m) >= 1 THEN t ELSE s END, 4) AS start, round(CASE WHEN abs(t + (e - s) / 2 - m) >= 1 THEN t + (e - s) ELSE e END, 4) AS "end", coalesce(abs(t + (e - s) / 2 - m) >= 1, false) AS repaired FROM nb LEFT JOIN f ON f.o_orderkey = nb.o_orderkey""",
    "batched_lookup": f"WITH {_SHOT} SELECT a.o_orderkey, coalesce(min(b.e) FILTER (b.e >= a.s), max(b.e)) AS \"at\" FROM shot a JOIN shot b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderkey",
    "sparse_grid": f"WITH {_SHOT}, k AS (SELECT a.o_orderkey, floor(a.s) AS t, min(round(b.s - 0.25, 2)) FILTER (round(b.s - 0.25, 2) >= floor(a.s)) AS f FROM shot a JOIN shot b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderkey, a.s) SELECT o_orderkey, CASE WHEN f - t <= 0.5 THEN f END AS \"at\" FROM k",
    "span_iou": f"WITH {_SHOT}, k AS (SELECT *, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM shot WINDOW w AS (PARTITION BY o_custkey ORDER BY i)) SELECT o_orderkey, round(coalesce(CASE WHEN s2 IS NOT NULL THEN greatest(0, least(e, e2) - greatest(s, s2)) / (greatest(e, e2) - least(s, s2)) END, 0), 6) AS iou FROM k",
    "answerable_rows": "SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS ok FROM orders",
    "frame_times": "SELECT p_partkey, CAST(round_even(p_partkey / 8 * 1e6, 0) AS BIGINT) AS us, round(p_size * 1001 / 24000, 9) AS seconds FROM part",
    "least_durations": f"""WITH {_SHOT}, mk AS (SELECT DISTINCT o_custkey, floor(s / 5) * 5.0 AS k FROM shot) SELECT o_orderkey, CAST(CASE WHEN min(abs(k - (s + e) / 2)) <= (e - s) / 2 + 0.2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS least_s FROM shot JOIN mk USING (o_custkey) GROUP BY o_orderkey, s, e""",
    "coarse_skips": f"WITH {_SHOT} SELECT o_orderkey, score / 10 < 0.02 AND abs(s % 7 - 3.5) <= 2 AS skip FROM shot",
    "frame_verdicts": f"WITH {_SHOT}, k AS (SELECT *, round(score / 2, 4) AS b FROM shot) SELECT o_orderkey, b BETWEEN 0.01 AND 0.30 AND 1 - b >= 0.85 AND (i % 2 <> 0 OR (s % 96 <= 48 AND score / 50 >= 0.004)) AS card, s / 4 >= 200 AND score >= 0.5 AS flash FROM k",
    "accepted_choices": f"WITH {_SHOT} SELECT o_orderkey, score >= 0.5 AND abs(floor(s) - s) >= 0.5 AS taken FROM shot",
    "criteria": f"""WITH {_SHOT}, t AS (SELECT o_orderkey AS id, o_custkey, s, e, greatest(e - s, 1e-6) AS sz, i AS qs, CASE WHEN o_orderkey % 4 = 0 THEN i ELSE i + 3 END AS qe FROM shot WHERE i % 2 = 1), r AS (SELECT o_custkey, s - 100 AS rs, e + 200 AS re, i AS ps, i + 1 AS pe FROM shot WHERE i % 2 = 0),
j AS (SELECT t.*, rs, re, ps, pe, greatest(0, least(e, re) - greatest(s, rs)) AS o, greatest(0, least(qe, pe) - greatest(qs, ps)) AS q_strict, greatest(0, least(qe + 0.5, pe) - greatest(qs - 0.5, ps)) AS q_wide, CASE WHEN qe = qs THEN CASE WHEN qs BETWEEN ps AND pe THEN 1e-3 ELSE 0 END ELSE greatest(0, least(qe, pe) - greatest(qs, ps)) END AS q_point FROM t JOIN r ON r.o_custkey = t.o_custkey),
g AS (SELECT id, {_criteria()} FROM j GROUP BY id) SELECT t.id AS truth_id, {", ".join(f"coalesce({n}, false) AS {n}" for n in apply.CRITERIA)} FROM t LEFT JOIN g ON g.id = t.id""",
    "start_scores": f"""WITH {_LINES}, sm AS (SELECT o_custkey, l_linenumber AS r, l_partkey % 40 AS c, max(dc) AS v FROM ln GROUP BY ALL), st AS (SELECT DISTINCT o_custkey, c - 1 AS a FROM sm), w AS (SELECT *, greatest(a, 0) AS lo, least(40, a + 7) AS hi FROM st),
x AS (SELECT w.*, r, c, v FROM w JOIN sm ON sm.o_custkey = w.o_custkey AND c >= lo AND c < hi WHERE hi - lo >= 2), t AS (SELECT o_custkey, a, lo, r, max(v) AS b, arg_min(c, (-v, c)) - min(lo) AS g FROM x GROUP BY o_custkey, a, lo, r),
p AS (SELECT o_custkey, a, avg(b) AS coarse, avg(CAST(b >= 0.05 AS INTEGER)) AS support, floor(median(g)) AS md FROM t GROUP BY ALL), f AS (SELECT o_custkey, a, avg(m) AS refined FROM (SELECT x.o_custkey, x.a, r, max(v) AS m FROM x JOIN p ON p.o_custkey = x.o_custkey AND p.a = x.a WHERE c BETWEEN lo + greatest(0, md - 1) AND lo + md + 1 GROUP BY ALL) GROUP BY ALL)
SELECT st.o_custkey, CAST(st.a AS INTEGER) AS start, round(coalesce(coarse, -1), 6) AS coarse, round(coalesce(support, -1), 6) AS support, round(coalesce(refined, -1), 6) AS refined FROM st LEFT JOIN p ON p.o_custkey = st.o_custkey AND p.a = st.a LEFT JOIN f ON f.o_custkey = st.o_custkey AND f.a = st.a""",
    "box_nms": f"""WITH RECURSIVE {_SHOT}, r AS (SELECT *, s % 50 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, i) AS z FROM shot),
w AS (SELECT o_custkey, o_orderkey, z, [x] AS kept, true AS ok FROM r WHERE z = 1 UNION ALL
  SELECT r.o_custkey, r.o_orderkey, r.z, CASE WHEN c.ok THEN list_append(kept, r.x) ELSE kept END, c.ok FROM w JOIN r ON r.o_custkey = w.o_custkey AND r.z = w.z + 1,
  LATERAL (SELECT len(list_filter(kept, lambda k: greatest(0, least(k + 20, r.x + 20) - greatest(k, r.x) + 1) * 21 / (882 - greatest(0, least(k + 20, r.x + 20) - greatest(k, r.x) + 1) * 21) > 0.4)) = 0 AS ok) c)
SELECT o_custkey, o_orderkey FROM w WHERE ok""",
    "matched_truths": f"""WITH RECURSIVE {_SHOT}, f AS (SELECT o_custkey, list({{'j': i, 's': s, 'k': o_orderkey}} ORDER BY i) AS found FROM shot WHERE i % 2 = 0 GROUP BY 1),
w AS (SELECT o_custkey, found, CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS truth, CAST(NULL AS BIGINT) AS got FROM f
  UNION ALL SELECT w.o_custkey, found, t.i, CASE WHEN c.p IS NULL THEN used ELSE list_append(used, c.p.j) END, t.o_orderkey, c.p.k FROM w JOIN shot t ON t.o_custkey = w.o_custkey AND t.i = w.i + 2,
  LATERAL (SELECT list_sort(list_transform(list_filter(found, lambda x: NOT list_contains(used, x.j) AND abs(x.s - t.s) <= 120), lambda x: {{'d': abs(x.s - t.s), 'j': x.j, 'k': x.k}}))[1] AS p) c)
SELECT o_custkey, truth, got AS found FROM w WHERE got IS NOT NULL""",
}
