"""Registered queries of re-ranking by patches, and their SQL.

A frame's patches are the eights of its vector; a shot's main span lies around its best hit, moved back for
two shots of three so that there is something to mend.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids
from splicefind.operators import opinion, patches
from splicefind.operators.retrieval import top_k
from splicefind.plans import fixtures as fx
from splicefind.sources import second_index

BEST = 6  # patch maxima averaged: few enough to leave some out


def _bags(df):
    return df.withColumn("patches", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("feature", k * 8 + 1, F.lit(8))))


def _mains(spark, d):
    best = fx.hits(spark, d, 1).groupBy("shot_no").agg(F.max_by("l_t", F.struct("sim", -F.col("l_t"))).alias("c"))
    ends = fx.shots(spark, d).groupBy("shot_no").agg(F.min("t").alias("q_start"), (F.max("t") + 1).alias("q_end"))
    mid = F.greatest(F.lit(1.0), F.col("c") - 8 * (F.expr("shot_no div 5") % 3))
    return best.join(ends, "shot_no").select("shot_no", (mid - 1).alias("start"), (mid + 1).alias("end"), "q_start", "q_end")


def _reps(spark, d, n, digits=2):
    return patches.representatives(_mains(spark, d), _bags(fx.shots(spark, d)), n, digits)


def late_interaction(spark, d):
    """Every shot's three representatives against ten places of the library."""
    asks = _mains(spark, d).select("shot_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k * 37.5)).alias("at"))
    out = patches.late_scores(_reps(spark, d, 3), asks, _bags(fx.library(spark, d)), BEST)
    return out.select("shot_no", "at", "l_t", *[F.round(c, 6).alias(c) for c in ("cosine", "stacked", "per_frame")])


def patch_reranks(spark, d):
    spans = fx.spans(spark, d).select("shot_no", F.col("cluster_no").alias("place"), "start", "end", F.col("mean_sim").alias("sim"))
    mains = _mains(spark, d).join(spans.groupBy("shot_no").agg((F.count("*") > 1).alias("montage")), "shot_no", "left")
    middle = centroids(fx.shots(spark, d), ["shot_no"], out="feature").withColumn("t", F.lit(0.0))
    pool = top_k(middle, fx.library(spark, d), 20).select("shot_no", F.col("l_t").alias("t"), "sim")
    out = patches.patch_rerank(mains, spans, pool, _reps(spark, d, 3), _bags(fx.library(spark, d)), best=BEST)
    return out.withColumn("score", F.round("score", 6))


def nearfield_rescues(spark, d):
    out = patches.nearfield_rescue(_mains(spark, d), _reps(spark, d, 3), _bags(fx.library(spark, d)), margin=0.02, best=BEST)
    return out.withColumn("margin", F.round("margin", 6))


def patch_refines(spark, d):
    lib = fx.library(spark, d)
    out = patches.patch_refine(_mains(spark, d), _reps(spark, d, 5, None), lib, _bags(lib), best=BEST)
    return out.withColumns({"lead": F.round("lead", 6), "vote_lead": F.round("vote_lead", 6)})


def _second(column="feature"):
    """Another feature of a frame: the last half of its vector, backwards."""
    return F.slice(F.reverse(F.col(column)), 1, F.lit(32))


def _asked(spark, d):
    frames = fx.library(spark, d).select("t", _second().alias("feature"))
    return _mains(spark, d), _reps(spark, d, 3, None).withColumn("second", _second()), fx.library(spark, d), frames


def second_index_rows(spark, d):
    """The grid of the second feature, one row for two seconds, in clusters of 60 s; rows of one label could not be read."""
    rows = fx.table(spark, d, "embeddings").where("label <> 3").select((F.col("vec_id") % 2).cast("string").alias("source_id"), (F.col("vec_id") + F.lit(0.5)).alias("t"), F.when(F.expr("(vec_id div 60) % 4 <> 1"), F.col("embedding")).alias("feature"))
    return second_index.grid_rows(rows, 0.5, cluster=60.0).select("source_id", "t", F.round(F.get("feature", F.lit(0)).cast("double"), 6).alias("x"))


def second_opinions(spark, d):
    return opinion.second_opinion(*_asked(spark, d)).withColumn("lead", F.round("lead", 6))


def indexed_opinions(spark, d):
    """The same with the scan's steps taken from an index of the second feature."""
    mains, reps, lib, frames = _asked(spark, d)
    index = second_index.grid_rows(frames.withColumn("source_id", F.lit("film"))).drop("source_id")
    return opinion.second_opinion(mains, reps, lib, frames, index=index, margin=0.02).withColumn("lead", F.round("lead", 6))


def wide_scans(spark, d):
    """The peaks of a scan of 40 s around each main place, without other candidates."""
    mains, reps, _, frames = _asked(spark, d)
    mids = mains.select("shot_no", ((F.col("start") + F.col("end")) / 2).alias("now")).withColumn("mid", F.col("now"))
    return opinion.wide_peaks(mids, reps, frames, 40.0)


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_CUT = "SELECT {head}, unnest([f[k * 8 + 1 : k * 8 + 8] for k in range(8)]) AS v, unnest(range(8)) AS k FROM {rows}"
_COS = "list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * greatest(sqrt(list_dot_product({b}, {b})), 1e-8))"
_MAINS = f"""{fx.hits_sql(1)}, best AS (SELECT shot_no, arg_max(l_t, (sim, -l_t)) AS c, any_value(q0) AS q0, any_value(q1) AS q1 FROM hits JOIN (SELECT shot_no, min(t) AS q0, max(t) + 1 AS q1 FROM qry GROUP BY 1) USING (shot_no) GROUP BY shot_no),
mains AS (SELECT shot_no, greatest(1.0, c - 8 * ((shot_no // 5) % 3)) AS now, q0, q1 FROM best)"""


def _reps_sql(n: int, digits: int = 2) -> str:
    return f"""rep AS (SELECT shot_no, i, {f"round(q0 + (q1 - q0) * (i + 0.5) / {n}, {digits})" if digits else f"q0 + (q1 - q0) * (i + 0.5) / {n}"} AS a FROM mains, range({n}) r(i)),
reps AS (SELECT x.shot_no, x.i, x.a, q.f FROM (SELECT rep.shot_no, i, a, coalesce(min(t) FILTER (t >= a), max(t)) AS ft FROM rep JOIN qry ON qry.shot_no = rep.shot_no GROUP BY ALL) x JOIN qry q ON q.shot_no = x.shot_no AND q.t = x.ft),
qp AS ({_CUT.format(head="shot_no, i", rows="reps")}), cp AS ({_CUT.format(head="t", rows="lib")})"""


def _late_sql(asks: str) -> str:
    """CTE late (shot_no, a, lt, cosine, stacked, per_frame) of the pairs (shot_no, a) of ``asks``."""
    return f"""placed AS (SELECT shot_no, a, coalesce(min(t) FILTER (t >= a), max(t)) AS lt FROM (SELECT DISTINCT shot_no, a FROM {asks}), lib GROUP BY ALL),
pk AS (SELECT p.shot_no, p.a, r.i, r.k, max({_COS.format(a="r.v", b="c.v")}) AS pk FROM placed p JOIN qp r ON r.shot_no = p.shot_no JOIN cp c ON c.t = p.lt GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY shot_no, a ORDER BY pk DESC) AS z, row_number() OVER (PARTITION BY shot_no, a, i ORDER BY pk DESC) AS zi FROM pk),
late AS (SELECT p.shot_no, p.a, p.lt, round(c.v, 9) AS cosine, round(s.v, 9) AS stacked, round(e.v, 9) AS per_frame FROM placed p
  JOIN (SELECT p.shot_no, p.a, avg({_COS.format(a="r.f", b="l.f")}) AS v FROM placed p JOIN reps r ON r.shot_no = p.shot_no JOIN lib l ON l.t = p.lt GROUP BY ALL) c ON c.shot_no = p.shot_no AND c.a = p.a
  JOIN (SELECT shot_no, a, avg(pk) AS v FROM rk WHERE z <= {BEST} GROUP BY ALL) s ON s.shot_no = p.shot_no AND s.a = p.a
  JOIN (SELECT shot_no, a, avg(m) AS v FROM (SELECT shot_no, a, i, avg(pk) AS m FROM rk WHERE zi <= {BEST} GROUP BY ALL) GROUP BY ALL) e ON e.shot_no = p.shot_no AND e.a = p.a)"""


def _centre_sql(rows: str, name: str) -> str:
    return f"{name} AS (SELECT shot_no, list(x ORDER BY p) AS m FROM (SELECT shot_no, p, avg(x) AS x FROM (SELECT shot_no, unnest(f) AS x, unnest(range(len(f))) AS p FROM {rows}) GROUP BY ALL) GROUP BY shot_no)"


_SEC = "list_reverse(f)[1:32]"


def _looks_sql(name: str, asks: str, frames: str = "lib") -> str:
    """CTE ``name`` (shot_no, a, score) of the pairs (shot_no, a) of ``asks``."""
    return f"""{name}_p AS (SELECT shot_no, a, coalesce(min(t) FILTER (t >= a), max(t)) AS lt FROM (SELECT DISTINCT shot_no, a FROM {asks}), {frames} GROUP BY ALL),
{name} AS (SELECT p.shot_no, p.a, round(avg({_COS.format(a="list_reverse(r.f)[1:32]", b="list_reverse(l.f)[1:32]")}), 9) AS score FROM {name}_p p JOIN reps r ON r.shot_no = p.shot_no JOIN {frames} l ON l.t = p.lt GROUP BY ALL)"""


def _peaks_sql(steps: str, index: str | None = None) -> str:
    """CTE picked (shot_no, pk) of the scan's ``steps`` (shot_no, now, t) and the taken middles ``used`` (shot_no, l)."""
    coarse = _looks_sql("lc", "(SELECT shot_no, t AS a FROM stp)", index or "lib")
    return f"""stp AS ({steps}), fin AS (SELECT shot_no, t, round(lo + (t + 2 - lo) * (i + 0.5) / n, 3) AS a FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(0, t - 2) AS lo, greatest(2, CAST(ceil(t + 2 - greatest(0, t - 2)) AS INTEGER)) AS n FROM stp))),
{_looks_sql("lf", "fin")}, {coarse},
tp AS (SELECT f.shot_no, f.t, arg_min(f.a, (-x.score, f.a)) AS pk FROM fin f JOIN lf x ON x.shot_no = f.shot_no AND x.a = f.a GROUP BY ALL),
od AS (SELECT tp.*, row_number() OVER (PARTITION BY tp.shot_no ORDER BY c.score DESC, tp.t) AS z FROM tp JOIN lc c ON c.shot_no = tp.shot_no AND c.a = tp.t),
wk AS (SELECT shot_no, 0::BIGINT AS z, l AS used, []::DOUBLE[] AS pks FROM used UNION ALL
  SELECT wk.shot_no, od.z, CASE WHEN c.ok THEN list_append(used, od.pk) ELSE used END, CASE WHEN c.ok THEN list_append(pks, od.pk) ELSE pks END FROM wk JOIN od ON od.shot_no = wk.shot_no AND od.z = wk.z + 1, LATERAL (SELECT len(pks) < 3 AND len(list_filter(used, lambda m: abs(od.t - m) <= 2)) = 0 AS ok) c),
picked AS (SELECT shot_no, arg_max(pks, z) AS pks FROM wk GROUP BY shot_no)"""


def _grid_sql(radius: int) -> str:
    return f"""SELECT DISTINCT shot_no, now, t FROM (SELECT shot_no, now, round(lo + (now + {radius} - lo) * i / (n - 1), 3) AS t FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT shot_no, now, greatest(0, now - {radius}) AS lo, greatest(2, CAST(ceil((now + {radius} - greatest(0, now - {radius})) / 2) AS INTEGER) + 1) AS n FROM mains))) WHERE abs(t - now) > 1e-6"""


def _opinion_sql(steps: str, margin: float, index: str | None = None) -> str:
    return f"""{_centre_sql("reps", "ctr")}, sc AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, t) AS z FROM (SELECT shot_no, t, round({_COS.format(a="m", b="f")}, 9) AS sim FROM ctr, lib)),
g AS (SELECT shot_no, z, [t] AS kept, [sim] AS sims FROM sc WHERE z = 1 UNION ALL
  SELECT g.shot_no, sc.z, CASE WHEN c.ok THEN list_append(kept, sc.t) ELSE kept END, CASE WHEN c.ok THEN list_append(sims, sc.sim) ELSE sims END FROM g JOIN sc ON sc.shot_no = g.shot_no AND sc.z = g.z + 1, LATERAL (SELECT len(list_filter(kept, lambda k: abs(k - sc.t) < 3)) = 0 AS ok) c WHERE len(kept) < 5),
pick AS (SELECT shot_no, arg_max(kept, len(kept)) AS kept, arg_max(sims, len(sims)) AS sims FROM g GROUP BY shot_no),
used AS (SELECT shot_no, now, CASE WHEN abs(kept[1] - now) <= 2 AND round(sims[1] - coalesce(sims[2], 0), 9) >= 0.03 THEN [now] WHEN len(list_filter(kept, lambda k: abs(k - now) < 0.5)) = 0 THEN list_prepend(now, kept) ELSE kept END AS l FROM mains JOIN pick USING (shot_no)),
{_peaks_sql(steps, index)},
md AS (SELECT shot_no, mid, min(place) AS place, bool_and(wide) AS wide FROM (SELECT shot_no, unnest(l) AS mid, unnest(range(len(l))) AS place, false AS wide FROM used UNION ALL SELECT shot_no, unnest(pks), unnest(range(len(pks))) + 1000, true FROM picked) GROUP BY shot_no, mid),
mw AS (SELECT md.*, now, (q1 - q0) / 2 AS half, greatest(0, mid - (q1 - q0) / 2 - 1.5) AS lo, mid + (q1 - q0) / 2 + 1.5 AS hi FROM md JOIN mains USING (shot_no)),
aw AS (SELECT shot_no, mid, round(lo + (hi - lo) * (i + 0.5) / n, 3) AS a FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(2, CAST(ceil(hi - lo) AS INTEGER)) AS n FROM mw))), {_looks_sql("lw", "aw")},
ms AS (SELECT mw.shot_no, now, half, place, mw.mid, wide, max(score) AS score FROM mw JOIN aw ON aw.shot_no = mw.shot_no AND aw.mid = mw.mid JOIN lw ON lw.shot_no = aw.shot_no AND lw.a = aw.a GROUP BY ALL),
mm AS (SELECT shot_no, arg_min(score, (abs(mid - now), place)) AS main FROM ms GROUP BY 1), ot AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY score DESC, mid) AS o FROM ms WHERE abs(mid - now) > 0.5)
SELECT shot_no, now, mid, round(score - main, 6) AS lead, wide, round(score - main, 9) >= {margin} AS moved, round(mid - half, 3) AS start, round(mid + half, 3) AS "end" FROM ot JOIN mm USING (shot_no) WHERE o = 1"""


SQL = {
    "late_interaction": f"""WITH {_MAINS}, {_reps_sql(3)}, asks AS (SELECT shot_no, k * 37.5 AS a FROM mains, range(10) r(k)), {_late_sql("asks")}
SELECT shot_no, CAST(a AS DOUBLE) AS "at", lt AS l_t, round(cosine, 6) AS cosine, round(stacked, 6) AS stacked, round(per_frame, 6) AS per_frame FROM late""",
    "patch_reranks": f"""WITH {_MAINS}, {_reps_sql(3)}, {fx.CLUSTERS},
spans AS (SELECT shot_no, cluster_no, min(l_t) AS s, max(l_t) AS e, avg(sim) AS sim FROM clus GROUP BY ALL HAVING count(*) >= 2 AND avg(sim) >= {fx.LEAST}),
{_centre_sql("qry", "ctr")}, pool AS (SELECT * FROM (SELECT shot_no, t, sim, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, t) AS z FROM (SELECT shot_no, t, round({_COS.format(a="m", b="f")}, 9) AS sim FROM ctr, lib)) WHERE z <= 20),
st AS (SELECT *, sum(b) OVER (PARTITION BY shot_no ORDER BY z ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY shot_no ORDER BY z) > 8 THEN 1 ELSE 0 END AS b FROM pool)),
cand AS (SELECT shot_no, round((s + e) / 2, 1) AS mid, 0 AS kind, -cluster_no AS place, s AS x, e AS y FROM spans UNION ALL SELECT shot_no, round(avg(t), 1), 1, run, min(t), max(t) + 1 FROM st GROUP BY shot_no, run),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shot_no, mid ORDER BY kind, place) AS w FROM cand) WHERE w = 1),
ss AS (SELECT shot_no, list(sim ORDER BY sim DESC) AS l FROM spans GROUP BY 1), n AS (SELECT shot_no, count(*) AS n FROM win GROUP BY 1),
asks AS (SELECT win.shot_no, mid, (x + y) / 2 AS a, now FROM win JOIN mains USING (shot_no) JOIN n USING (shot_no) LEFT JOIN ss USING (shot_no) WHERE n > 1 OR coalesce(l[1] - l[2] < 0.10, false) OR coalesce(len(l) > 1, false) OR coalesce(l[1] < 0.60, false)),
{_late_sql("asks")}, top AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY stacked DESC, mid) AS o FROM asks JOIN late USING (shot_no, a))
SELECT shot_no, mid, round(stacked, 6) AS score, round(mid - 1, 2) AS start, round(mid + 1, 2) AS "end", abs(mid - now) > 8 AS moved FROM top WHERE o = 1""",
    "nearfield_rescues": f"""WITH {_MAINS}, {_reps_sql(3)}, grid AS (SELECT DISTINCT shot_no, now, greatest(0.0, round(now + k * 4, 2)) AS a FROM mains, range(-7, 8) r(k)), asks AS (SELECT shot_no, a FROM grid UNION SELECT shot_no, now FROM mains), {_late_sql("asks")},
top AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY stacked DESC, a) AS o FROM grid JOIN late USING (shot_no, a)), lead AS (SELECT t.shot_no, t.a, t.now, round(t.stacked - m.stacked, 9) AS lead FROM top t JOIN late m ON m.shot_no = t.shot_no AND m.a = t.now WHERE o = 1)
SELECT shot_no, a AS "at", round(lead, 6) AS margin, round(a - 1, 2) AS start, round(a + 1, 2) AS "end", lead > 0.02 AND abs(a - now) <= 30 AS moved FROM lead""",
    "patch_refines": f"""WITH RECURSIVE {_MAINS}, {_reps_sql(5, 0)}, {_centre_sql("reps", "ctr")},
sc AS (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, t) AS z FROM (SELECT shot_no, t, round({_COS.format(a="m", b="f")}, 9) AS sim FROM ctr, lib)),
g AS (SELECT shot_no, z, [t] AS kept, [sim] AS sims FROM sc WHERE z = 1 UNION ALL
  SELECT g.shot_no, sc.z, CASE WHEN c.ok THEN list_append(kept, sc.t) ELSE kept END, CASE WHEN c.ok THEN list_append(sims, sc.sim) ELSE sims END FROM g JOIN sc ON sc.shot_no = g.shot_no AND sc.z = g.z + 1, LATERAL (SELECT len(list_filter(kept, lambda k: abs(k - sc.t) < 3)) = 0 AS ok) c WHERE len(kept) < 5),
pick AS (SELECT shot_no, arg_max(kept, len(kept)) AS kept, arg_max(sims, len(sims)) AS sims FROM g GROUP BY shot_no),
ev AS (SELECT shot_no, now, q0, q1, abs(kept[1] - now) <= 2 AND round(sims[1] - coalesce(sims[2], 0), 9) >= 0.03 AS clr, CASE WHEN len(list_filter(kept, lambda k: abs(k - now) < 0.5)) = 0 THEN list_prepend(now, kept) ELSE kept END AS l FROM mains JOIN pick USING (shot_no)),
el AS (SELECT shot_no, now, CASE WHEN clr THEN [l[1], l[2], now] ELSE l[1:6] END AS l FROM ev),
mid AS (SELECT shot_no, now, mid, min(place) AS place FROM (SELECT shot_no, now, unnest(l) AS mid, unnest(range(len(l))) AS place FROM el) WHERE mid IS NOT NULL GROUP BY ALL),
gr AS (SELECT *, greatest(0, mid - 5) AS lo, mid + 5 AS hi, greatest(6, CAST(floor(mid + 5 - greatest(0, mid - 5)) AS INTEGER)) AS n FROM mid),
asks AS (SELECT shot_no, now, mid, place, lo + (hi - lo) * (i + 0.5) / n AS a FROM (SELECT *, unnest(range(n)) AS i FROM gr)), {_late_sql("asks")},
pt AS (SELECT shot_no, now, mid, place, max(round(0.45 * cosine + 0.55 * per_frame, 9)) AS score FROM asks JOIN late USING (shot_no, a) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shot_no ORDER BY score DESC, place) AS o FROM pt) WHERE o = 1),
mn AS (SELECT shot_no, arg_max(score, place) AS main FROM pt WHERE abs(mid - now) <= 0.5 GROUP BY 1),
pl AS (SELECT shot_no, mid FROM top UNION SELECT shot_no, now FROM top),
vt AS (SELECT shot_no, mid, avg(s) AS v FROM (SELECT pl.shot_no, mid, r.i, max(round({_COS.format(a="r.f", b="l.f")}, 9)) AS s FROM pl JOIN mains m ON m.shot_no = pl.shot_no JOIN reps r ON r.shot_no = pl.shot_no JOIN lib l ON l.t BETWEEN r.a + mid - (m.q0 + m.q1) / 2 - 1 AND r.a + mid - (m.q0 + m.q1) / 2 + 1 GROUP BY ALL) GROUP BY ALL),
o AS (SELECT top.*, q0, q1, round(score - main, 9) AS lead, round(coalesce(a.v, 0) - coalesce(b.v, 0), 9) AS vote_lead FROM top JOIN mn USING (shot_no) JOIN (SELECT shot_no, q0, q1 FROM mains) USING (shot_no) LEFT JOIN vt a ON a.shot_no = top.shot_no AND a.mid = top.mid LEFT JOIN vt b ON b.shot_no = top.shot_no AND b.mid = top.now)
SELECT shot_no, now, mid, round(lead, 6) AS lead, round(vote_lead, 6) AS vote_lead, (lead >= 0.05 OR (lead >= 0.025 AND vote_lead >= 0.05)) AND abs(mid - now) > 0.5 AS moved, round(mid - (q1 - q0) / 2, 3) AS start, round(mid + (q1 - q0) / 2, 3) AS "end" FROM o""",
    "wide_scans": f"""WITH RECURSIVE {_MAINS}, {_reps_sql(3, 0)}, used AS (SELECT shot_no, [now] AS l FROM mains), {_peaks_sql(_grid_sql(40))}
SELECT shot_no, CAST(unnest(range(len(pks))) AS INTEGER) AS pick, unnest(pks) AS mid FROM picked""",
    "second_opinions": f"""WITH RECURSIVE {_MAINS}, {_reps_sql(3, 0)}, {_opinion_sql(_grid_sql(90), 0.05)}""",
    "indexed_opinions": f"""WITH RECURSIVE {_MAINS}, {_reps_sql(3, 0)}, ix0 AS (SELECT k::DOUBLE AS t, (SELECT min(t) FROM lib WHERE t >= k) AS lt FROM range((SELECT CAST(max(t) AS BIGINT) + 1 FROM lib)) r(k)),
ix AS (SELECT ix0.t, lib.f FROM ix0 JOIN lib ON lib.t = lt WHERE floor(lt / 120) = floor(ix0.t / 120)), {_opinion_sql("SELECT shot_no, now, t FROM mains, ix WHERE t BETWEEN now - 90 AND now + 90", 0.02, "ix")}""",
    "second_index_rows": """WITH fr AS (SELECT CAST(vec_id % 2 AS VARCHAR) AS source_id, vec_id + 0.5::DOUBLE AS t, embedding[1] AS x FROM embeddings WHERE label <> 3 AND (vec_id // 60) % 4 <> 1),
tg AS (SELECT source_id, unnest(range(CAST(floor(max(t) * 0.5 + 1e-9) AS BIGINT) + 1)) * 2.0::DOUBLE AS t FROM fr GROUP BY 1), mt AS (SELECT g.source_id, g.t, arg_min(x, fr.t) AS x, min(fr.t) AS ft FROM tg g JOIN fr ON fr.source_id = g.source_id AND fr.t >= g.t GROUP BY ALL)
SELECT source_id, t, round(CAST(x AS DOUBLE), 6) AS x FROM mt WHERE floor(ft / 60) = floor(t / 60)""",
}
