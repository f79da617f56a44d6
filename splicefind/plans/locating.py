"""Registered queries of the full localiser, and their SQL.

Events are the threes of the scenes; similarities of the test vectors are small, so thresholds are lower than the operators' own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids
from splicefind.operators import evidence
from splicefind.plans import fixtures as fx

OPTIONS = {"least_sim": fx.LEAST, "best": 4, "budget": 50, "event_best": 2, "event_budget": 90, "area_sim": 0.02}
AREA_LEAST = OPTIONS["area_sim"]


def _events(spark, d):
    rows = fx.library(spark, d).withColumn("scene_no", F.floor(F.col("t") / 60).cast("long"))
    span = rows.groupBy("scene_no").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    return span.join(centroids(rows, ["scene_no"], out="feature"), "scene_no")


def _located(spark, d, **options):
    lib, shots = fx.library(spark, d), fx.shots(spark, d)
    return evidence.locate(shots, lib, fx.scenes(spark, d), _events(spark, d), 0.2, **{**OPTIONS, **options})


def frame_units(spark, d):
    units, members = evidence.frame_clusters(fx.shots(spark, d), fx.library(spark, d), least_sim=fx.LEAST)
    return units.join(members.groupBy("shot_no", "unit_no").agg(F.sum("q_t").alias("rows")), ["shot_no", "unit_no"]).withColumn("at", F.round("at", 6))


def recall_pools(spark, d):
    """Scenes by their frames' similarity and events by their own, frames taken up to a budget."""
    lib = fx.library(spark, d)
    middles = centroids(fx.shots(spark, d), ["shot_no"], out="feature").withColumn("t", F.col("shot_no").cast("double"))
    scenes = evidence.recall_units(middles, fx.scenes(spark, d), lib, 4, 50, 2, AREA_LEAST).withColumn("kind", F.lit("scene"))
    return scenes.unionByName(evidence.recall_units(middles, _events(spark, d), lib, 2, 90, 2, AREA_LEAST, False).withColumn("kind", F.lit("event")))


def evidence_spans(spark, d):
    """Every unit's span after fine localisation with its own query rows, weak ones marked."""
    lib, shots = fx.library(spark, d), fx.shots(spark, d)
    units, own = evidence.all_units(shots, lib, fx.scenes(spark, d), _events(spark, d), **OPTIONS)
    out = evidence.located_units(units, evidence.unit_cover(units, own, lib), 0.2)
    return out.select(*evidence.KEYS, "n", "nq", "start", "end", "cover", "sim", "weak")


def settled_evidence(spark, d):
    units, _ = _located(spark, d, moments=False)
    return units.select(*evidence.KEYS, "start", "end", "cover", "sim", "rank", "base")


def located_shots(spark, d):
    """One result a shot; the third is a text card, the fourth could not be read, the last has no rows that look like anything."""
    units, moments = _located(spark, d)
    shots = fx.shots(spark, d).groupBy("shot_no").agg(F.min("t").alias("q_start"), (F.max("t") + 1).alias("q_end"), F.count("*").alias("nq"))
    shots = shots.withColumns({"card": F.expr("shot_no % 25 = 10"), "failed": F.when(F.expr("shot_no % 25 = 15"), "unreadable")})
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("shot_no"), F.lit(0.0).alias("q_start"), F.lit(1.0).alias("q_end"), F.lit(1).cast("long").alias("nq"), F.lit(False).alias("card"), F.lit(None).cast("string").alias("failed"))
    out = evidence.assemble(shots.unionByName(extra), units, moments)
    return out.withColumn("n_subs", F.size(F.coalesce("sub_spans", F.array().cast(out.schema["sub_spans"].dataType)))).withColumn("reasons", F.array_join("reasons", ",")).drop("sub_spans")


def shot_parts(spark, d):
    """Parts of the shots that fall apart at large steps."""
    return evidence.sub_shots(fx.shots(spark, d), 1.0).groupBy("parent", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def part_locations(spark, d):
    return evidence.relocate_by_parts(fx.shots(spark, d), fx.library(spark, d), 1.0, run_sim=0.05, least_rows=1, least_sim=0.2)


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_COS = "list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * greatest(sqrt(list_dot_product({b}, {b})), 1e-8))"
_CTR = "ctr AS (SELECT shot_no, list(x ORDER BY p) AS m FROM (SELECT shot_no, p, avg(x) AS x FROM (SELECT shot_no, unnest(f) AS x, unnest(range(len(f))) AS p FROM qry) GROUP BY ALL) GROUP BY shot_no)"


def _area_sql(name: str, size: int) -> str:
    """CTE ``name`` (u, s, e, f): the library in stretches of ``size`` seconds with their mean vectors."""
    return f"""{name} AS (SELECT u, min(t) AS s, max(t) + 1 AS e, any_value(m) AS f FROM (SELECT CAST(floor(t / {size}) AS BIGINT) AS u, t FROM lib) JOIN
  (SELECT u, list(x ORDER BY p) AS m FROM (SELECT u, p, avg(x) AS x FROM (SELECT CAST(floor(t / {size}) AS BIGINT) AS u, unnest(f) AS x, unnest(range(len(f))) AS p FROM lib) GROUP BY ALL) GROUP BY u) USING (u) GROUP BY u)"""


def _pool_sql(name: str, areas: str, best: int, budget: int, by_frames: bool, least: float) -> str:
    """CTEs of the recall units of ``areas``: ``name`` (shot_no, u, c0, c1, s, e, n)."""
    gate = f"(SELECT avg({_COS.format(a='l.f', b='c.m')}) FROM lib l, ctr c WHERE c.shot_no = g.shot_no AND list_contains(g.ts, l.t))" if by_frames else "g.sim"
    return f"""{name}h AS (SELECT * FROM (SELECT shot_no, u, sim, row_number() OVER (PARTITION BY shot_no ORDER BY sim DESC, u) AS k FROM (SELECT shot_no, u, round({_COS.format(a="m", b="f")}, 9) AS sim FROM ctr, {areas})) WHERE k <= {best}),
{name}r AS (SELECT u, t, row_number() OVER (PARTITION BY u ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY u) AS n FROM {areas} JOIN lib ON t >= s AND t < e),
{name}p AS (SELECT h.*, n, greatest(0, least(n, {budget} - coalesce(sum(n) OVER (PARTITION BY shot_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM {name}h h JOIN (SELECT DISTINCT u, n FROM {name}r) USING (u)),
{name}t AS (SELECT p.shot_no, p.u, p.sim, r.t FROM {name}p p JOIN {name}r r USING (u) WHERE take > 0 AND (take = p.n OR (take = 1 AND i = 0) OR (take > 1 AND i IN (SELECT CAST(floor(j * (p.n - 1) / (take - 1) + 1e-9) AS BIGINT) FROM range(CAST(take AS BIGINT)) q(j))))),
{name}g AS (SELECT shot_no, u, any_value(sim) AS sim, min(t) AS c0, max(t) AS c1, count(*) AS n, list(t) AS ts FROM {name}t GROUP BY ALL),
{name} AS (SELECT shot_no, u, c0, c1, s, e, n FROM {name}g g JOIN {areas} USING (u) WHERE n >= 2 AND round({gate}, 9) >= {least})"""


_FRAMES = f"""{fx.hits_sql(1)}, {fx.CLUSTERS}, fu AS (SELECT shot_no, CAST(cluster_no AS BIGINT) AS u, min(l_t) AS c0, max(l_t) AS c1, count(*) AS n, avg(l_t) AS mid, min(q_t) AS q0, max(q_t) AS q1, list(q_t) AS qs FROM clus GROUP BY ALL HAVING count(*) >= 2 AND avg(sim) >= {fx.LEAST})"""
_UNITS = f"""{_FRAMES}, {_CTR}, {_area_sql("sc", 20)}, {_area_sql("ev", 60)}, {_pool_sql("ps", "sc", 4, 50, True, AREA_LEAST)}, {_pool_sql("pe", "ev", 2, 90, False, AREA_LEAST)},
un AS (SELECT shot_no, 0 AS kind, u, c0, c1, greatest(0, c0 - 15) AS lo, c1 + 15 AS hi, n, n AS nq FROM fu UNION ALL SELECT shot_no, 1, u, c0, c1, greatest(0, s - 15), e + 15, n, 0 FROM ps UNION ALL SELECT shot_no, 2, u, c0, c1, greatest(0, s - 15), e + 15, n, 0 FROM pe),
uq AS (SELECT fu.shot_no, 0 AS kind, u, f FROM fu JOIN qry ON qry.shot_no = fu.shot_no AND list_contains(qs, qry.t) UNION ALL SELECT un.shot_no, kind, u, m FROM un JOIN ctr USING (shot_no) WHERE kind > 0),
cv AS (SELECT un.shot_no, un.kind, un.u, l.t, round(max({_COS.format(a="l.f", b="uq.f")}), 9) AS cover FROM un JOIN lib l ON l.t BETWEEN lo AND hi JOIN uq ON uq.shot_no = un.shot_no AND uq.kind = un.kind AND uq.u = un.u GROUP BY ALL),
cs AS (SELECT *, round(CASE WHEN count(*) OVER k < 3 THEN avg(cover) OVER k ELSE avg(cover) OVER (PARTITION BY shot_no, kind, u ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 9) AS cs FROM cv WINDOW k AS (PARTITION BY shot_no, kind, u)),
rn AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY shot_no, kind, u ORDER BY t) AS run FROM (SELECT *, cs >= 0.2 AS ok, lag(cs >= 0.2) OVER (PARTITION BY shot_no, kind, u ORDER BY t) AS before FROM cs)),
rs AS (SELECT *, row_number() OVER (PARTITION BY shot_no, kind, u ORDER BY len DESC, a) AS o FROM (SELECT shot_no, kind, u, run, min(t) AS a, max(t) AS b, count(*) AS len, avg(cs) AS sim FROM rn WHERE ok GROUP BY ALL)),
tt AS (SELECT shot_no, kind, u, avg(CAST(ok AS INTEGER)) AS bc FROM rn GROUP BY ALL),
lu AS (SELECT un.*, round(CASE WHEN un.kind = 2 THEN a ELSE least(c0, coalesce(a, c0)) END, 2) AS s, round(CASE WHEN un.kind = 2 THEN b ELSE greatest(c1, coalesce(b, c1)) END, 2) AS e, round(CASE WHEN a IS NULL THEN 0 ELSE bc END, 3) AS cover, round(sim, 3) AS sim
  FROM un LEFT JOIN (SELECT * FROM rs WHERE o = 1) r ON r.shot_no = un.shot_no AND r.kind = un.kind AND r.u = un.u LEFT JOIN tt ON tt.shot_no = un.shot_no AND tt.kind = un.kind AND tt.u = un.u)"""
SQL = {
    "pool_frames": f"""WITH {fx.LIB}, {fx.QRY}, {_CTR}, {_area_sql("sc", 20)}, {_pool_sql("ps", "sc", 5, 50, False, -2)}
SELECT t.shot_no, t.u AS scene_no, CAST(k AS INTEGER) AS rank, count(*) AS n, min(t) AS first, max(t) AS last FROM pst t JOIN psh h ON h.shot_no = t.shot_no AND h.u = t.u GROUP BY ALL""",
    "frame_units": f"WITH {_FRAMES} SELECT shot_no, u AS unit_no, c0, c1, n, round(mid, 6) AS \"at\", q0 AS q_start, q1 AS q_end, list_sum(qs) AS rows FROM fu",
    "recall_pools": f"""WITH {fx.LIB}, {fx.QRY}, {_CTR}, {_area_sql("sc", 20)}, {_area_sql("ev", 60)}, {_pool_sql("ps", "sc", 4, 50, True, AREA_LEAST)}, {_pool_sql("pe", "ev", 2, 90, False, AREA_LEAST)}
SELECT shot_no, u AS unit_no, c0, c1, s AS start, e AS "end", n, 'scene' AS kind FROM ps UNION ALL SELECT shot_no, u, c0, c1, s, e, n, 'event' FROM pe""",
    "evidence_spans": f"WITH {_UNITS} SELECT shot_no, kind, u AS unit_no, n, nq, s AS start, e AS \"end\", cover, sim, cover < 0.30 AND coalesce(sim < 0.45, true) AS weak FROM lu",
    "shot_parts": f"""WITH {fx.QRY}, r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY shot_no) AS n, lead(f) OVER w AS nf FROM qry WINDOW w AS (PARTITION BY shot_no ORDER BY t)),
c AS (SELECT shot_no, i + 1 AS i, (i + 1) - row_number() OVER (PARTITION BY shot_no ORDER BY i) AS g FROM r WHERE nf IS NOT NULL AND round(1 - list_cosine_similarity(f, nf), 9) > 1 AND n >= 6),
k AS (SELECT shot_no, i FROM (SELECT *, min(i) OVER (PARTITION BY shot_no, g) AS fst FROM c) WHERE (i - fst) % 2 = 0),
p AS (SELECT r.shot_no, r.t, r.n, sum(CASE WHEN k.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.shot_no ORDER BY r.i) AS part FROM r LEFT JOIN k ON k.shot_no = r.shot_no AND k.i = r.i),
m AS (SELECT *, max(part) OVER (PARTITION BY shot_no) + 1 AS parts FROM p)
SELECT shot_no AS parent, CAST(part AS INTEGER) AS part, min(t) AS first, max(t) AS last, count(*) AS n FROM m WHERE parts >= 3 AND n >= 6 GROUP BY ALL""",
}
