"""Registered queries of shots and scenes over the whole library as one series, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.operators import segments
from splicefind.plans import fixtures as fx

WIDTH = 500.0  # seconds of a range


def _rows(spark, d):
    return fx.library(spark, d).withColumn("source", F.lit(0))


def _dense(spark, d):
    """The library with made-up flashes, brightness and cards."""
    n = F.col("t").cast("long")
    return _rows(spark, d).withColumns({"flash": n % 37 == 5, "mean": ((n * 7919) % 256).cast("double"), "card": n % 11 < 3})


def shot_detection(spark, d):
    return segments.shots(_rows(spark, d), ["source"], WIDTH, cut_abs=0.9, z=1.0, least_s=2.0)


def two_level_shots(spark, d):
    return segments.shots(_rows(spark, d), ["source"], WIDTH, True, cut_abs=0.9, z=1.5, least_s=2.0)


def scene_table(spark, d):
    """Scenes out of vector peaks and the places where labels change, gated by histograms of the vectors' eights."""
    rows = _rows(spark, d)
    hist = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(F.slice("feature", k * 8 + 1, F.lit(8)), F.lit(0.0), lambda s, x: s + x * x))
    pixels = rows.select("source", "t", hist.alias("hist"))
    marks = rows.where("cast(t as long) % 7 = 3").select("source", (F.col("t") + 0.4).alias("t"))
    bounds = segments.scene_bounds(rows, marks, pixels, ["source"], WIDTH, cut_abs=1.0, least_s=3.0, apart=2.5, gates={"pixel": {"steady": 0.8}, "semantic": {"steady": 0.6}})
    return segments.scenes(rows, bounds, ["source"], WIDTH).select("source", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def refined_bounds(spark, d):
    """Coarse cuts of every sixth row, away from flashes and spikes, on the largest step around them."""
    rows, _, cuts = segments.coarse_cuts(_dense(spark, d), ["source"], WIDTH, 1.0, cut_abs=0.8, z=0.8, least_s=12.0)
    return segments.refined_cuts(rows, cuts, ["source"])


def two_pass_segments(spark, d):
    return segments.two_pass(_dense(spark, d), ["source"], WIDTH, 1.0, least=6.0, marked=18.0, margin=1.0, cut_abs=0.8, z=0.8, least_s=12.0)


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}


def _cuts_sql(rows: str, cut_abs: float, z: float, gap: str) -> str:
    """CTEs of the cuts of ``rows`` (t, f): kp (k: the distance's place, t, nt), without smoothing."""
    pad = "(sum({x}) OVER (ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(3 - k, 0) * first_value({x}) OVER w + greatest(3 - (n - 1 - k), 0) * last_value({x}) OVER w) / 7"
    return f"""nx AS (SELECT t, f, lead(t) OVER (ORDER BY t) AS nt, lead(f) OVER (ORDER BY t) AS nf, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () - 1 AS n FROM {rows}),
dd AS (SELECT t, nt, k, n, 1 - list_cosine_similarity(f, nf) AS s FROM nx WHERE nf IS NOT NULL),
mm AS (SELECT *, {pad.format(x="s")} AS mu, {pad.format(x="s * s")} AS m2, lag(s) OVER (ORDER BY k) AS ls, lead(s) OVER (ORDER BY k) AS rs FROM dd WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gg AS (SELECT {gap} AS gap FROM (SELECT median(nt - t) AS med FROM dd)),
cc AS (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS z FROM mm WHERE s >= ls AND s >= rs AND s >= {cut_abs} AND (s - mu) / greatest(sqrt(greatest(m2 - mu * mu, 0)), 1e-4) >= {z}),
nm AS (SELECT z, k, t, nt, n, [k] AS kept, true AS ok FROM cc WHERE z = 1 UNION ALL
  SELECT cc.z, cc.k, cc.t, cc.nt, cc.n, CASE WHEN c.ok THEN list_append(kept, cc.k) ELSE kept END, c.ok FROM nm JOIN cc ON cc.z = nm.z + 1, gg, LATERAL (SELECT len(list_filter(kept, lambda j: abs(j - cc.k) < gap)) = 0 AS ok) c),
kp AS (SELECT k, t, nt FROM nm, gg WHERE ok AND k + 1 >= gap AND n + 1 - (k + 1) >= gap)"""


_GAP = "greatest(1, round_even(2.0 / greatest(med, 1e-9), 0))"
SQL = {
    "shot_detection": f"""WITH RECURSIVE {fx.LIB}, {_cuts_sql("lib", 0.9, 1.0, _GAP)},
e AS (SELECT 0 AS p, min(t) AS s, NULL::DOUBLE AS before FROM lib UNION ALL SELECT k + 1, nt, t FROM kp)
SELECT 0 AS source, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS shot, s AS start, coalesce(lead(before) OVER (ORDER BY p), (SELECT max(t) FROM lib)) AS "end", coalesce(lead(p) OVER (ORDER BY p), (SELECT count(*) FROM lib)) - p AS n FROM e""",
    "refined_bounds": f"""WITH RECURSIVE {fx.LIB}, ds AS (SELECT t, f, row_number() OVER (ORDER BY t) - 1 AS place, CAST(t AS BIGINT) % 37 = 5 AS flash, (CAST(t AS BIGINT) * 7919) % 256 AS mean FROM lib),
few AS (SELECT * FROM ds WHERE place % 6 = 0), {_cuts_sql("few", 0.8, 0.8, "greatest(1, round_even(12.0 / 6, 0))")},
sp AS (SELECT t FROM (SELECT t, mean, lag(mean) OVER (ORDER BY t) AS b FROM few) WHERE abs(mean - b) >= 80 AND greatest(mean, b) >= 180 UNION ALL SELECT t FROM few WHERE flash),
ct AS (SELECT nt AS t, (k + 1) * 6 AS place FROM kp WHERE NOT EXISTS (SELECT 1 FROM sp WHERE abs(sp.t - kp.nt) <= 0.25)),
nb AS (SELECT c.t AS cut, d.t, d.f, d.flash, d.place FROM ct c JOIN ds d ON d.place BETWEEN greatest(0, c.place - 20) AND c.place + 20 AND (d.place - greatest(0, c.place - 20)) % 2 = 0),
pr AS (SELECT cut, lead(t) OVER w AS later, round(1 - list_cosine_similarity(f, lead(f) OVER w), 9) AS d, place FROM nb WINDOW w AS (PARTITION BY cut ORDER BY place)),
pk AS (SELECT cut, arg_min(later, (-d, place)) AS x, count(*) AS n FROM pr WHERE later IS NOT NULL GROUP BY cut)
SELECT 0 AS source, ct.t, CASE WHEN n >= 2 AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.cut = ct.t AND flash AND abs(nb.t - x) <= 0.25) THEN x ELSE ct.t END AS refined FROM ct LEFT JOIN pk ON pk.cut = ct.t""",
}
