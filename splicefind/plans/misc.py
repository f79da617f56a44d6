"""Registered queries: whole chains, lookups, grids and small tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicefind.functions import scalars as S
from splicefind.functions import text as X
from splicefind.operators import asof, evaluate, intervals
from splicefind.plans import fixtures as fx
from splicefind.plans import pipelines
from splicefind.plans.editing import _E, _SHOT, _sessions, _shots


def locate_shots(spark, d):
    out = pipelines.locate(fx.shots(spark, d), fx.library(spark, d), least_sim=fx.LEAST, run_sim=fx.LEAST)
    return out.select("shot_no", "mode", F.round("primary.start", 3).alias("start"), F.round("primary.end", 3).alias("end"), F.size("spans").alias("n_spans"), "score", "level")


def _results(spark, d):
    s = _shots(spark, d)
    level = F.when(F.col("score") >= 0.75, "HIGH").when(F.col("score") >= 0.3, "MEDIUM").otherwise("LOW")
    subs = F.array(F.struct((F.col("start") + 50).alias("start"), (F.col("start") + 51.5).alias("end")))
    return s.select("o_custkey", F.col("o_orderkey").alias("seg_index"), F.col("i").cast("double").alias("q_start"), (F.col("i") + 1).cast("double").alias("q_end"), "start", "end", level.alias("level"), subs.alias("subs"))


def channel_plan(spark, d):
    scenes = _shots(spark, d).select("o_custkey", (F.floor(F.col("start") / 10) * 10.0).alias("start"), (F.floor(F.col("start") / 10) * 10.0 + 10).alias("end")).distinct()
    plan = pipelines.channel_plan(_results(spark, d), scenes, ["o_custkey"], 50.0)["plan"]
    return plan.select("o_custkey", "seg_index", "sub_index", "kind", "piece", "q_start", "q_end", "start", "end", "inserted")


def channel_audits(spark, d):
    """The audits of the channel plan before and after its overlaps are trimmed."""
    scenes = _shots(spark, d).select("o_custkey", (F.floor(F.col("start") / 10) * 10.0).alias("start"), (F.floor(F.col("start") / 10) * 10.0 + 10).alias("end")).distinct()
    got = pipelines.channel_plan(_results(spark, d), scenes, ["o_custkey"], 50.0)
    return got["before"].withColumn("step", F.lit("before")).unionByName(got["after"].withColumn("step", F.lit("after")))


def project_files(spark, d):
    """Every customer's spans as an edit list, without scenes."""
    got = pipelines.export_project(_results(spark, d), None, ["o_custkey"], "edl", "cut", "film.mkv")["files"]
    return got.select("o_custkey", "file", F.size(F.split("text", "V     C")).alias("pieces"))


def fragment_warnings(spark, d):
    return intervals.fragment_warnings(_sessions(spark, d), ["grp"]).select("grp", "fragments", F.sha2("warning", 256).alias("digest"))


def fcp_xml(spark, d):
    from splicefind.operators.export import export_plan

    r = _results(spark, d)
    plan = export_plan(r).join(r.select("seg_index", "o_custkey"), "seg_index")
    return pipelines.fcp_xml(plan, ["o_custkey"], "cut", 25.0)


def time_grid(spark, d):
    """The sampling grid of each session: start + k * 0.5 h up to its end."""
    s = _sessions(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / 0.5 + 1e-9).cast("int"))))
    return s.select("sid", "k", F.round(F.col("start") + F.col("k") * 0.5, 4).alias("t"))


def frames_in_scenes(spark, d):
    s = fx.scenes(spark, d).select("scene_no", "start", "end")
    rows = asof.range_join(fx.library(spark, d).select("t"), s, [], "t", "start", "end", 40.0, closed=False)
    return rows.groupBy("scene_no").agg(F.count("*").alias("n"), F.min("t").alias("first"))


def boundary_recall(spark, d):
    """Share of session starts of one group within delta of a start of the next group."""
    s = _sessions(spark, d)
    found = s.select(((F.col("grp") + 1) % 10).alias("grp"), F.col("start").alias("found"))
    near = asof.nearest(s.select("grp", "sid", "start"), found, ["grp"], "start", "found", [])
    gap = F.abs(F.col("match.at") - F.col("start"))
    return near.groupBy("grp").agg(*[F.round(F.avg((gap <= x).cast("double")), 6).alias(f"r{str(x).replace('.', '_')}") for x in (0.1, 0.5, 2.0)])


def content_keys(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return p.select("p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("content"), X.fingerprint("p_name", "p_size").alias("key"))


def media_budgets(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("long") * 200_000_000).alias("free"))
    t = S.memory_tier("free")
    speed = S.segment_speed(F.col("p_partkey") % 5000000 + 100000, F.lit(3000000), F.lit(2.5), F.lit(3.0))
    return p.select("p_partkey", t["workers"].alias("workers"), t["tier"].alias("tier"), F.round(speed, 5).alias("speed"), S.expected_frames(F.col("p_partkey") / 8, F.lit(24000), F.lit(1001)).alias("frames"))


def stage_percent(spark, d):
    """Progress events mapped into their stage's range by a lookup join."""
    stages = spark.createDataFrame([("click", 0.0, 30.0), ("view", 30.0, 50.0), ("purchase", 80.0, 20.0)], "event_type string, base double, span double")
    e = fx.table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 10).alias("done"))
    return e.join(F.broadcast(stages), "event_type").select("event_id", S.interpolate_stage("base", "span", "done", F.lit(10)).alias("percent"))


def error_codes(spark, d):
    """Stable public messages by lookup, with a default for unknown kinds."""
    known = spark.createDataFrame([("click", "E_CLICK"), ("view", "E_VIEW")], "event_type string, code string")
    e = fx.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(known), "event_type", "left").select("event_type", F.coalesce("code", F.lit("E_INTERNAL")).alias("code"), "n")


def last_events(spark, d):
    e = fx.table(spark, d, "events").orderBy(F.desc("event_id")).limit(20)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def clip_parts(spark, d):
    """First key frame at or after each clip's start and the last at or before its end."""
    s = _shots(spark, d).select("o_custkey", "o_orderkey", "start", "end")
    keys = _shots(spark, d).select("o_custkey", F.explode(F.array(F.floor(F.col("start")) + 1.0, F.floor(F.col("end")) - 1.0)).alias("k")).distinct()
    a = asof.around(s, keys, ["o_custkey"], "start", "k", []).select("o_custkey", "o_orderkey", "start", "end", F.col("_next.at").alias("first"))
    b = asof.around(a, keys, ["o_custkey"], "end", "k", []).withColumn("last", F.col("_prev.at"))
    ok = F.coalesce(F.col("first") < F.col("last"), F.lit(False))
    return b.select("o_orderkey", F.when(ok, F.col("first")).alias("copy_start"), F.when(ok, F.col("last")).alias("copy_end"))


def union_covers(spark, d):
    """Share of each shot that the next shots of its customer cover, summed (counted twice where they overlap)."""
    s = _shots(spark, d)
    other = s.select("o_custkey", F.col("i").alias("j"), F.col("start").alias("os"), F.col("end").alias("oe"))
    met = asof.overlap_join(s, other, ["o_custkey"], "start", "end", "os", "oe", 20.0).where("j > i")
    return met.groupBy("o_orderkey").agg(F.round(F.sum((F.least("end", "oe") - F.greatest("start", "os")) / (F.col("end") - F.col("start"))), 6).alias("share"))


def truth_prf(spark, d):
    s = _shots(spark, d).groupBy("o_custkey").agg(F.sum((F.col("score") > 0.5).cast("long")).alias("tp"), F.sum((F.col("score") < 0.2).cast("long")).alias("fp"), F.sum(F.col("score").between(0.2, 0.5).cast("long")).alias("fn"))
    p, r, f = evaluate.prf("tp", "fp", "fn")
    return s.select("o_custkey", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

SQL = {
    "fragment_warnings": f"""WITH {_E}, k AS (SELECT grp, count(*) AS fragments FROM ses WHERE e - s < 0.15 GROUP BY grp) SELECT grp, fragments, sha256(format('{intervals.FRAGMENT_TEXT.replace("%d", "{}").replace("%.2f", "0.15")}', fragments)) AS digest FROM k""",
    "time_grid": f"WITH {_E}, g AS (SELECT sid, s, unnest(range(0, CAST(floor((e - s) / 0.5 + 1e-9) AS INTEGER) + 1)) AS k FROM ses) SELECT sid, CAST(k AS INTEGER) AS k, round(s + k * 0.5, 4) AS t FROM g",
    "frames_in_scenes": f"WITH {fx.LIB} SELECT CAST(floor(t / 20) AS BIGINT) AS scene_no, count(*) AS n, min(t) AS first FROM lib GROUP BY 1",
    "boundary_recall": f"""WITH {_E}, m AS (SELECT a.grp, a.sid, min(abs(b.s - a.s)) AS g FROM ses a LEFT JOIN ses b ON (b.grp + 1) % 10 = a.grp GROUP BY a.grp, a.sid)
SELECT grp, round(avg(CAST(g <= 0.1 AS INTEGER)), 6) AS r0_1, round(avg(CAST(g <= 0.5 AS INTEGER)), 6) AS r0_5, round(avg(CAST(g <= 2 AS INTEGER)), 6) AS r2_0 FROM m GROUP BY grp""",
    "content_keys": """SELECT p_partkey, sha256(p_name) AS content, sha1('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS key FROM part""",
    "media_budgets": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) * 200000000 END AS f FROM part), u AS (SELECT *, greatest(0, f - 1073741824) AS x, k % 5000000 + 100000 AS tg FROM p), s AS (SELECT *, greatest(0.05, (2.5 - 1e-3) / (tg / 1e6)) AS raw FROM u), v AS (SELECT *, round(CASE WHEN abs(raw - 1) <= 0.02 AND tg <= 3000000 THEN 1 ELSE raw END, 6) AS sp FROM s)
SELECT k AS p_partkey, CASE WHEN f IS NULL OR x >= 6442450944 THEN 4 WHEN x >= 2147483648 THEN 2 ELSE 1 END AS workers, CASE WHEN f IS NULL THEN 'unknown' WHEN x >= 6442450944 THEN 'ok' WHEN x >= 2147483648 THEN 'tight' ELSE 'critical' END AS tier,
round(CASE WHEN round(tg * sp) > 3000000 THEN round(greatest(0.05, 2999000 / tg), 6) ELSE sp END, 5) AS speed, CAST(floor(k / 8 * 24000 / 1001 + 0.5) AS BIGINT) AS frames FROM v""",
    "stage_percent": "SELECT event_id, round(CASE event_type WHEN 'click' THEN 0 + 30.0 * (event_id % 10) / 10 WHEN 'view' THEN 30 + 50.0 * (event_id % 10) / 10 ELSE 80 + 20.0 * (event_id % 10) / 10 END, 1)::DOUBLE AS percent FROM events WHERE event_type IN ('click', 'view', 'purchase')",
    "error_codes": "SELECT event_type, CASE event_type WHEN 'click' THEN 'E_CLICK' WHEN 'view' THEN 'E_VIEW' ELSE 'E_INTERNAL' END AS code, count(*) AS n FROM events GROUP BY event_type",
    "last_events": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY event_id DESC LIMIT 20",
    "clip_parts": f"""WITH {_SHOT}, k AS (SELECT DISTINCT o_custkey, k FROM (SELECT o_custkey, floor(s) + 1.0 AS k FROM shot UNION ALL SELECT o_custkey, floor(e) - 1.0 FROM shot)), m AS (SELECT shot.o_orderkey, min(k) FILTER (k >= s) AS a, max(k) FILTER (k <= e) AS b FROM shot JOIN k ON k.o_custkey = shot.o_custkey GROUP BY shot.o_orderkey)
SELECT o_orderkey, CASE WHEN a < b THEN a END AS copy_start, CASE WHEN a < b THEN b END AS copy_end FROM m""",
    "union_covers": f"WITH {_SHOT} SELECT a.o_orderkey, round(sum((least(a.e, b.e) - greatest(a.s, b.s)) / (a.e - a.s)), 6) AS share FROM shot a JOIN shot b ON a.o_custkey = b.o_custkey AND b.i > a.i AND least(a.e, b.e) > greatest(a.s, b.s) GROUP BY a.o_orderkey",
    "truth_prf": f"""WITH {_SHOT}, g AS (SELECT o_custkey, count(*) FILTER (score > 0.5) AS tp, count(*) FILTER (score < 0.2) AS fp, count(*) FILTER (score BETWEEN 0.2 AND 0.5) AS fn FROM shot GROUP BY 1), k AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g)
SELECT o_custkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM k""",
    "fcp_xml": f"""WITH {_SHOT}, p AS (SELECT o_custkey, o_orderkey AS k, -1 AS sub, 1 AS track, i, s AS a, e AS b FROM shot WHERE score >= 0.3 UNION ALL SELECT o_custkey, o_orderkey, 0, 3, i, s + 50, s + 51.5 FROM shot WHERE score >= 0.3),
c AS (SELECT o_custkey, track, i, k, '<clipitem id="c' || k || '-' || sub || '"><start>' || i * 25 || '</start><end>' || (i + 1) * 25 || '</end><in>' || CAST(round_even(a * 25, 0) AS BIGINT) || '</in><out>' || CAST(round_even(b * 25, 0) AS BIGINT) || '</out></clipitem>' AS x FROM p),
t AS (SELECT o_custkey, track, '<track>' || string_agg(x, '' ORDER BY i, k) || '</track>' AS x FROM c GROUP BY ALL)
SELECT o_custkey, '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE xmeml><xmeml version="4"><sequence><name>cut</name><rate><timebase>25</timebase><ntsc>FALSE</ntsc></rate><media><video>' || string_agg(x, '' ORDER BY track) || '</video></media></sequence></xmeml>' AS text FROM t GROUP BY 1""",
}
