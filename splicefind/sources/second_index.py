"""The index of a second feature: an even grid of frames, built in time clusters, stored by time so that a window reads its own files.

Layout: ``rows/source_id=.../part=...`` Parquet, sorted by time, ``part`` being SPAN seconds; ``meta`` is written last, so a half-written
index is none.  A new build goes to a new version directory; the newest complete one is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicefind.operators.asof import asof_forward, range_join
from splicefind.sources.index_store import _children, latest

SCHEMA = "second1"
CLUSTER = 120.0  # seconds
SPAN = 3600.0
META = "schema string, fps double, rows long, dim int, content_hash string"


def grid_rows(frames: DataFrame, fps: float = 1.0, duration: DataFrame | None = None, cluster: float = CLUSTER) -> DataFrame:
    """(source_id, t, feature) on the grid k / fps: the first frame at or after each target, inside the target's cluster.

    ``frames`` has source_id, t, feature (null: could not be read).  Targets end with the last frame, or earlier with ``duration``
    (source_id, duration); those that find no frame in their cluster are left out, whole clusters of them too.
    """
    have = frames.where("feature is not null and t is not null").select("source_id", F.col("t").cast("double").alias("_t"), "feature")
    last = have.groupBy("source_id").agg(F.max("_t").alias("last"))
    n = F.floor(F.col("last") * fps + 1e-9) + 1
    if duration is not None:
        last = last.join(duration, "source_id", "left")
        n = F.least(n, F.coalesce(F.floor((F.col("duration") - 0.5 / fps) * fps) + 1, n))
    targets = last.where(n > 0).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")).select("source_id", F.round(F.col("k") / fps, 6).alias("t"))
    got = asof_forward(targets, have, ["source_id"], "t", "_t", ["feature"], False, width=cluster)
    same = F.floor(F.col("match.at") / cluster) == F.floor(F.col("t") / cluster)
    return got.where(same).select("source_id", "t", F.col("match.feature").alias("feature"))


def write_second_index(rows: DataFrame, path: str, fps: float, content_hash: str) -> str:
    """Write ``rows`` (source_id, t, feature) as a new version and commit it by its metadata."""
    spark = rows.sparkSession
    used = [int(v[1:]) for v in _children(spark, path) if v[1:].isdigit()]
    out = f"{path}/v{max(used, default=0) + 1:06d}"
    dealt = rows.withColumn("part", F.floor(F.col("t") / SPAN).cast("long"))
    dealt.repartition("source_id", "part").sortWithinPartitions("source_id", "part", "t").write.partitionBy("source_id", "part").parquet(f"{out}/rows")
    done = spark.read.parquet(f"{out}/rows").agg(F.count("*").alias("n"), F.max(F.size("feature")).alias("dim")).first()
    spark.createDataFrame([(SCHEMA, float(fps), done["n"], done["dim"], content_hash)], META).write.parquet(f"{out}/meta")
    return out


def load_second_index(spark: SparkSession, path: str, dim: int, content_hash: str | None = None) -> DataFrame | None:
    """The rows of the newest complete version; None without one, without its columns, of another schema, dimension, content or number of rows."""
    v = latest(spark, path)
    if v is None:
        return None
    try:
        meta, rows = spark.read.parquet(f"{v}/meta").first(), spark.read.parquet(f"{v}/rows")
        if meta is None or meta["schema"] != SCHEMA or meta["dim"] != dim or not {"source_id", "t", "feature", "part"} <= set(rows.columns):
            return None
        if content_hash is not None and meta["content_hash"] != content_hash:
            return None
        odd = rows.agg(F.count("*").alias("n"), F.sum((F.coalesce(F.size("feature"), F.lit(-1)) != dim).cast("int")).alias("odd")).first()
    except Exception as e:  # a truncated or foreign file counts as no index; other failures are not swallowed
        if "parquet" in str(e).lower() or "schema" in str(e).lower():
            return None
        raise
    return rows if odd["n"] == meta["rows"] and odd["n"] > 0 and not odd["odd"] else None


def in_windows(index: DataFrame, windows: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Index rows of each window (source_id, lo, hi, ...): only the directories of the windows' parts are read."""
    parts = windows.select("source_id", F.explode(F.sequence(F.floor(F.col(lo) / SPAN), F.floor(F.col(hi) / SPAN))).alias("part")).distinct()
    few = [(r["source_id"], r["part"]) for r in parts.limit(1001).collect()]
    if len(few) <= 1000:  # few parts are named to the scan; with more the join prunes at run time
        by_source: dict = {}
        for s, p in few:
            by_source.setdefault(s, []).append(p)
        cond = F.lit(False)
        for s, own in by_source.items():
            cond = cond | ((F.col("source_id") == F.lit(s)) & F.col("part").isin(own))
        index = index.where(cond)
    else:
        index = index.join(parts, ["source_id", "part"], "left_semi")
    return range_join(index, windows, ["source_id"], "t", lo, hi, 64.0)
