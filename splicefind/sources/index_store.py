"""The feature index as versioned Parquet: features, scenes, events and one row of metadata.

A version directory is written whole and never overwritten; the newest complete one (its
metadata is written last) is read.  Derived tables are functions of the features and carry
their own version, so stale ones are rebuilt from the stored features alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DERIVED = "scn4+evt1"
META = "version string, derived string, model string, dim int, fps double, duration double, size long, content_hash string, preprocess string, rows long"


def _children(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def version_of(model: str, dim: int, fps: float, derived: str = DERIVED) -> str:
    return f"{model}/d{dim}/f{fps:g}/l2+{derived}"


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest complete version directory."""
    done = [v for v in _children(spark, path) if re.fullmatch(r"v\d{6}", v) and "meta" in _children(spark, f"{path}/{v}")]
    return f"{path}/{done[-1]}" if done else None


def write_index(features: DataFrame, scenes: DataFrame, events: DataFrame, path: str, **meta) -> str:
    """Write a new version; ``features`` has source_id, t, feature."""
    spark = features.sparkSession
    used = [int(v[1:]) for v in _children(spark, path) if re.fullmatch(r"v\d{6}", v)]
    out = f"{path}/v{max(used, default=0) + 1:06d}"
    features.write.partitionBy("source_id").parquet(f"{out}/features")
    scenes.write.parquet(f"{out}/scenes/{DERIVED}")
    events.write.parquet(f"{out}/events/{DERIVED}")
    names = [f.split()[0] for f in META.split(", ")]
    row = {"derived": DERIVED, **meta, "rows": features.count()}
    row["version"] = version_of(row.get("model", ""), row.get("dim", 0), row.get("fps", 0.0))
    spark.createDataFrame([tuple(row.get(n) for n in names)], META).write.parquet(f"{out}/meta")
    return out


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """features, scenes, events, meta of the newest version; derived tables of another version are None."""
    v = latest(spark, path)
    if v is None:
        return dict.fromkeys(("features", "scenes", "events", "meta"))
    table = lambda name: spark.read.parquet(f"{v}/{name}/{DERIVED}") if DERIVED in _children(spark, f"{v}/{name}") else None
    return {"features": spark.read.parquet(f"{v}/features"), "scenes": table("scenes"), "events": table("events"), "meta": spark.read.parquet(f"{v}/meta")}


def refresh_derived(spark: SparkSession, path: str, build) -> None:
    """Rebuild scenes and events as ``build(features) -> (scenes, events)``; both are computed before either is written."""
    v = latest(spark, path)
    scenes, events = build(spark.read.parquet(f"{v}/features"))
    from splicefind.operators.components import reliable

    scenes, events = reliable(scenes), reliable(events)
    scenes.write.mode("overwrite").parquet(f"{v}/scenes/{DERIVED}")
    events.write.mode("overwrite").parquet(f"{v}/events/{DERIVED}")


def validity(expected: dict) -> Column:
    """State of a metadata row: the first check that fails, in order, or VALID."""
    checks = [("size", F.col("size") != F.lit(expected.get("size"))), ("duration", F.abs(F.col("duration") - F.lit(expected.get("duration"))) > 0.5), ("model", F.col("model") != F.lit(expected.get("model"))),
              ("dim", F.col("dim") != F.lit(expected.get("dim"))), ("fps", F.col("fps") != F.lit(expected.get("fps"))), ("content_hash", F.col("content_hash") != F.lit(expected.get("content_hash"))),
              ("preprocess", F.col("preprocess") != F.lit(expected.get("preprocess"))), ("derived", F.col("derived") != F.lit(expected.get("derived", DERIVED)))]
    out = F.when(F.col("rows").isNull(), "MISSING")
    for name, bad in checks:
        if name == "derived" or expected.get(name) is not None:
            out = out.when(F.coalesce(bad, F.lit(True)), f"INVALID:{name}")
    return out.otherwise("VALID")


def capped_rows(times: DataFrame, keys: list[str], base: Column, fps: float) -> DataFrame:
    """Grid size of each source: min(base, int(last time * fps) + 1)."""
    last = times.groupBy(*keys).agg(F.max("t").alias("last"))
    return last.withColumn("n", F.least(base, F.floor(F.col("last") * fps) + 1))
