"""Result batches as JSON documents, and configuration with typed overrides."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:double,end:double>"
RESULT = (
    f"id string, edited {SPAN}, original {SPAN}, level string, score double, reasons array<string>, source string, excluded boolean, "
    f"alternatives array<struct<start:double,end:double,score:double,level:string>>, original_segments array<{SPAN}>, auto_start double, auto_end double"
)
BATCH = f"schema_version int, original_video string, edited_video string, results array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in RESULT.split(', '))}>>"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of each batch document; unknown keys are ignored, missing ones null."""
    rows = spark.read.schema(BATCH).option("multiLine", True).json(path)
    return rows.select("schema_version", "original_video", "edited_video", F.explode_outer("results").alias("r")).select("schema_version", "original_video", "edited_video", "r.*")


def write_batches(results: DataFrame, path: str, version: int = 1) -> None:
    """One JSON document a line and edited video: an envelope with its results in edited order."""
    names = [f.split()[0] for f in RESULT.split(", ") if f.split()[0] in results.columns]
    key = F.struct(F.col("edited.start").alias("_s"), F.col("id").alias("_i"), F.struct(*names).alias("r"))
    rows = results.groupBy("original_video", "edited_video").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["r"]).alias("results"))
    rows.select(F.lit(version).alias("schema_version"), "original_video", "edited_video", "results").write.json(path)


def merged_config(default, overrides: dict | str):
    """A copy of dataclass ``default`` with the overrides cast to the types of its values; unknown keys are warned about and dropped."""
    given = json.loads(overrides) if isinstance(overrides, str) else overrides
    known = {f.name for f in fields(default)}
    out = {}
    for k, v in given.items():
        if k not in known:
            logging.getLogger(__name__).warning("unknown setting %s is ignored", k)
            continue
        old = getattr(default, k)
        out[k] = merged_config(old, v) if is_dataclass(old) and isinstance(v, dict) else v if old is None else bool(v) if isinstance(old, bool) else type(old)(v)
    return replace(default, **out)


def as_rows(spark: SparkSession, config) -> DataFrame:
    """A configuration as (name, value) rows."""
    flat = lambda d, p="": [x for k, v in d.items() for x in (flat(v, f"{p}{k}.") if isinstance(v, dict) else [(p + k, str(v))])]
    return spark.createDataFrame(flat(asdict(config)), "name string, value string")
