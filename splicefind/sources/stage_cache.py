"""Stage tables of a run, kept under the fingerprint of everything that they depend on.

A stage is a folder ``root/fingerprint/stage`` with parts; a part is data and, written after it, a mark: one row per file with its length, and
the part's row count.  A part counts only if its mark is complete (the marker that Spark's commit writes last) and names
exactly the files that are there, at their lengths, with as many rows.  Whatever else lies there (a run that was killed, a file cut short or
gone) is a miss for that part, never an error.  Parts are never overwritten; writers of one stage take folders of their own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicefind.sources.index_store import _children

SCHEMA = "stages-1"
MARK = "file string, length long, rows long, digest long, columns string, schema string"


def fingerprint(spark: SparkSession, inputs: list[str], **settings) -> str:
    """Hex sha1 of the inputs' paths, file sizes and times of change, and of all settings (in any order)."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", "modificationTime")
    # one hash a file, summed without order: the listing does not pass the driver
    one = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lower("path"), "length", F.unix_micros("modificationTime"))), 1, 15), 16, 10).cast("decimal(20,0)")
    n, total = files.agg(F.count("*"), F.sum(one)).first()
    parts = {"schema": SCHEMA, "files": [n, str(total)], "inputs": sorted(p.lower() for p in inputs), "settings": settings}
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def span_key(start: str, end: str) -> Column:
    """The name of a span in the dense stages: both ends with two digits."""
    two = lambda c: F.format_string("%.2f", F.round(F.col(c).cast("double"), 2))
    return F.concat(two(start), F.lit("_"), two(end))


def _digest(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free sum over all values of all rows."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("_d")).select("rows", F.coalesce(F.pmod(F.col("_d"), F.lit(2**61).cast("decimal(20,0)")).cast("long"), F.lit(0).cast("long")).alias("digest"))


class StageCache:
    """Tables of one root; ``deep`` also reads every value back against the digest of the mark."""

    def __init__(self, spark: SparkSession, root: str, deep: bool = False):
        self.spark, self.root, self.deep = spark, root.rstrip("/"), deep

    def _files(self, path: str) -> DataFrame:
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")

    def _part(self, path: str) -> DataFrame | None:
        """The part's rows, or None unless all of it is there."""
        if "_SUCCESS" not in _children(self.spark, f"{path}/mark") or "_SUCCESS" not in _children(self.spark, f"{path}/data"):
            return None
        try:
            mark = self.spark.read.schema(MARK).parquet(f"{path}/mark")
            have = self._files(f"{path}/data").withColumnRenamed("length", "_have")
            bad = mark.join(have, "file", "full").agg(F.count_if(~F.col("length").eqNullSafe(F.col("_have"))).alias("bad"), F.max("rows"), F.max("digest"), F.max("columns"), F.min("schema"), F.max("schema")).first()
            if bad["bad"] or (bad[4], bad[5]) != (SCHEMA, SCHEMA):
                return None
            data = self.spark.read.parquet(f"{path}/data")
            if data.schema.simpleString() != bad[3]:
                return None
            rows, digest = _digest(data).first() if self.deep else (data.count(), bad[2])
            return data if (rows, digest) == (bad[1], bad[2]) else None
        except (PySparkException, Py4JJavaError):
            return None  # unreadable: a miss

    def load(self, key: str, stage: str) -> DataFrame | None:
        """All rows of the stage's whole parts; None when there is none."""
        path = f"{self.root}/{key}/{stage}"
        parts = [p for p in (self._part(f"{path}/{c}") for c in _children(self.spark, path)) if p is not None]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def save(self, key: str, stage: str, df: DataFrame) -> DataFrame:
        """Write one more part of the stage and return its rows, read back."""
        path = f"{self.root}/{key}/{stage}/{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/data")
        data = self.spark.read.parquet(f"{path}/data")
        rows, digest = _digest(data).first()  # one row
        # the schema as read: a written table's columns are all nullable
        seal = {"rows": F.lit(rows).cast("long"), "digest": F.lit(digest).cast("long"), "columns": F.lit(data.schema.simpleString()), "schema": F.lit(SCHEMA)}
        self._files(f"{path}/data").select("file", "length", *[v.alias(k) for k, v in seal.items()]).write.parquet(f"{path}/mark")
        return data

    def stage(self, key: str, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows from the cache, or built, saved and read back."""
        have = self.load(key, stage)
        return self.save(key, stage, build()) if have is None else have

    def fill(self, key: str, stage: str, spans: DataFrame, build: Callable[[DataFrame], DataFrame], start: str = "start", end: str = "end") -> DataFrame:
        """Rows of every span (start, end): only spans that the stage lacks are built, as one more part.

        ``build(spans)`` gives rows with span_key, the name that ``spans`` carries.  Spans are told apart to two digits; null ends are no span.  A span
        for which nothing was built is asked for again.
        """
        wanted = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("span_key", span_key(start, end)).dropDuplicates(["span_key"])
        have = self.load(key, stage)
        lacking = wanted if have is None else wanted.join(have.select("span_key").distinct(), "span_key", "left_anti")
        if not lacking.isEmpty():
            new = self.save(key, stage, build(lacking))
            have = new if have is None else have.unionByName(new, allowMissingColumns=True)
        elif have is None:
            have = build(lacking)
        return have.join(wanted.select("span_key"), "span_key", "left_semi")
