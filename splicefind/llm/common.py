"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words(text: Column | str) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null or blank gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where the session sets none (tests), one under the warehouse is used and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/splicefind-{uuid.uuid4().hex}"


def stored(df: DataFrame, free: bool = True) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder: cuts lineage, survives executors.

    ``free`` asks Spark's cleaner to drop the shuffle files of plans that nothing refers to any more;
    it is for steps that move whole texts.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    del df
    if free:
        free_shuffles(spark)
    return spark.read.parquet(path)


class Scratch:
    """Tables of one run in the shared folder, by name; a newer table of a name replaces the older one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark)
        self.version: dict[str, int] = {}

    def put(self, name: str, df: DataFrame, free: bool = False) -> DataFrame:
        """``df`` as a stored table.  Frames that read the name's older table end here: it is deleted."""
        version = self.version.get(name, 0)
        path = f"{self.base}/{name}-{version + 1}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.version[name] = version + 1
        del df
        if version:
            delete(self.spark, f"{self.base}/{name}-{version}")
        if free:
            free_shuffles(self.spark)
        return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of this run's own from the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many leading underscores as keep them apart from ``columns``."""
    lead = "_"
    while any(lead + n in columns for n in names):
        lead += "_"
    return [lead + n for n in names]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: the figure that partition counts are derived from."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """How many partitions of about ``each`` bytes hold ``total_bytes``."""
    return max(least, -(-total_bytes // each))


def by_batches(task):
    """Marks a grouped function of (key, batches) as one that streams Arrow batches."""
    task.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return task
