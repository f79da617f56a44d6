"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before kept.
``run`` writes every stage's rows as Parquet in the shared folder and reads them again.
All stages but the last return the columns of ``docs``, untouched but for what a stage says; a stage's inner
columns never clash with them.  Every row is a document of its own: ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.llm.common import crc_mod, stored, table
from splicefind.session import ship_code


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.3)."""
    from splicefind.llm.quality_classifier import quality_classifier

    ship_code(spark)
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    out = quality_classifier(rows, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)
    return out.where("predicted = 1").select("document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents keep the one with the smallest id, once.

    Documents are told apart by id and text, so rows of one id with different texts are judged each, and those
    without an id, too (they come before all others).  Of rows alike in both the one that sorts first by its other columns stays.
    Documents without words link with nothing and all stay.
    """
    from splicefind.llm.jaccard_join import jaccard_join

    ship_code(spark)
    name = F.struct("doc_id", F.xxhash64("text").alias("h"))
    found = stored(jaccard_join(docs.select(name.alias("name"), "text"), "name")).where("n_shingles > 0")
    gone = found.where("component_id <> name").select(F.col("name.doc_id").alias("_id"), F.col("name.h").alias("_h")).distinct()
    same = found.groupBy("name").count().where("count > 1").select(F.col("name.doc_id").alias("_id"), F.col("name.h").alias("_h"))
    is_ = lambda other: docs["doc_id"].eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_h"])
    out = docs.join(gone, is_(gone), "left_anti")
    if not same.isEmpty():
        twice, once = docs.join(same, is_(same), "left_semi"), out.join(same, is_(same), "left_anti")
        twice = twice.join(gone, is_(gone), "left_anti")
        others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
        place = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(*others, F.lit(0)))
        first = twice.select(F.struct(*docs.columns).alias("document"), place.alias("place")).where("place = 1").select("document.*")
        out = once.unionByName(first)
    return out.select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; a text that had words and lost all of them goes.

    Texts that lose nothing keep their line breaks; others are their kept words, one space apart.
    A null text comes back empty.
    """
    from splicefind.llm.substring_dedup import substring_dedup

    ship_code(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup(docs.select("doc_id", "text", F.struct(*rest, F.lit(None).alias("text")).alias("document")), verbatim=True)
    out = out.where("n_words = 0 or n_removed < n_words").select("doc_id", "text", "n_removed", *[F.col(f"document.{c}") for c in rest if c != "n_removed"], *[F.col("document.n_removed").alias("_own") for c in rest if c == "n_removed"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    if "n_removed" in docs.columns:
        out = out.drop("n_removed").withColumnRenamed("_own", "n_removed")
    return out.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs.

    The verdict hangs on the text alone, so documents are named by a digest of it, whatever their ids.
    """
    from splicefind.llm.decontaminate import decontaminate

    ship_code(spark)
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    hit = decontaminate(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), "digest").where("n_hit > 0").select("digest").distinct()
    return docs.join(hit, digest == hit["digest"], "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of at most 2048 tokens."""
    import public_tokenizers

    from splicefind.llm.packing import best_fit_packing

    ship_code(spark)
    return best_fit_packing(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained classifier has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
