"""Registered queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scoring

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring(docs, crc_mod("doc_id", 5) == 1)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_output

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit_packing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_classifier

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs, crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import folded, leaf_hash, merkle_manifest, siblings_hash

    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf_hash(*(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields)))
    out = merkle_manifest(docs, fields, carry={"tampered": tampered}).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_hash("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .word_bpe import bpe_decode, bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_decode(bpe_encode(docs, path, public_tokenizers.PATTERN, packed=True), path)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def registered() -> dict:
    """name -> query; the names start with op<N>_."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracles() -> dict[str, str]:
    from . import decontaminate, divergence, jaccard_join, merkle, quality_rules, substring_dedup, url_filter

    return {
        "op2_jaccard_join": jaccard_join.ORACLE_SQL,
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op5_substring_dedup": substring_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.oracle_sql(),
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
    }
