"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, lattice_lm, license_scan, line_dedup, ngram_join, packing, quality_rules, topk_search, toxicity
from .common import doc_remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(doc_remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    keep = {"doc_id": F.col("doc_id"), "held_out": doc_remainder(F.col("doc_id"), 5) == 0}
    return toxicity.toxicity(docs, learn, keep=keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__removed_words").alias("removed_words"), F.sha2("text", 256).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(*license_scan.license_scan(table(spark, sf_dir, "documents")))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.tokens(table(spark, sf_dir, "documents")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = doc_remainder(F.col("doc_id"), 5) == 1
    return lattice_lm.lm_score(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("piece_bpe_32k.model"), keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.select("doc_id", "text", "lang").where(doc_remainder(F.col("doc_id"), 4) != 2)
    keep = {"doc_id": F.col("doc_id"), "held_out": doc_remainder(F.col("doc_id"), 4) == 2}
    return language_id.language_id(docs, learn, keep=keep)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep={"doc_id": F.col("doc_id")})
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


ORACLE: dict[str, str] = {"op2_line_dedup": line_dedup.oracle(), "op3_ngram_join": ngram_join.oracle(), "op4_license_scan": license_scan.oracle(), "op5_topk_search": topk_search.oracle(), "op10_quality_rules": quality_rules.oracle()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_license_scan": op4_license_scan,
        "op5_topk_search": op5_topk_search,
        "op6_packing": op6_packing,
        "op7_lm_score": op7_lm_score,
        "op8_language_id": op8_language_id,
        "op9_bpe": op9_bpe,
        "op10_quality_rules": op10_quality_rules,
    }
