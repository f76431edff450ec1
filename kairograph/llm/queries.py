"""The registered corpus queries; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, embeddings, html_extract, language_id, licenses, merkle, quality, secret_scan, simhash, toxicity, warc
from .oracles import ORACLES  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "quality_score", "quality_keep")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in a tree by source and number; the first document of a directory is its license file."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    name = F.when(n % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), n.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(n / 1000).cast("string"), F.floor(n / 50).cast("string"), name)
    return licenses.scan_licenses(docs.withColumn("path", path)).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by crc32 comes back with its text in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), received={"text": F.when(hit, lower).otherwise(F.col("text"))})


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_held_out(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_quality_classifier, op3_benchmark_decontamination, op4_embedding_near_dedup, op5_html_extraction,
    op6_warc, op7_bpe, op8_license_scan, op9_toxicity, op10_secret_scan, op11_merkle_manifest, op12_language_id,
    op13_collocations)}
