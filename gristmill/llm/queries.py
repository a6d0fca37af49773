"""The queries opN_<name> over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clusters, decontaminate, fingerprints, licenses, mixing, nearcopies, secrets, substrings, tokens, topk, toxicity, warc, whitening
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages")).drop("url")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.join(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_ids": op2_token_ids,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_topk": op4_exact_topk,
    "op5_warc": op5_warc,
    "op6_license_scan": op6_license_scan,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_topk": topk.ORACLE_SQL, "op6_license_scan": licenses.oracle_sql(), "op13_centroid_clustering": clusters.oracle_sql()}
