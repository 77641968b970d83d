"""Registered queries of the operators, each over its whole tables, and the pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldwire.session import checkpoint_folder

from . import (clustering, collocations, decontaminate as leaks, exact_dedup, mixing, pii, quality, sharding, simhash, suffix_array, token_counts,
               toxicity, url_rules)
from .common import table


def fresh_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """A new index in the shared folder, for a corpus that is deduplicated on its own."""
    return exact_dedup.DigestIndex(spark, f"{checkpoint_folder(spark)}/digest-index-{uuid.uuid4().hex}")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), fresh_index(spark))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_more")


#: Verdict and (host, path) of the rules that are given.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.temperature_weights(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts_before_and_after(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("at")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings")).drop("scanned")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"), [1.0] * 40, added=1.0)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_array": op6_suffix_array,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_clustering": op12_clustering,
    "op13_sharding": op13_sharding,
}
