"""From raw documents to a training mix: STAGES in order, each written as Parquet and read again.

1 quality: rows that the classifier, fitted on ``labels``, scores below a half go.
2 exact: of equal texts the row with the largest doc_id stays.
3 near: of each class of SimHash near-copies the row with the least doc_id stays.
4 decontaminate: rows in which an item of ``benchmark`` is found go.
5 mix: rows are repeated so that sources meet their target weights (square root of their rows), in
  random order; it adds ``copy_no`` and ``mix_key``.

Null texts count as empty; an empty table passes through all stages as an empty table. Other columns
are carried along as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwire.llm import decontaminate as leaks, exact_dedup, mixing, quality, simhash
from fieldwire.llm.common import table, written
from fieldwire.llm.queries import fresh_index


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs, fresh_index(spark))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.temperature_weights(docs))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: The classifier's weights come from training, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
