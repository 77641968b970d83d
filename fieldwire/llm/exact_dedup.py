"""Exact dedup over a persistent digest index.

The index is a table of one row per digest, bucketed and sorted by the digest. New rows are
hashed, reduced to their digests, cleared of those known by a sort-merge anti-join that does not
move the index, and appended."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_counted, texts, without, written


class DigestIndex:
    """Digests seen so far at ``path``, a folder all executors share.

    Columns: ``digest`` (32 bytes), ``keep_id`` (id of the row that stays), ``n`` (rows of its first
    batch with this text). ``buckets`` counts for a new index; an existing one keeps its own. Within one batch the row with the largest id stays; against
    earlier batches the earlier row does. Files of an append
    become visible one by one when its job commits. A batch ingested again finds the rows that are there and adds the
    others, so a failed job may simply be run anew."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
        except AnalysisException:  # no index here yet
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
            self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds the digests of ``batch`` (``doc_id``, ``digest``); returns how each text of it fares:
        ``digest``, ``keep_id``, ``n`` (rows of the batch), ``known`` (an earlier batch had it)."""
        seen = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        seen = written(seen, "digests")
        fresh = seen.join(self.rows().hint("merge"), "digest", "left_anti")
        # one file a bucket: each task writes the buckets it holds whole
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id", "n").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        mine = seen.select("digest", F.col("n"), F.col("keep_id").alias("__own"))
        kept = self.rows().select("digest", "keep_id").hint("merge")
        return mine.join(kept, "digest").select(
            "digest", "keep_id", "n", (~F.col("keep_id").eqNullSafe(F.col("__own"))).alias("known"))

    def close(self) -> None:
        """Forgets the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_duplicates(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they have the same bytes; a null text is the empty one. The row with the
    largest ``doc_id`` stays; a null id stays only where all ids of a text are null. Rows repeated
    with one id are all marked as kept (``drop_duplicates`` leaves one). An empty table gives no rows."""
    batch = written(texts(docs).select("doc_id", digest(F.col("text")).alias("digest")), "digested")
    fate = written(index.ingest(batch), "fates")
    return join_counted(batch, fate.drop("known"), "digest", "n").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` with one row per text and all its columns; texts of earlier batches go.

    Rows are named by digest and id together, so copies of one text are many keys. Rows repeated with
    one id are the rare case of which one row is picked by a shuffle of those rows alone."""
    key = ["__digest", "__id", "__void"]
    keyed = docs.select("*", digest(F.coalesce(F.col("text"), F.lit(""))).alias("__digest"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__void"))
    batch = written(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__digest").alias("digest")), "digested")
    fate = written(index.ingest(batch), "fates")
    rows = join_counted(batch, fate, "digest", "n").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known"))
    rows = written(rows.groupBy(F.col("digest").alias("__digest"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__void"))
                   .agg(F.first("stays").alias("stays"), F.count("*").alias("times")).filter("not stays or times > 1"), "rows-to-drop")
    one = without(keyed, rows.select(key), key)
    twice = rows.filter("stays").select(key)
    if not twice.isEmpty():
        one = one.unionByName(keyed.join(twice, key, "left_semi").dropDuplicates(key))
    return one.select(docs.columns)
