"""Sharding by weighted rendezvous hashing; DataFrame functions only.

A record's key and each shard's number give a hash; scaled by the shard's weight the best one wins. A new
shard only competes with the winner of each key, so it takes rows into itself and no other row moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .mixing import uniform

#: Rows that a group of equal rows expands to in one task.
BLOCK = 65_536
#: Shards are part of the plan.
MOST_SHARDS = 4096


def height(key: Column, shard: int, weight: float, seed: str) -> Column:
    """How late a shard comes for a key: exponential with rate ``weight``, drawn by hash; the least wins."""
    return -F.log(uniform(F.lit(seed), F.lit(str(shard)), key) + F.lit(2.0 ** -53)) / F.lit(float(weight))


def winner(key: Column, weights: Sequence[float], seed: str) -> Column:
    """``height`` and ``shard`` of the shard that gets the key; equal heights go to the smaller number."""
    if not 1 <= len(weights) <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards, not {len(weights)}")
    bids = [F.struct(height(key, j, w, seed).alias("height"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w and w > 0]
    if not bids:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*bids))


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", seed: str = "shard") -> DataFrame:
    """``docs`` and their ``shard`` (in place of a column of this name), counted from 0, without a shuffle.

    Rows of one key share a shard, a null key is the empty text, a shard of weight 0 or null gets no row."""
    return docs.withColumn("shard", winner(key_text(docs[key]), weights, seed)["shard"])


def manifest(docs: DataFrame, weights: Sequence[float], added: float | None = None, seed: str = "shard") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes of the text and 16), ``text_crc32``, ``law``
    (``key``), ``shard``, ``slot`` (place in the shard, from 0 without gaps) and ``grown_shard`` (the shard if one
    more of weight ``added`` joins; null without it).

    A null text has no bytes, a null id is the empty key. Rows equal in all of this are interchangeable: they are
    counted before they move, so an id that holds a third of all rows is one row of the shuffles, and they take
    neighbouring slots. Slots follow a hash cell of the id, then id, size and checksum. An empty table gives no rows;
    other columns are not looked at."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    key = key_text(F.col("doc_id"))
    # 4096 cells a shard: rows are ranked inside a cell, and only counts of cells are added up by shard
    cell = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("cell"), key)), 1, 3), 16, 10).cast("int")
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    groups = groups.select("*", winner(key, weights, seed).alias("won"), cell.alias("cell"))
    grown = F.lit(None).cast("int") if added is None else F.when(
        height(key, len(weights), added, seed) < F.col("won.height"), F.lit(len(weights))).otherwise(F.col("won.shard"))
    groups = written(groups.select("doc_id", "size", "text_crc32", "n", F.col("won.shard").alias("shard"), grown.alias("grown_shard"), "cell"), "shard-groups")
    cells = groups.groupBy("shard", "cell").agg(F.sum("n").alias("of_cell"))
    before = F.sum("of_cell").over(Window.partitionBy("shard").orderBy("cell")) - F.col("of_cell")
    inside = F.sum("n").over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")) - F.col("n")
    placed = groups.join(cells.select("shard", "cell", before.alias("before")), ["shard", "cell"])
    placed = written(placed.withColumn("first", F.col("before") + inside), "shard-places")

    def rows_of(part: DataFrame) -> DataFrame:
        return part.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard")

    # groups of very many equal rows are cut into blocks that are dealt to all tasks
    blocks = placed.filter(F.col("n") > BLOCK)
    blocks = blocks.withColumn("end", F.col("first") + F.col("n")).withColumn("first", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.withColumn("n", F.least(F.lit(BLOCK).cast("long"), F.col("end") - F.col("first"))).repartition("first", "shard")
    return rows_of(placed.filter(F.col("n") <= BLOCK)).unionByName(rows_of(blocks))


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id", seed: str = "shard") -> None:
    """``docs`` as Parquet under ``path``, one folder a shard, replaced as a whole. Large shards are cut into several
    files by adaptive execution, also where they hold one key."""
    with_shard(docs, weights, key, seed).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
