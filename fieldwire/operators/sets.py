"""Seeded order, splits and dataset mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .clean import union_datasets
from .ordered import cell, cut_at_rank, row_numbers


def shuffle_key(row_id: str, seed: int = 42) -> Column:
    """Seeded pseudo-random text key of a row; the row id makes ties impossible."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def seeded_shuffle(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Rows in seeded order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(row_id, seed), row_id)


def key_cell(key: str) -> Column:
    """Cell of a text key: its first four hex digits, so 65,536 cells of like size."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("long")


def seeded_positions(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Add ``position``, 1..n in seeded order, without a task that sees all rows."""
    keyed = df.withColumn("__key", shuffle_key(row_id, seed))
    return row_numbers(keyed, ["__key", row_id], key_cell("__key"), "position").drop("__key")


def split_exact(df: DataFrame, row_id: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_train``: the first ``int(n * (1 - test_frac))`` rows in seeded order.

    The key's first four hex digits are the cell, so 65,536 counts decide all rows but
    those of one cell.
    """
    keyed = df.withColumn("__key", shuffle_key(row_id, seed))
    keep = F.floor(F.col("__total") * (1 - F.lit(test_frac)))
    return cut_at_rank(keyed, ["__key", row_id], key_cell("__key"), keep, "is_train").drop("__key")


def split_hash(df: DataFrame, row_id: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_train`` by a hash threshold: no shuffle, share exact only on average."""
    head = F.conv(F.substring(shuffle_key(row_id, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_train", head < F.lit(int((1 - test_frac) * 2**32)))


def validation_split(df: DataFrame, row_id: str, frac: float = 0.15, cells: int = 4096) -> DataFrame:
    """Add ``is_train``: all but the last ``frac`` of rows in ``row_id`` order.

    The range of ids is cut into ``cells`` cells, so few counts decide all rows but those of
    one cell, however large the ids are.
    """
    ends = df.agg(F.min(row_id).alias("low"), F.max(row_id).alias("high")).first()
    width = 1 if ends["low"] is None else max(1, (ends["high"] - ends["low"]) // cells)
    keep = F.floor(F.col("__total") * (1 - F.lit(frac)))
    return cut_at_rank(df, [row_id], cell(row_id, width), keep, "is_train")


def mix_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Several datasets as one, each row tagged with its source."""
    return union_datasets(*[d.withColumn("source", F.lit(n)) for n, d in sources.items()])


def labels_missing(left: DataFrame, right: DataFrame, label: str = "Label") -> DataFrame:
    """Labels of ``left`` that ``right`` lacks."""
    return left.select(label).subtract(right.select(label))


def labels_shared(left: DataFrame, right: DataFrame, label: str = "Label") -> DataFrame:
    return left.select(label).intersect(right.select(label))
