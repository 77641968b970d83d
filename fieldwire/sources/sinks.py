"""Writers for labelled flows, verdicts and result tables."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..constants import PAYLOAD_FEATURES
from .pcap import PCAP_MAGIC, open_path


def write_labelled_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; fields with commas or quotes are quoted."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_payload_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Payload features with the label last."""
    write_labelled_csv(df.select(*PAYLOAD_FEATURES, "Label"), path, mode)


def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One scan writes ``split=train`` and ``split=test``; needs ``is_train``."""
    from pyspark.sql import functions as F

    df.withColumn("split", F.when(F.col("is_train"), "train").otherwise("test")).drop(
        "is_train"
    ).write.mode(mode).partitionBy("split").parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table: small, so one CSV file."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_pcap(packets: DataFrame, path: str, link_type: int, name: str = "part") -> None:
    """Records (``ts_us``, ``data``) as captures ``<name>-<task>.pcap`` in a folder, one a task, rows in the task's order.

    A task writes beside its file and moves it when whole, so that a repeated task leaves one file."""
    def write(batches):
        filesystem, folder = open_path(path)
        filesystem.create_dir(folder, recursive=True)
        part = f"{folder}/{name}-{TaskContext.get().partitionId():05d}.pcap"
        beside, n = f"{folder}/_{uuid.uuid4().hex}", 0
        with filesystem.open_output_stream(beside) as f:
            f.write(struct.pack("<IHHIIII", PCAP_MAGIC, 2, 4, 0, 0, 262_144, link_type))
            for b in batches:
                for ts_us, data in zip(b.column("ts_us").to_pylist(), b.column("data").to_pylist()):
                    f.write(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(data), len(data)) + data)
                n += b.num_rows
        filesystem.move(beside, part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    packets.select("ts_us", "data").mapInArrow(write, "n LONG").write.format("noop").mode("overwrite").save()
