"""Readers for flow tables, alerts, control frames and lists."""

from __future__ import annotations

import csv
import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.clean import collapse_labels, rename_flow_columns, union_datasets
from ..operators.joins import clean_alerts
from ..schemas import ALERT_EVENT, CONTROL_FRAME

log = logging.getLogger(__name__)

_TEXT = {"timestamp", "src_ip", "dst_ip", "Timestamp", "Src IP", "Dst IP", "Label", "Flow ID"}


def flow_schema(columns: list[str]) -> T.StructType:
    """Text for identifiers, DOUBLE for everything else."""
    return T.StructType([
        T.StructField(c, T.StringType() if c in _TEXT else T.DoubleType()) for c in columns
    ])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or of the first file of a folder; [] when it is empty.

    Only the names are taken, nothing is inferred from the rows.
    """
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_flow_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Flow table with typed columns; unparsable numbers become null.

    Without ``columns`` the header names them. A file without any content is an error.
    """
    names = columns or csv_header(spark, path)
    if not names:
        raise ValueError(f"{path} is empty")
    # quotes inside a field are doubled, as the writer does
    return spark.read.schema(flow_schema(names)).option("enforceSchema", columns is not None).csv(
        path, header=True, mode="PERMISSIVE", escape='"'
    )


def read_labelled_dir(
    spark: SparkSession, path: str, columns: list[str] | None = None, collapse: bool = False,
    label: str | None = None,
) -> DataFrame:
    """One CSV file per class; the label is the file's name. Model column names.

    With ``columns`` all files are one scan. Without, files may differ: their first lines are read by one job, each
    header in use is one scan of its files, and the tables are united by name; empty files are skipped.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    mark = F.lit(label) if label else stem

    def load(where: str | list[str], names: list[str]) -> DataFrame:
        raw = spark.read.schema(flow_schema(names)).csv(where, header=True, enforceSchema=True, escape='"')
        return rename_flow_columns(raw.withColumn("Label", mark).select(
            *[c for c in raw.columns if c != "Label"], "Label"))

    if columns:
        out = load(f"{path}/*.csv", columns)
    else:
        lines = spark.read.text(f"{path}/*.csv")
        # the part of a file from byte 0 on is read by one task, in order
        heads = lines.where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("value").alias("head"))
        found = heads.where("head <> ''").groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
        if not found:
            raise ValueError(f"no CSV with rows in {path}")
        skipped = len(lines.inputFiles()) - sum(len(r["files"]) for r in found)
        if skipped:
            log.warning("%d empty files skipped in %s", skipped, path)
        out = union_datasets(*[load(r["files"], next(csv.reader([r["head"]]))) for r in found])
    return collapse_labels(out) if collapse else out


def read_many(spark: SparkSession, paths: list[str], label: str = "Label") -> DataFrame:
    """Several labelled tables as one; unreadable or unlabelled ones are skipped."""
    good = []
    for p in paths:
        try:
            df = rename_flow_columns(read_flow_csv(spark, p))
            if label not in df.columns:
                raise ValueError(f"no {label!r} column")
            good.append(df.withColumn("source", F.lit(p)))
        except Exception as e:  # noqa: BLE001 - any failure means: not a dataset
            log.warning("skip %s: %s", p, e)
    if not good:
        raise ValueError("no valid dataset")
    return union_datasets(*good)


def read_matrix_lenient(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """CSV read as text, every feature to a finite number, absent or bad ones 0."""
    from ..operators.clean import impute_lenient

    raw = spark.read.csv(path, header=True)
    return impute_lenient(rename_flow_columns(raw), features)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """IDS alerts with a complete 4-tuple from JSON lines; bad lines are dropped."""
    return clean_alerts(spark.read.schema(ALERT_EVENT).json(path, mode="DROPMALFORMED"))


def parse_alert_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column, for streams and tables."""
    return clean_alerts(
        lines.select(F.from_json(column, ALERT_EVENT).alias("e")).where("e IS NOT NULL").select("e.*")
    )


def parse_control_frames(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """Typed request/response/error rows, and the lines that are none.

    Blank lines vanish. Bad JSON and JSON that is no object with a known type go to the
    second result.
    """
    kinds = ["READ", "WRITE", "READ_RESPONSE", "WRITE_RESPONSE", "ERROR"]
    rest = [c for c in lines.columns if c != column]
    full = lines.where(F.trim(column) != "").withColumn("__f", F.from_json(column, CONTROL_FRAME))
    ok = F.coalesce(F.col("__f.type").isin(kinds), F.lit(False))
    f = lambda n, t: F.col(f"__f.{n}").try_cast(t).alias(n)
    typed = full.where(ok).select(
        *rest, "__f.type", f("point_id", "int"), "__f.value", f("seq", "long"),
        f("timestamp", "double"), f("outstation_time", "double"), "__f.status", "__f.code",
    )
    return typed, full.where(~ok).select(*rest, column)


def read_json_frames(spark: SparkSession, path: str) -> DataFrame:
    """Control frames from JSON lines; blanks and bad lines are skipped."""
    return parse_control_frames(spark.read.text(path), "value")[0]


def read_hex_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload per line of hex digits; blank lines are skipped."""
    text = F.trim("value")
    return spark.read.text(path).where(text != "").select(F.unhex(text).alias("payload"))


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Ordered names; blank lines and lines starting with ``#`` are skipped."""
    rows = spark.read.text(path, wholetext=True).collect()  # a feature list is one small file
    lines = [x.strip() for r in rows for x in r["value"].splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def json_number(column: Column, path: str) -> Column:
    """A number inside a JSON text column, 0 when absent or unparsable."""
    return F.coalesce(F.get_json_object(column, path).try_cast("double"), F.lit(0.0))
