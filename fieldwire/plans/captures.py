"""From capture files to datasets and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import PAYLOAD_FEATURES
from ..functions.net import FLOW_KEY
from ..operators.clean import rename_flow_columns
from ..operators.flows import flow_features, frames_of, payload_features, verdict_summary
from ..operators.models import FlowModel
from ..sources.pcap import read_pcap


def payload_dataset(
    spark: SparkSession, path: str, label: str | None = None, port: int = 0, **opt
) -> DataFrame:
    """Payload features per flow and file with ``Label`` last: the given one, or the name
    of the capture file. ``port`` 0 takes any port."""
    frames = frames_of(read_pcap(spark, path, **opt), port)
    found = payload_features(frames, ["file", *FLOW_KEY])
    stem = F.regexp_extract("file", r"([^/]+)\.pcap$", 1)
    return found.select(*PAYLOAD_FEATURES, (F.lit(label) if label else stem).alias("Label"))


def score_captures(
    spark: SparkSession, path: str, model: FlowModel, **flow_options
) -> tuple[DataFrame, DataFrame]:
    """Flow statistics of captures with the predicted label, and the class summary."""
    flows = rename_flow_columns(flow_features(read_pcap(spark, path), **flow_options))
    scored = model.predict(flows)
    return scored, verdict_summary(scored, "predicted_label")
