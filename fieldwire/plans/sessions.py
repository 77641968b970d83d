"""Batch form of the live payload flow records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.net import FLOW_KEY
from ..operators.flows import payload_features
from ..operators.ordered import MINUTE_US, cell, running, with_cells
from ..streaming.queries import session_rows

_ORDER = ["ts_us", "pkt_no", "frame_no"]


def payload_sessions(
    packets: DataFrame, idle_us: int = 30_000_000, port: int = 20000, chunk_us: int = MINUTE_US,
    parts: int | None = None, mark: str | None = None,
) -> DataFrame:
    """Payload features per flow record; with ``mark`` also whether one of its frames' packets has that flag.

    A record ends when no frame came for longer than ``idle_us`` or on FIN or RST. Packets
    without frames only end a record, they do not keep it alive. Records still open at the
    end of the data are kept.
    """
    rows = session_rows(packets, port, [mark] if mark else [])
    at = F.struct(*_ORDER)
    has = F.col("ctrl").isNotNull()
    celled = with_cells(rows, FLOW_KEY, cell("ts_us", chunk_us), parts)
    prev = running(celled, FLOW_KEY, _ORDER, last={
        "__seen": F.when(has, at), "__end": F.when(F.col("ends"), at),
    }).where(has)
    new = (
        F.col("__seen").isNull() | (F.col("ts_us") - F.col("__seen.ts_us") > F.lit(idle_us))
        | F.coalesce(F.col("__end") >= F.col("__seen"), F.lit(False))
    )
    numbered = running(
        prev.withColumn("__new", new).drop("__seen", "__end"), FLOW_KEY, _ORDER,
        sums={"record": F.col("__new").cast("long")},
    )
    keys = FLOW_KEY + ["record"]
    span = numbered.groupBy(*keys).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        *([F.coalesce(F.bool_or(mark), F.lit(False)).alias(mark)] if mark else []),
    )
    features = payload_features(numbered, keys, "port", port, tuple(_ORDER))
    return features.join(span, keys)
