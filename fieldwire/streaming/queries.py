"""Live detection over Structured Streaming. Times are event times with watermarks.

A live detector gives what its batch form gives for the rows in any order within the watermark's delay. Rows that
come later are results of their own with ``late`` true: a side table of the log (``late_rows``), from which the keys
that they touch can be answered anew (``settled``). ``run_to_end`` closes a finite input: a mark with a time beyond
all others moves the watermark past whatever still waits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import BENIGN, DNP3_PORT, FIN, PAYLOAD_FEATURES, RST
from ..functions import dnp3
from ..functions.net import FLOW_KEY, canonical_key, touches_port
from ..operators.clean import port_filter, rename_flow_columns, verdict_kind
from ..operators.flows import frames_of
from ..schemas import ALERT_EVENT, PACKETS
from ..sources.tables import flow_schema
from .state import BUCKET, PACKED, Cooldown, FlowSession, ScanBurst, Suppress, pack_buckets

DELAY = "30 seconds"
#: Time of the mark that ends an input: the last second of the year 9999.
END_US = 253_402_300_799_000_000
#: Groups of keys; each is called, and its state read and written, once a batch and timer.
BUCKETS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(df: DataFrame, delay: str = DELAY) -> DataFrame:
    """``df`` under a watermark. The marks that end an input move it and then go.

    Detectors drop the time column, so that Spark does not filter late rows before they see them. The condition on
    a random number always holds; being no fixed one, it keeps later filters from being moved below the watermark,
    where they would take the marks away."""
    timed = df.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    return timed.where((F.unix_micros("event_time") < END_US) & (F.rand(0) + 1 > 0))


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` and the marks that ``mark_end`` writes to ``folder``."""
    spark = stream.sparkSession
    spark.createDataFrame([], "ts_us LONG").write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema("ts_us LONG").parquet(folder), allowMissingColumns=True)


def mark_end(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([(END_US,)], "ts_us LONG").write.mode("append").parquet(folder)


def run_to_end(build, base: str) -> tuple[DataFrame, DataFrame]:
    """Runs a live query over all that its sources hold and closes it; its results and its late rows.

    ``build`` gets a function that ends a stream and returns the query. The log under ``base`` is a table of
    ordinary files: ``late`` is a folder of it."""
    end = f"{base}/end"
    out = build(lambda stream: with_end(stream, end))
    for last in (False, True):
        if last:
            mark_end(out.sparkSession, end)
        write_verdicts(out, f"{base}/log", f"{base}/state").awaitTermination()
    log = out.sparkSession.read.schema(out.schema).parquet(f"{base}/log")
    return log.where("not late").drop("late"), late_rows(log)


def late_rows(log: DataFrame) -> DataFrame:
    return log.where("late")


def settled(live: DataFrame, late: DataFrame, keys: list[str], batch) -> DataFrame:
    """Live results with those of keys that had late rows answered anew.

    ``batch`` gets a function that keeps the rows of such keys (null keys are keys) and returns the batch results
    over what it keeps."""
    gone = late.select(*keys).distinct()

    def only(rows: DataFrame) -> DataFrame:
        return rows.join(gone.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")

    others = live.join(gone.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
    return others.unionByName(batch(only).select(live.columns))


def stream_flow_csv(spark: SparkSession, folder: str, columns: list[str], **opt) -> DataFrame:
    """Flow rows of CSV files as they land; rows with another field count are dropped.

    A row's fields are counted on the raw text line, quoted commas excepted.
    """
    schema = flow_schema(columns)
    lines = spark.readStream.options(**opt).text(folder)
    bare = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    head = ",".join(columns)
    return (
        lines.where((fields == len(columns)) & (F.col("value") != head))
        .select(F.from_csv("value", _ddl(schema)).alias("r")).select("r.*")
    )


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def stream_alerts(spark: SparkSession, folder: str, **opt) -> DataFrame:
    """IDS alerts of JSON-lines files as they land; ``ts_us`` must be in the record."""
    from ..operators.joins import clean_alerts

    return clean_alerts(spark.readStream.schema(ALERT_EVENT).options(**opt).json(folder))


def stream_packets(spark: SparkSession, folder: str, **opt) -> DataFrame:
    return spark.readStream.schema(PACKETS).options(**opt).parquet(folder)


def score_flows(flows: DataFrame, model, port: int = DNP3_PORT) -> DataFrame:
    """One verdict per flow row that touches the port."""
    scored = model.predict(rename_flow_columns(port_filter(flows, port)
                           .withColumns({"__sp": F.col("src_port"), "__dp": F.col("dst_port")})))
    return scored.withColumnsRenamed({"__sp": "src_port", "__dp": "dst_port"})


def _keyed(df: DataFrame, keys: list[str], processor, schema: T.StructType) -> DataFrame:
    """Results of an ``Ordered`` processor: the columns of ``schema``, of which late rows fill some, and ``late``."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    return df.withColumn(BUCKET, bucket).mapInArrow(pack_buckets, PACKED).groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType([*schema, T.StructField("late", T.BooleanType())]), outputMode="Append",
        timeMode="EventTime",
    )


def live_command_injection(
    packets: DataFrame, cooldown_us: int = 5_000_000, port: int = DNP3_PORT, delay: str = DELAY
) -> DataFrame:
    """Streaming form of the command injection alert."""
    cols = ["src_ip", "fc", "ts_us", "pkt_no", "frame_no"]
    hits = frames_of(with_event_time(packets, delay), port).where(dnp3.is_attack(F.col("fc")))
    rows = hits.select(*cols)
    out = T.StructType([rows.schema[c] for c in cols])
    return _keyed(
        rows, ["src_ip", "fc"], Cooldown(["src_ip", "fc"], cols, ["ts_us", "pkt_no", "frame_no"], cooldown_us), out
    )


def live_scan_burst(
    packets: DataFrame, threshold: int = 40, window_us: int = 10_000_000, port: int = DNP3_PORT,
    delay: str = DELAY,
) -> DataFrame:
    """Streaming form of the scan burst alert."""
    cols = ["src_ip", "ts_us", "pkt_no", "frame_no"]
    probes = frames_of(with_event_time(packets, delay), port).where(dnp3.is_link_status(F.col("ctrl")))
    rows = probes.select(*cols)
    out = T.StructType([rows.schema[c] for c in cols])
    return _keyed(rows, ["src_ip"], ScanBurst(["src_ip"], cols, cols[1:], threshold, window_us), out)


def live_blocks(
    verdicts: DataFrame, dedupe_us: int = 60_000_000, ttl_us: int = 3_600_000_000, delay: str = DELAY
) -> DataFrame:
    """Sources to block, each at most once per dedupe interval, and when to unblock them
    (``ttl_us`` 0: never, a null time)."""
    from ..functions.net import routable

    cols = ["src_ip", "ts_us", "label"]
    rows = with_event_time(verdicts, delay).where(
        (F.col("label") != BENIGN) & routable(F.col("src_ip"))
    ).select(*cols)
    out = T.StructType([rows.schema[c] for c in cols])
    blocks = _keyed(rows, ["src_ip"], Cooldown(["src_ip"], cols, ["ts_us"], dedupe_us), out)
    unblock = F.col("ts_us") + F.lit(ttl_us) if ttl_us else F.lit(None).cast("long")
    return blocks.withColumn("unblock_us", unblock)


def session_rows(packets: DataFrame, port: int = DNP3_PORT, more: Sequence[str] = ()) -> DataFrame:
    """Packets with their frames (one row without a frame for a packet that has none) and
    a mark on the last row of a packet that ends its flow. ``more``: further columns of packets to keep."""
    frames = F.col("__frames")
    n = F.greatest(F.size(frames), F.lit(1))
    ends = F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0
    return (
        packets.where(touches_port(F.col("src_port"), F.col("dst_port"), port))
        .withColumn("__frames", dnp3.parse_frames(F.col("payload")))
        .where((F.size(frames) > 0) | ends)
        .withColumns(canonical_key()).withColumns({"__n": n, "__ends": ends})
        .select(*FLOW_KEY, "ts_us", "pkt_no", (F.col("dst_port") == port).alias("is_fwd"),
                "is_ab", "dst_port", "__n", "__ends", *more,
                F.posexplode_outer(frames).alias("__pos", "f"))
        .select(
            *FLOW_KEY, "ts_us", "pkt_no", F.coalesce("__pos", F.lit(0)).alias("frame_no"),
            "is_fwd", "is_ab", "dst_port",
            (F.col("__ends") & (F.coalesce("__pos", F.lit(0)) == F.col("__n") - 1)).alias("ends"),
            "f.fc", "f.ctrl", "f.user_data_len", *more,
        )
    )


def live_flow_features(
    packets: DataFrame, idle_us: int = 30_000_000, port: int = DNP3_PORT, delay: str = DELAY
) -> DataFrame:
    """Payload features of each flow when it has been idle or saw FIN or RST."""
    rows = session_rows(with_event_time(packets, delay), port)
    ratios = {"response_ratio", "attack_fc_ratio", "link_status_ratio", "mean_udata_len"}
    out = T.StructType(
        [rows.schema[k] for k in FLOW_KEY]
        + [T.StructField(c, T.LongType()) for c in ("start_us", "end_us")]
        + [T.StructField(c, T.DoubleType() if c in ratios else T.LongType()) for c in PAYLOAD_FEATURES]
    )
    return _keyed(rows, FLOW_KEY, FlowSession(FLOW_KEY, PAYLOAD_FEATURES, idle_us), out)


def live_suppress(
    verdicts: DataFrame, alerts: DataFrame, ttl_us: int = 60_000_000, delay: str = DELAY
) -> DataFrame:
    """Verdicts with their kind once the watermark has passed them. Late rows are told by their flow key."""
    v = with_event_time(verdicts, delay).withColumns(canonical_key())
    body = T.StructType([f for f in v.schema if f.name in verdicts.columns])
    v = v.select(*FLOW_KEY, "is_ab", "ts_us", F.lit(False).alias("is_alert"), F.lit(0).cast("long").alias("sig_id"), F.lit("").alias("sig_name"),
                 F.to_json(F.struct(*body.names)).alias("body"))
    a = with_event_time(alerts, delay).withColumns(canonical_key()).select(
        *FLOW_KEY, "is_ab", "ts_us", F.lit(True).alias("is_alert"), "sig_id", "sig_name", F.lit("").alias("body"))
    out = T.StructType([v.schema[k] for k in FLOW_KEY] + T.StructType.fromDDL("body STRING, sig_id LONG, sig_name STRING, covered BOOLEAN").fields)
    decided = _keyed(v.unionByName(a), FLOW_KEY, Suppress(FLOW_KEY, ttl_us), out)
    return (
        decided.withColumn("v", F.from_json("body", body))
        .select("v.*", *FLOW_KEY, "covered", "sig_id", "sig_name", "late")
        .withColumn("kind", verdict_kind(F.col("label"), F.col("covered")))
        .withColumns({c: F.when(F.col("kind") == "SUPPRESS", F.col(c)) for c in ("sig_id", "sig_name")})
        .drop("covered")
    )


def live_scored_flows(flows: DataFrame, model, port: int = DNP3_PORT) -> DataFrame:
    """Verdicts of flow records as they come, one a record that touches the port: no state, nothing is late."""
    scored = score_flows(flows, model, port)
    return scored.withColumnRenamed("predicted_label", "label").withColumn("late", F.lit(False))


def live_payload_verdicts(packets: DataFrame, model, idle_us: int = 30_000_000, port: int = DNP3_PORT, delay: str = DELAY) -> DataFrame:
    """Flow records of payload features as they close, classified; those that are not benign carry the kind
    ``ALERT-PAYLOAD-ML``, the others ``ok``. Late rows have neither label nor kind."""
    records = live_flow_features(packets, idle_us, port, delay)
    label = F.when(~F.col("late"), F.col("predicted_label"))
    return model.predict(records).withColumn("label", label).drop("predicted_label").withColumn(
        "kind", F.when(F.col("label") == BENIGN, "ok").when(F.col("label").isNotNull(), "ALERT-PAYLOAD-ML"))


LOG = ["ts_us", "kind", "src_ip", "label", "sig_id", "sig_name", "late"]


def live_log(packets: DataFrame, verdicts: DataFrame, alerts: DataFrame, payload_model, ttl_us: int = 60_000_000, cooldown_us: int = 5_000_000,
             threshold: int = 40, window_us: int = 10_000_000, idle_us: int = 30_000_000, port: int = DNP3_PORT, delay: str = DELAY) -> DataFrame:
    """One log of the whole chain: flow verdicts against alerts (``ok``, ``ALERT-AI``, ``SUPPRESS``), rules on frames
    (``ALERT-PAYLOAD`` with the class of the command, or DNP3_RECON) and payload records (``ALERT-PAYLOAD-ML`` of the
    lower end of the flow; benign ones are not logged)."""
    flows = live_suppress(verdicts, alerts, ttl_us, delay)
    commands = live_command_injection(packets, cooldown_us, port, delay).withColumn("label", dnp3.attack_class(F.col("fc")))
    scans = live_scan_burst(packets, threshold, window_us, port, delay).withColumn("label", F.lit("DNP3_RECON"))
    records = live_payload_verdicts(packets, payload_model, idle_us, port, delay).where("late or kind <> 'ok'")
    rules = unify(commands, scans).withColumn("kind", F.when(~F.col("late"), "ALERT-PAYLOAD"))
    records = records.withColumns({"ts_us": F.col("end_us"), "src_ip": F.col("a_ip")})
    nothing = {"sig_id": F.lit(None).cast("long"), "sig_name": F.lit(None).cast("string")}
    return unify(flows.select(LOG), rules.withColumns(nothing).select(LOG), records.withColumns(nothing).select(LOG))


def unify(*streams: DataFrame) -> DataFrame:
    """All verdict kinds as one append stream; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def write_verdicts(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to a parquet table, exactly once per row; late rows to a folder of their own."""
    w = stream.writeStream.format("parquet").outputMode("append").option(
        "path", path).option("checkpointLocation", checkpoint)
    if "late" in stream.columns:
        w = w.partitionBy("late")
    return (w.trigger(availableNow=True) if once else w).start()
