"""Correlation of verdicts, alerts, attack windows and control frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.net import FLOW_KEY, canonical_key
from .clean import verdict_kind
from .ordered import MINUTE_US, asof, cell, running

DEFAULT_TTL_US = 60_000_000


def clean_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with a complete 4-tuple; signature fields default to 0 and empty."""
    return (
        alerts.where("event_type = 'alert'")
        .dropna(subset=["src_ip", "src_port", "dest_ip", "dest_port"])
        .select(
            "src_ip", F.col("src_port").cast("int").alias("src_port"),
            F.col("dest_ip").alias("dst_ip"), F.col("dest_port").cast("int").alias("dst_port"),
            F.coalesce("alert.signature_id", F.lit(0).cast("long")).alias("sig_id"),
            F.coalesce("alert.signature", F.lit("")).alias("sig_name"), "ts_us",
        )
    )


def suppress_covered(
    verdicts: DataFrame, alerts: DataFrame, ttl_us: int = DEFAULT_TTL_US,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Mark verdicts an IDS alert already covers.

    The latest alert on the verdict's own 4-tuple counts if it is at most ``ttl_us`` old
    (edge included), else the latest on the reversed one. Both sides are merged in time
    order per direction-free key and the latest alert of either direction is carried:
    linear work, no pairs.
    """
    sig = F.struct("ts_us", "sig_id", "sig_name")
    rtype = verdicts.select(F.struct("*").alias("r")).schema["r"].dataType
    a = clean_alerts(alerts).withColumns(canonical_key()).select(
        *FLOW_KEY, "is_ab", "ts_us", F.lit(0).alias("__side"), F.col("sig_id").alias("__tie"),
        F.lit(None).cast(rtype).alias("__row"), sig.alias("__sig"),
    )
    stype = a.schema["__sig"].dataType
    v = verdicts.withColumns(canonical_key()).select(
        *FLOW_KEY, "is_ab", "ts_us", F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"),
        F.struct(*verdicts.columns).alias("__row"), F.lit(None).cast(stype).alias("__sig"),
    )
    merged = running(
        a.unionByName(v), FLOW_KEY, ["ts_us", "__side", "__tie"], cell("ts_us", chunk_us),
        last={"__ab": F.when(F.col("is_ab"), F.col("__sig")),
              "__ba": F.when(~F.col("is_ab"), F.col("__sig"))},
    ).where("__side = 1")
    own = F.when(F.col("is_ab"), F.col("__ab")).otherwise(F.col("__ba"))
    other = F.when(F.col("is_ab"), F.col("__ba")).otherwise(F.col("__ab"))
    fresh = lambda s: F.when(s["ts_us"] >= F.col("ts_us") - F.lit(ttl_us), s)
    hit = F.coalesce(fresh(own), fresh(other))
    return (
        merged.withColumn("__hit", hit).select("__row.*", "__hit")
        .withColumn("kind", verdict_kind(F.col("label"), F.col("__hit").isNotNull()))
        .withColumns({
            "sig_id": F.when(F.col("kind") == "SUPPRESS", F.col("__hit.sig_id")),
            "sig_name": F.when(F.col("kind") == "SUPPRESS", F.col("__hit.sig_name")),
        }).drop("__hit")
    )


def label_by_window(
    flows: DataFrame, windows: DataFrame, ts: str = "ts_us", benign: str = "NORMAL",
    chunk_us: int = 1_000_000,
) -> DataFrame:
    """Label flows whose start lies in a logged ``[start_us, stop_us]`` run; the others are ``benign``.

    Where runs overlap, the one that started last wins (ties: smaller label). A run is cut into blocks of time whose
    lengths are powers of two, at most two a length, and of the runs that share a block the best is kept. What
    holds from a start or stop on is the best of the blocks around it, one lookup a length. So the work grows with
    runs times the logarithm of their length, however they overlap, and flows take the latest of these points.
    """
    run = windows.where("stop_us >= start_us").select("label", F.col("start_us").alias("a"), (F.col("stop_us") + 1).alias("b"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")
    # of the blocks of one length inside the run, the first where its number is odd, the last where it is even
    inside = run.select("label", "a", "b", levels).select(
        "label", "a", "level", F.expr("-shiftright(-a, level)").alias("first"), F.expr("shiftright(b, level)").alias("end")).where("first < end")
    cut = F.filter(F.array(F.when(F.expr("first & 1") == 1, F.col("first")), F.when(F.expr("end & 1") == 1, F.col("end") - 1)), lambda x: x.isNotNull())
    blocks = inside.select("label", "a", "level", F.explode(cut).alias("block"))
    best = blocks.groupBy("level", "block").agg(F.min(F.struct((-F.col("a")).alias("late"), "label")).alias("best"))
    points = run.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    around = points.select("at", levels).withColumn("block", F.expr("shiftright(at, level)")).join(best, ["level", "block"], "left")
    holds = around.groupBy("at").agg(F.coalesce(F.min("best")["label"], F.lit(benign)).alias("value"))
    out = asof(flows.drop("label"), holds, [], ts, "at", F.col("value"), "label", chunk_us)
    return out.withColumn("label", F.coalesce("label", F.lit(benign)))


def requests(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("type").isin("READ", "WRITE"))


def responses(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("type").isin("READ_RESPONSE", "WRITE_RESPONSE", "ERROR"))


def match_request_response(
    frames: DataFrame, timeout_us: int, chunk_us: int = MINUTE_US
) -> DataFrame:
    """Every request with its first response of the same (session, seq) in time, or nulls."""
    reply = F.struct(
        F.col("at_us").alias("ts"), F.col("type").alias("type"),
        F.col("point_id").alias("point_id"), F.col("value").alias("value"),
    )
    pairs = asof(
        requests(frames), responses(frames), ["session", "seq"], "at_us", "at_us", reply,
        "__reply", chunk_us, forward=True,
    )
    ok = F.col("__reply.ts") - F.col("at_us") <= F.lit(timeout_us)
    return pairs.withColumn("__reply", F.when(ok, F.col("__reply"))).select(
        *frames.columns,
        F.col("__reply.ts").alias("resp_us"), F.col("__reply.type").alias("resp_type"),
        F.col("__reply.point_id").alias("resp_point"), F.col("__reply.value").alias("resp_value"),
        (F.col("__reply.ts") - F.col("at_us")).alias("latency_us"),
    )


def echo_mismatch(matched: DataFrame) -> DataFrame:
    """Requests whose response names another point, or writes echoed with another value."""
    moved = ~F.col("point_id").eqNullSafe(F.col("resp_point"))
    changed = (F.col("type") == "WRITE") & ~F.col("value").eqNullSafe(F.col("resp_value"))
    return matched.where(
        F.col("resp_type").isin("READ_RESPONSE", "WRITE_RESPONSE") & (moved | changed)
    )


def unanswered_requests(matched: DataFrame) -> DataFrame:
    """Requests without any response inside the bound."""
    return matched.where("resp_us IS NULL").select(
        *[c for c in matched.columns if not c.startswith("resp_") and c != "latency_us"]
    )


def unauthorised_writers(frames: DataFrame, allowlist: DataFrame, source: str = "session") -> DataFrame:
    """WRITE frames of sources the allowlist lacks."""
    return frames.where("type = 'WRITE'").join(allowlist.select(source).distinct(), source, "left_anti")


def restarted_sequences(
    frames: DataFrame, restart_at: tuple[int, ...] = (1, 1000), chunk_us: int = MINUTE_US
) -> DataFrame:
    """Requests whose seq is back at a start value although the session had counted on."""
    prev = running(
        requests(frames), ["session"], ["at_us", "seq"], cell("at_us", chunk_us),
        last={"prev_seq": F.col("seq")},
    )
    return prev.where(F.col("seq").isin(list(restart_at)) & (F.col("prev_seq") >= F.col("seq")))


def outside_limits(writes: DataFrame, limits: DataFrame, address="address", value="value") -> DataFrame:
    """Writes beyond the band of their register; registers without a band pass."""
    band = limits.select(F.col("address").alias("__addr"), "lo", "hi")
    return writes.join(band, F.col(address) == F.col("__addr")).where(
        (F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))
    ).drop("__addr")
