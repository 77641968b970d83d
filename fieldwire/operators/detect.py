"""Rate detectors, signature rules and block intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    BENIGN, DNP3_PORT, SIG_CLASS0_READ, SIG_NONSTANDARD_PORT, SIG_RAPID_CONNECTIONS,
    SIG_REQUEST_FLOOD, SIGNATURES, SYN,
)
from ..functions import dnp3
from ..functions.net import routable
from .ordered import MINUTE_US, asof, cell, cooldown, running, sliding_count, windows_opened, with_cells

SECOND_US = 1_000_000


def command_injection_alerts(
    frames: DataFrame, cooldown_us: int = 5 * SECOND_US, chunk_us: int = MINUTE_US,
) -> DataFrame:
    """First attack frame per (source, function code), then silence for the cooldown."""
    hits = frames.where(dnp3.is_attack(F.col("fc"))).select(
        "src_ip", "fc", "ts_us", "pkt_no", "frame_no"
    )
    fired = cooldown(
        hits, ["src_ip", "fc"], "ts_us", ["pkt_no", "frame_no"], cooldown_us, chunk_us
    )
    return fired.withColumn("attack_class", dnp3.attack_class(F.col("fc")))


def scan_burst_alerts(
    frames: DataFrame, threshold: int = 40, window_us: int = 10 * SECOND_US,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Link-status probes of a source reaching ``threshold`` within the window, then
    silence for one window."""
    probes = frames.where(dnp3.is_link_status(F.col("ctrl"))).select(
        "src_ip", "ts_us", "pkt_no", "frame_no"
    )
    dense = sliding_count(
        probes, ["src_ip"], "ts_us", ["pkt_no", "frame_no"], window_us, "probes", chunk_us
    ).where(F.col("probes") >= threshold)
    return cooldown(
        dense, ["src_ip"], "ts_us", ["pkt_no", "frame_no"], window_us, chunk_us
    )


def block_intervals(
    verdicts: DataFrame, dedupe_us: int = 60 * SECOND_US, ttl_us: int = 3600 * SECOND_US,
    order: tuple[str, ...] = ("event_id",), chunk_us: int = MINUTE_US,
    merge: bool = True,
) -> DataFrame:
    """When a source is blocked: from an attack verdict until ``ttl_us`` later (0: for good).

    Repeats within ``dedupe_us`` are ignored. Blocks of a source that overlap are merged
    into one interval.
    """
    hits = verdicts.where((F.col("label") != BENIGN) & routable(F.col("src_ip"))).select(
        F.col("src_ip").alias("ip"), "ts_us", *order, "label"
    )
    fired = cooldown(hits, ["ip"], "ts_us", list(order), dedupe_us, chunk_us)
    if not ttl_us:
        return fired.groupBy("ip").agg(
            F.min("ts_us").alias("block_us"), F.lit(None).cast("long").alias("unblock_us"),
            F.count(F.lit(1)).alias("blocks"), F.min_by("label", "ts_us").alias("reason"),
        )
    if not merge:
        return fired.select(
            "ip", F.col("ts_us").alias("block_us"), (F.col("ts_us") + ttl_us).alias("unblock_us"),
            F.lit(1).cast("long").alias("blocks"), F.col("label").alias("reason"),
        )
    celled = with_cells(fired, ["ip"], cell("ts_us", chunk_us))
    prev = running(celled, ["ip"], ["ts_us"], last={"__prev": F.col("ts_us")})
    fresh = F.col("__prev").isNull() | (F.col("ts_us") - F.col("__prev") > F.lit(ttl_us))
    numbered = running(prev, ["ip"], ["ts_us"], sums={"__n": fresh.cast("long")})
    return numbered.groupBy("ip", "__n").agg(
        F.min("ts_us").alias("block_us"), (F.max("ts_us") + ttl_us).alias("unblock_us"),
        F.count(F.lit(1)).alias("blocks"), F.min_by("label", "ts_us").alias("reason"),
    ).drop("__n")


def signature_alerts(frames: DataFrame, port: int = DNP3_PORT) -> DataFrame:
    """Function-code signatures on traffic to the server port; the action is drop."""
    sids = F.create_map(*[F.lit(v) for fc, (sid, _) in SIGNATURES.items() for v in (fc, sid)])
    msgs = F.create_map(*[F.lit(v) for fc, (_, msg) in SIGNATURES.items() for v in (fc, msg)])
    return frames.where(
        (F.col("dst_port") == port) & F.col("fc").isin(list(SIGNATURES))
    ).withColumns({
        "sid": sids[F.col("fc")].cast("long"), "msg": msgs[F.col("fc")], "action": F.lit("drop"),
    })


def rapid_connections(
    packets: DataFrame, count: int = 8, window_us: int = 10 * SECOND_US, port: int = DNP3_PORT,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """SYN packets of a source: one alert per window, at the ``count``-th."""
    syn = packets.where((F.col("dst_port") == port) & (F.col("tcp_flags") == SYN)).select(
        "src_ip", "ts_us", "pkt_no"
    )
    placed = windows_opened(syn, ["src_ip"], "ts_us", ["pkt_no"], window_us, chunk_us)
    return placed.where(F.col("window_pos") == count).withColumn(
        "sid", F.lit(SIG_RAPID_CONNECTIONS).cast("long")
    )


def read_policy_alerts(
    frames: DataFrame, port: int = DNP3_PORT, strict: bool = False
) -> DataFrame:
    """READ frames to the server. ``strict`` asks for a class-0 object header and needs a
    ``poll_class`` column."""
    hit = (F.col("dst_port") == port) & (F.col("fc") == 1)
    if strict:
        hit = hit & (F.col("poll_class") == "CLASS_0")
    return frames.where(hit).withColumn("sid", F.lit(SIG_CLASS0_READ).cast("long"))


def nonstandard_port(packets: DataFrame, port: int = DNP3_PORT) -> DataFrame:
    """Packets that carry at least one frame to another port."""
    return packets.where(F.col("dst_port") != port).where(
        F.size(dnp3.parse_frames(F.col("payload"))) > 0
    ).withColumn("sid", F.lit(SIG_NONSTANDARD_PORT).cast("long"))


def request_flood(
    frames: DataFrame, count: int = 60, window_us: int = 60 * SECOND_US, port: int = DNP3_PORT,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Every ``count``-th frame of a source to the server inside an opened window."""
    asked = frames.where(F.col("dst_port") == port).select("src_ip", "ts_us", "pkt_no", "frame_no")
    placed = windows_opened(
        asked, ["src_ip"], "ts_us", ["pkt_no", "frame_no"], window_us, chunk_us
    )
    return placed.where(F.col("window_pos") % count == 0).withColumn(
        "sid", F.lit(SIG_REQUEST_FLOOD).cast("long")
    )


def recent_verdicts(verdicts: DataFrame, n: int = 500, tie: str = "event_id") -> DataFrame:
    return verdicts.orderBy(F.desc("ts_us"), F.desc(tie)).limit(n)


def running_counters(
    verdicts: DataFrame, keys: list[str] | None = None, tie: str = "event_id",
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Flows scored and alerts raised so far, on every verdict; overall or per key."""
    alert = F.col("kind").isin("ALERT", "ALERT-AI").cast("long")
    return running(
        verdicts, keys or [], ["ts_us", tie], cell("ts_us", chunk_us),
        sums={"flows_scored": F.lit(1), "alerts": alert},
    )


def replayed_frames(
    frames: DataFrame, seq_jump: int = 10_000, chunk_us: int = MINUTE_US
) -> DataFrame:
    """Requests that repeat another session's content, or whose seq jumps or runs backward.

    Adds ``repeated`` (an earlier frame of another session has the same type, point and
    value), ``jumped`` and ``backward``. Per content only the two earliest sessions are
    needed, so a popular content is one row after pre-aggregation.
    """
    content = ["type", "point_id", "value"]
    pos = F.struct("at_us", "session", "seq")
    celled = with_cells(frames, ["session"], cell("at_us", chunk_us))
    first = celled.groupBy(*content, "session").agg(F.min(pos).alias("first"))
    two = Window.partitionBy(*content).orderBy("first")
    early = (
        first.withColumn("__rank", F.row_number().over(two)).where("__rank <= 2")
        .groupBy(*content).agg(
            F.min_by("session", "__rank").alias("__owner"),
            F.min(F.when(F.col("__rank") == 2, F.col("first"))).alias("__second"),
        )
        .withColumnsRenamed({c: f"__k_{c}" for c in content})
    )
    prev = running(celled, ["session"], ["at_us", "seq"], last={"prev_seq": F.col("seq")})
    joined = prev.drop("__k").join(early, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in content])
    repeated = (F.col("session") != F.col("__owner")) | F.coalesce(
        F.col("__second") < pos, F.lit(False)
    )
    return joined.withColumns({
        "repeated": repeated,
        "jumped": F.coalesce(F.col("seq") - F.col("prev_seq") >= seq_jump, F.lit(False)),
        "backward": F.coalesce(F.col("seq") <= F.col("prev_seq"), F.lit(False)),
    }).drop("__owner", "__second", *[f"__k_{c}" for c in content])


def replay_burst_flows(
    flows: DataFrame, max_duration_us: int = 50_000, max_iat_us: float = 2_000.0,
    min_fwd_rate: float = 500.0,
) -> DataFrame:
    """Short flows with tiny gaps and a high forward rate."""
    return flows.where(
        (F.col("flow_duration") <= max_duration_us) & (F.col("tot_fwd_pkts") > 1)
        & (F.col("flow_iat_mean") < max_iat_us) & (F.col("fwd_pkts_s") >= min_fwd_rate)
    )


def response_delay(
    matched: DataFrame, baseline: DataFrame, by: str = "session", added_us: int = 15_000,
) -> DataFrame:
    """Peers whose mean response latency exceeds their baseline mean by ``added_us``."""
    now = matched.where("latency_us IS NOT NULL").groupBy(by).agg(
        F.avg("latency_us").alias("mean_us"), F.count(F.lit(1)).alias("replies")
    )
    base = baseline.where("latency_us IS NOT NULL").groupBy(by).agg(
        F.avg("latency_us").alias("base_us")
    )
    return now.join(base, by).where(F.col("mean_us") - F.col("base_us") >= added_us)


def _tumbling(width_us: int) -> Column:
    return F.col("ts_us") - F.pmod("ts_us", F.lit(width_us))


def address_sweep(frames: DataFrame, min_addresses: int = 20, window_us: int = 60 * SECOND_US) -> DataFrame:
    """Sources that probe many link addresses in one window."""
    return (
        frames.where(dnp3.is_link_status(F.col("ctrl")))
        .groupBy("src_ip", _tumbling(window_us).alias("window_us"), "dst")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("src_ip", "window_us")
        .agg(F.count(F.lit(1)).alias("addresses"), F.sum("n").alias("probes"))
        .where(F.col("addresses") >= min_addresses)
    )


def connection_flood(
    packets: DataFrame, min_requests: int, window_us: int = 60 * SECOND_US, port: int | None = None
) -> DataFrame:
    """Sources whose connects and requests in one window reach the bound."""
    rows = packets if port is None else packets.where(F.col("dst_port") == port)
    syn = F.col("tcp_flags") == SYN
    return (
        rows.groupBy("src_ip", "dst_port", _tumbling(window_us).alias("window_us"))
        .agg(F.count_if(syn).alias("connects"),
             F.count_if(~syn & (F.col("payload_len") > 0)).alias("requests"))
        .where(F.col("connects") + F.col("requests") >= min_requests)
    )
