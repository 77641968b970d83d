"""Flow keys, sessions, payload features and flow statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    ACK, BENIGN, CWR, DNP3_PORT, ECE, FC_FEATURES, FIN, FLOW_RENAME, MIN_FLOWS_REBUILD,
    MIN_FLOWS_WANTED, PAYLOAD_FEATURES, PSH, RST, SYN, URG,
)
from ..functions import dnp3
from ..functions.net import FLOW_KEY, canonical_key, touches_port
from .ordered import MINUTE_US, cell, running, with_cells

SECOND_US = 1_000_000


def frames_of(packets: DataFrame, port: int = 0) -> DataFrame:
    """One row per frame: the packet's columns without its payload, and the frame's.

    The port filter runs before the parser, which Spark cannot move by itself.
    """
    rows = packets.where(touches_port(F.col("src_port"), F.col("dst_port"), port))
    kept = [c for c in packets.columns if c != "payload"]
    return (
        rows.select(*kept, F.posexplode(dnp3.parse_frames(F.col("payload"))).alias("frame_no", "f"))
        .select(*kept, "frame_no", "f.*")
    )


def with_flow_key(df: DataFrame) -> DataFrame:
    return df.withColumns(canonical_key())


def packed_position(order: tuple[str, ...]) -> Column:
    """Order columns as one DECIMAL, a fixed-width value that hash aggregation can keep.

    Room for frame numbers below 10^5, packet numbers below 10^15 and timestamps below
    10^17; a number beyond stops the query rather than overlap its neighbour.
    """
    width = {"frame_no": 1, "pkt_no": 10**5, "ts_us": 10**20}
    room = {"frame_no": 10**5, "pkt_no": 10**15, "ts_us": 10**17}
    big = "decimal(38,0)"

    def held(o: str) -> Column:
        beyond = F.abs(F.col(o)) >= F.lit(room[o])
        return F.when(beyond, F.raise_error(F.lit(f"{o} has no room in the packed position"))).otherwise(F.col(o))

    terms = [held(o).cast(big) * F.lit(str(width[o])).cast("decimal(21,0)") for o in order]
    return sum(terms[1:], terms[0]).cast(big)


def payload_features(
    frames: DataFrame, keys: list[str] | None = None, mode: str = "first",
    port: int = DNP3_PORT, order: tuple[str, ...] = ("pkt_no", "frame_no"),
) -> DataFrame:
    """22 payload features per flow.

    ``mode='first'``: forward is the direction of the flow's first frame;
    ``mode='port'``: forward goes to ``port``. Level one groups by (flow, fc) and level two
    joins the at most 257 rows of a flow, so counts shrink before every shuffle.
    """
    keys = keys or FLOW_KEY
    rows = with_flow_key(frames) if "is_ab" not in frames.columns else frames
    pos = packed_position(order)
    side = F.col("is_ab") if mode == "first" else F.col("dst_port") == port
    has_user = F.col("user_data_len") > 0
    by_fc = rows.groupBy(*keys, "fc").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(side).alias("n_side"),
        F.count_if(dnp3.is_link_status(F.col("ctrl"))).alias("n_link"),
        F.count_if(has_user).alias("n_user"), F.sum("user_data_len").alias("sum_user"),
        F.max("user_data_len").alias("max_user"),
        F.min(F.when(has_user, F.col("user_data_len"))).alias("min_user"),
        F.min(pos).alias("first_pos"), F.min_by("is_ab", pos).alias("first_ab"),
    )
    fc = F.col("fc")
    known = fc.isNotNull()
    attacks = F.when(dnp3.is_attack(fc), F.col("n")).otherwise(0)
    # most frequent code, the earliest of equals: smallest (-count, first position)
    rank = F.struct((-F.col("n")).alias("n"), F.col("first_pos").alias("p"))
    flow = by_fc.groupBy(*keys).agg(
        F.sum("n").alias("total_frames"), F.sum("n_side").alias("n_side"),
        F.min_by("first_ab", "first_pos").alias("first_ab"),
        F.sum(attacks).cast("long").alias("attack_fc_count"),
        F.sum("n_link").alias("link_status_count"),
        F.count("fc").alias("unique_fcs"),
        F.coalesce(F.min_by("fc", F.when(known, rank)), F.lit(-1)).cast("long")
        .alias("most_common_req_fc"),
        *[F.sum(F.when(fc == code, F.col("n")).otherwise(0)).cast("long").alias(name)
          for name, code in FC_FEATURES.items()],
        F.sum("n_user").alias("n_user"), F.sum("sum_user").alias("sum_user"),
        F.coalesce(F.max("max_user"), F.lit(0)).cast("long").alias("max_udata_len"),
        F.coalesce(F.min("min_user"), F.lit(0)).cast("long").alias("min_udata_len"),
    )
    total = F.col("total_frames")
    fwd = F.col("n_side") if mode == "port" else F.when(
        F.col("first_ab"), F.col("n_side")
    ).otherwise(total - F.col("n_side"))
    out = flow.withColumn("fwd_frames", fwd).withColumns({
        "bwd_frames": total - F.col("fwd_frames"),
        "response_ratio": (total - F.col("fwd_frames")) / total,
        "attack_fc_ratio": F.col("attack_fc_count") / total,
        "link_status_ratio": F.col("link_status_count") / total,
        "mean_udata_len": F.coalesce(F.try_divide("sum_user", "n_user"), F.lit(0.0)),
    })
    return out.select(*keys, "first_ab", *PAYLOAD_FEATURES)


def sessionize(
    packets: DataFrame, idle_us: int, end_on_flags: bool = True, chunk_us: int = MINUTE_US,
    order: tuple[str, ...] = ("ts_us", "pkt_no"), parts: int | None = None,
) -> DataFrame:
    """Cut each flow at gaps longer than ``idle_us`` and after FIN or RST.

    Adds ``prev_ts``, ``new_flow`` and ``flow_start``, the (ts, pkt_no, is_ab) of the
    first packet of the row's session.
    """
    rows = with_flow_key(packets) if "is_ab" not in packets.columns else packets
    order = list(order)
    ends = F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0 if end_on_flags else F.lit(False)
    celled = with_cells(rows, FLOW_KEY, cell("ts_us", chunk_us), parts)
    prev = running(celled, FLOW_KEY, order, last={
        "__prev": F.struct(F.col("ts_us").alias("ts"), ends.alias("ended")),
    })
    new = (
        F.col("__prev").isNull() | F.col("__prev.ended")
        | (F.col("ts_us") - F.col("__prev.ts") > F.lit(idle_us))
    )
    marked = prev.withColumns({"new_flow": new, "prev_ts": F.col("__prev.ts")}).drop("__prev")
    here = F.struct(F.col("ts_us").alias("ts"), F.col("pkt_no").alias("pkt_no"),
                    F.col("is_ab").alias("is_ab"))
    started = running(marked, FLOW_KEY, order, last={
        "__start": F.when(F.col("new_flow"), here),
    })
    return started.withColumn(
        "flow_start", F.when(F.col("new_flow"), here).otherwise(F.col("__start"))
    ).drop("__start", "__k")


def inter_arrival(packets: DataFrame, chunk_us: int = MINUTE_US) -> DataFrame:
    """Time since the previous packet of the flow, and of the flow's own direction."""
    rows = with_flow_key(packets) if "is_ab" not in packets.columns else packets
    ts = F.col("ts_us")
    out = running(rows, FLOW_KEY, ["ts_us", "pkt_no"], cell("ts_us", chunk_us), last={
        "__any": ts, "__ab": F.when(F.col("is_ab"), ts), "__ba": F.when(~F.col("is_ab"), ts),
    })
    same = F.when(F.col("is_ab"), F.col("__ab")).otherwise(F.col("__ba"))
    return out.withColumns(
        {"flow_iat_us": ts - F.col("__any"), "dir_iat_us": ts - same}
    ).drop("__any", "__ab", "__ba")


def flow_features(
    packets: DataFrame, idle_us: int = 15 * SECOND_US, active_us: int = 5 * SECOND_US,
    subflow_us: int = SECOND_US, bulk_gap_us: int = SECOND_US, bulk_min: int = 4,
    chunk_us: int = MINUTE_US, parts: int | None = None,
) -> DataFrame:
    """Flow statistics under the extractor's column names, one row per session.

    ``parts``: tasks of the passes over packets, which bounds the memory of each (:func:`with_cells`).
    Payload bytes are never read, only ``payload_len``. Two carried passes give each packet its predecessors and the start of its session,
    active span and bulk run. Everything else is one partial+final aggregation.
    Times in microseconds, deviations of the population, undefined values 0.
    """
    if bulk_gap_us > idle_us:
        raise ValueError("a bulk gap cannot be longer than the idle time that ends a session")
    slim = with_flow_key(packets).select(
        *FLOW_KEY, "is_ab", "ts_us", "pkt_no", "proto", F.col("ip_len").cast("long").alias("len"), F.col("hdr_len").cast("long").alias("hdr"),
        "tcp_flags", F.col("win").cast("long").alias("win"), F.col("payload_len").cast("long").alias("pay"),
    )
    order = ["ts_us", "pkt_no"]
    celled = with_cells(slim, FLOW_KEY, cell("ts_us", chunk_us), parts)
    ts, ab, data = F.col("ts_us"), F.col("is_ab"), F.col("pay") > 0
    at = F.struct(ts.alias("ts"), F.col("pkt_no").alias("pkt_no"))
    ended = F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0
    first = running(celled, FLOW_KEY, order, last={
        "p": F.struct(ts.alias("ts"), ended.alias("ended")),
        "p_ab": F.when(ab, at), "p_ba": F.when(~ab, at),
        "p_data": F.when(data, F.struct(at.alias("at"), ab.alias("ab"))),
        "p_end": F.when(ended, at),
    }, sums={
        "n_data": data.cast("long"), "n_bytes": F.when(data, F.col("pay")).otherwise(0),
    })
    gap = ts - F.col("p.ts")
    new = F.col("p").isNull() | F.col("p.ended") | (gap > F.lit(idle_us))
    run = data & (
        F.col("p_data").isNull() | (F.col("p_data.ab") != ab)
        | (ts - F.col("p_data.at.ts") > F.lit(bulk_gap_us))
        | F.coalesce(F.col("p_data.at") <= F.col("p_end"), F.lit(False))
    )
    here = F.struct(ts.alias("ts"), F.col("pkt_no").alias("pkt_no"), ab.alias("ab"))
    run_here = F.struct(ts.alias("ts"), (F.col("n_data") - 1).alias("n"),
                        (F.col("n_bytes") - F.col("pay")).alias("bytes"))
    first = first.withColumns({"gap": gap, "new": new, "new_run": run}).withColumn(
        "new_span", F.col("new") | (F.col("gap") > F.lit(active_us))
    )
    both = running(first, FLOW_KEY, order, last={
        "s_flow": F.when(F.col("new"), here), "s_span": F.when(F.col("new_span"), ts),
        "s_run": F.when(F.col("new_run"), run_here),
    })
    flow = F.when(F.col("new"), here).otherwise(F.col("s_flow"))
    span = F.when(F.col("new_span"), ts).otherwise(F.col("s_span"))
    run_at = F.when(F.col("new_run"), run_here).otherwise(F.col("s_run"))
    rows = both.withColumns({
        "flow": flow, "span_now": span, "run_at": run_at,
    }).withColumns({
        "fwd": ab == F.col("flow.ab"),
        "p_same": F.when(ab, F.col("p_ab")).otherwise(F.col("p_ba")),
        "run_pos": F.when(data, F.col("n_data") - F.col("run_at.n")),
    }).withColumns({
        "iat": F.when(~F.col("new"), F.col("gap")),
        "dir_iat": F.when(
            F.col("p_same") >= F.struct(F.col("flow.ts"), F.col("flow.pkt_no")),
            ts - F.col("p_same.ts"),
        ),
        # a span closes where the next one opens inside the same session
        "active": F.when(F.col("new_span") & ~F.col("new"), F.col("p.ts") - F.col("s_span")),
        "idle": F.when(F.col("new_span") & ~F.col("new"), F.col("gap")),
        "bulk_pkts": F.when(F.col("run_pos") == bulk_min, F.lit(bulk_min))
        .when(F.col("run_pos") > bulk_min, F.lit(1)),
        "bulk_bytes": F.when(F.col("run_pos") == bulk_min, F.col("n_bytes") - F.col("run_at.bytes"))
        .when(F.col("run_pos") > bulk_min, F.col("pay")),
        "bulk_us": F.when(F.col("run_pos") == bulk_min, ts - F.col("run_at.ts"))
        .when(F.col("run_pos") > bulk_min, ts - F.col("p_data.at.ts")),
    })
    fwd, bwd = F.col("fwd"), ~F.col("fwd")

    def stats(name: str, value: Column) -> list[Column]:
        return [F.max(value).alias(f"{name}_max"), F.min(value).alias(f"{name}_min"),
                F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std")]

    def bit(mask: int, where: Column | None = None) -> Column:
        on = F.col("tcp_flags").bitwiseAND(F.lit(mask)) != 0
        return F.count_if(on if where is None else on & where)

    # only fixed-width buffers, so that the aggregation hashes instead of sorting
    size, opening = F.col("len"), F.col("dir_iat").isNull()
    aggs = [
        F.min("proto").cast("long").alias("protocol"), F.min("ts_us").alias("timestamp"),
        (F.max("ts_us") - F.min("ts_us")).alias("flow_duration"),
        F.count_if(fwd).alias("tot_fwd_pkts"), F.count_if(bwd).alias("tot_bwd_pkts"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("totlen_fwd_pkts"),
        F.sum(F.when(bwd, size).otherwise(0)).alias("totlen_bwd_pkts"),
        *stats("fwd_pkt_len", F.when(fwd, size)), *stats("bwd_pkt_len", F.when(bwd, size)),
        *stats("pkt_len", size), F.var_pop(size).alias("pkt_len_var"),
        F.sum(F.when(fwd, F.col("hdr")).otherwise(0)).alias("fwd_header_len"),
        F.sum(F.when(bwd, F.col("hdr")).otherwise(0)).alias("bwd_header_len"),
        F.min(F.when(fwd, F.col("hdr"))).alias("fwd_seg_size_min"),
        F.count_if(fwd & data).alias("fwd_act_data_pkts"),
        *stats("flow_iat", F.col("iat")),
        F.sum(F.when(fwd, F.col("dir_iat"))).alias("fwd_iat_tot"),
        *stats("fwd_iat", F.when(fwd, F.col("dir_iat"))),
        F.sum(F.when(bwd, F.col("dir_iat"))).alias("bwd_iat_tot"),
        *stats("bwd_iat", F.when(bwd, F.col("dir_iat"))),
        bit(PSH, fwd).alias("fwd_psh_flags"), bit(PSH, bwd).alias("bwd_psh_flags"),
        bit(URG, fwd).alias("fwd_urg_flags"), bit(URG, bwd).alias("bwd_urg_flags"),
        bit(FIN).alias("fin_flag_cnt"), bit(SYN).alias("syn_flag_cnt"), bit(RST).alias("rst_flag_cnt"),
        bit(PSH).alias("psh_flag_cnt"), bit(ACK).alias("ack_flag_cnt"), bit(URG).alias("urg_flag_cnt"),
        bit(ECE).alias("ece_flag_cnt"), bit(CWR).alias("cwr_flag_count"),
        F.max(F.when(fwd & opening, F.col("win"))).alias("init_fwd_win_byts"),
        F.max(F.when(bwd & opening, F.col("win"))).alias("init_bwd_win_byts"),
        F.count("active").alias("__an"), *stats("__a", F.col("active")),
        (F.max("ts_us") - F.max("span_now")).alias("__alast"),
        *stats("idle", F.col("idle")),
        *[F.count_if(side & (F.col("run_pos") == bulk_min)).alias(f"__{d}_bulks")
          for d, side in (("fwd", fwd), ("bwd", bwd))],
        *[F.sum(F.when(side, F.col(f"bulk_{v}"))).alias(f"__{d}_bulk_{v}")
          for d, side in (("fwd", fwd), ("bwd", bwd)) for v in ("pkts", "bytes", "us")],
        (F.count_if(F.col("iat") > F.lit(subflow_us)) + 1).alias("__subflows"),
    ]
    agg = rows.groupBy(*FLOW_KEY, "flow").agg(*aggs)

    def div(a: str | Column, b: str | Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    sec = F.col("flow_duration") / SECOND_US
    pkts = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")
    total = F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")
    # the last span of a session has no successor: add it to the closed ones
    n, x = F.col("__an"), F.col("__alast").cast("double")
    m = F.coalesce("__a_mean", F.lit(0.0))
    v = F.pow(F.coalesce("__a_std", F.lit(0.0)), 2)
    a_first = F.col("flow.ab")
    pick = lambda a, b: F.when(a_first, F.col(a)).otherwise(F.col(b))
    derived = {
        "src_ip": pick("a_ip", "b_ip"), "dst_ip": pick("b_ip", "a_ip"),
        "src_port": pick("a_port", "b_port").cast("long"),
        "dst_port": pick("b_port", "a_port").cast("long"),
        "flow_byts_s": div(total, sec), "flow_pkts_s": div(pkts, sec),
        "fwd_pkts_s": div("tot_fwd_pkts", sec), "bwd_pkts_s": div("tot_bwd_pkts", sec),
        "down_up_ratio": div("tot_bwd_pkts", "tot_fwd_pkts"), "pkt_size_avg": div(total, pkts),
        "active_max": F.greatest("__a_max", "__alast"), "active_min": F.least("__a_min", "__alast"),
        "active_mean": (n * m + x) / (n + 1),
        "active_std": F.sqrt((n * v + F.pow(x - m, 2) * n / (n + 1)) / (n + 1)),
        "fwd_seg_size_avg": F.col("fwd_pkt_len_mean"), "bwd_seg_size_avg": F.col("bwd_pkt_len_mean"),
    }
    for d in ("fwd", "bwd"):
        derived |= {
            f"{d}_byts_b_avg": div(f"__{d}_bulk_bytes", f"__{d}_bulks"),
            f"{d}_pkts_b_avg": div(f"__{d}_bulk_pkts", f"__{d}_bulks"),
            f"{d}_blk_rate_avg": div(f"__{d}_bulk_bytes", F.col(f"__{d}_bulk_us") / SECOND_US),
            f"subflow_{d}_pkts": div(f"tot_{d}_pkts", "__subflows"),
            f"subflow_{d}_byts": div(f"totlen_{d}_pkts", "__subflows"),
        }
    full = agg.withColumns(derived)
    counts = {f.name for f in full.schema if f.dataType.simpleString() == "bigint"}
    return full.select(
        "src_ip", "dst_ip",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in counts
          else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FLOW_RENAME],
        F.col("flow.pkt_no").alias("first_pkt_no"),
    )


def verdict_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per class, then rows for the total and for all attacks."""
    per = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    classes = per.withColumn("pct", 100 * F.col("count") / F.sum("count").over(whole))
    n, attacks = F.sum("count"), F.sum(F.when(F.col("class") != BENIGN, F.col("count")).otherwise(0))
    totals = per.agg(n.alias("n"), attacks.alias("a")).select(
        F.inline(F.array(
            F.struct(F.lit("TOTAL").alias("class"), F.col("n").alias("count"),
                     F.lit(100.0).alias("pct")),
            F.struct(F.lit("ATTACKS").alias("class"), F.col("a").alias("count"),
                     (100 * F.col("a") / F.col("n")).alias("pct")),
        ))
    ).where(F.col("count").isNotNull())
    return classes.unionByName(totals)


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Classes by falling frequency."""
    return verdict_summary(df, label).where(~F.col("class").isin("TOTAL", "ATTACKS")).orderBy(
        F.desc("count"), "class"
    )


def class_counts(df: DataFrame, label: str = "Label", source: str | None = None) -> DataFrame:
    by = ([source] if source else []) + [label]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def dataset_health(df: DataFrame, label: str = "Label") -> DataFrame:
    """Per class: rows, and whether it needs a rebuild or more flows; NORMAL against attacks."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy()
    normal = F.coalesce(F.sum(F.when(F.col("label") == BENIGN, F.col("rows"))).over(whole), F.lit(0))
    state = (
        F.when(F.col("rows") < MIN_FLOWS_REBUILD, "rebuild")
        .when(F.col("rows") < MIN_FLOWS_WANTED, "few").otherwise("ok")
    )
    return n.withColumns({
        "state": state, "normal_covers_attacks": normal >= F.sum("rows").over(whole) - normal,
    })


def forward_payloads(packets: DataFrame, port: int, chunk_us: int = MINUTE_US) -> DataFrame:
    """Payload chunks sent to ``port``, numbered in order per flow; one row per chunk."""
    rows = packets.where((F.col("dst_port") == port) & (F.col("payload_len") > 0))
    return running(
        rows, ["src_ip", "src_port", "dst_ip", "dst_port"], ["ts_us", "pkt_no"],
        cell("ts_us", chunk_us), sums={"chunk_no": F.lit(1)},
    ).select("src_ip", "src_port", "dst_ip", "dst_port", "chunk_no", "pkt_no", "payload")


def replay_totals(packets: DataFrame, port: int) -> DataFrame:
    """Flows, segments and bytes sent to ``port``."""
    rows = packets.where((F.col("dst_port") == port) & (F.col("payload_len") > 0))
    per = rows.groupBy("src_ip", "src_port", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.col("payload_len").cast("long")).alias("bytes")
    )
    return per.agg(
        F.count(F.lit(1)).alias("flows"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def detect_service_port(packets: DataFrame, default: int = DNP3_PORT) -> DataFrame:
    """Most common destination port among packets with payload; the default without any."""
    n = packets.where(F.col("payload_len") > 0).groupBy("dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.min("pkt_no").alias("first")
    )
    best = F.min_by("dst_port", F.struct(-F.col("n"), F.col("first")))
    return n.agg(F.coalesce(best, F.lit(default)).alias("service_port"))


def talker_profile(packets: DataFrame) -> DataFrame:
    """Who talks to whom: packets, bytes, packets per second and ports used."""
    per_port = packets.groupBy("src_ip", "dst_ip", "src_port", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ip_len").cast("long")).alias("b"),
        F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"),
    )
    sec = (F.max("t1") - F.min("t0")) / SECOND_US
    return per_port.groupBy("src_ip", "dst_ip").agg(
        F.sum("n").alias("packets"), F.sum("b").alias("bytes"),
        F.coalesce(F.try_divide(F.sum("n"), sec), F.lit(0.0)).alias("pkts_per_s"),
        F.count_distinct("dst_port").alias("dst_ports"),
        F.count_distinct("src_port").alias("src_ports"),
    )


def observe_packets(packets: DataFrame, port: int, first_n: int | None = None) -> DataFrame:
    """Endpoints and payload length of packets that touch ``port``; optionally the first n."""
    seen = packets.where(touches_port(F.col("src_port"), F.col("dst_port"), port)).select(
        "pkt_no", "src_ip", "src_port", "dst_ip", "dst_port",
        "payload_len",
    )
    return seen.orderBy("pkt_no").limit(first_n) if first_n else seen


def point_last_value(frames: DataFrame) -> DataFrame:
    """Last written value of every point."""
    pos = F.struct("at_us", "seq")
    return frames.where("type = 'WRITE'").groupBy("point_id").agg(
        F.max_by("value", pos).alias("value"), F.max("at_us").alias("written_us")
    )
