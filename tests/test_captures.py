import pytest
from pyspark.sql import functions as F

import wire
from fieldwire.constants import PAYLOAD_FEATURES
from fieldwire.operators import clean, detect, flows, models
from fieldwire.plans import captures, sessions, traffic
from fieldwire.sources.pcap import read_pcap

A, B = ("10.0.0.1", 40000), ("10.0.0.2", 20000)
S = 1_000_000
READ = wire.frame(0xC4, 1, 2, b"\xc0\xc0\x01\x3c\x02\x06")
REPLY = wire.frame(0x44, 2, 1, b"\xc0\xc0\x81" + b"\0" * 20)
RESTART = wire.frame(0xC4, 1, 2, b"\xc0\xc0\x0d")


@pytest.fixture()
def folder(tmp_path):
    normal = [(i * S, wire.tcp(*B, *A, REPLY) if i % 2 else wire.tcp(*A, *B, READ)) for i in range(10)]
    # server speaks first, then is silent for longer than the idle time
    attack = [(0, wire.tcp(*B, *A, REPLY)), (1 * S, wire.tcp(*A, *B, RESTART * 2)),
              (2 * S, wire.tcp(*A, *B, b"", flags=17)), (30 * S, wire.tcp(*A, *B, READ))]
    (tmp_path / "NORMAL.pcap").write_bytes(wire.pcap(normal))
    (tmp_path / "COLD_RESTART.pcap").write_bytes(wire.pcap(attack))
    return str(tmp_path)


def test_payload_dataset(spark, folder):
    df = captures.payload_dataset(spark, folder)
    assert df.columns == [*PAYLOAD_FEATURES, "Label"]
    got = {r["Label"]: r for r in df.collect()}
    n, c = got["NORMAL"], got["COLD_RESTART"]
    assert (n.total_frames, n.fwd_frames, n.bwd_frames, n.most_common_req_fc, n.unique_fcs) == (10, 5, 5, 1, 2)
    assert (n.max_udata_len, n.min_udata_len, n.mean_udata_len) == (23, 6, 14.5)
    assert (c.total_frames, c.fwd_frames, c.bwd_frames, c.attack_fc_count, c.fc_cold_restart) == (4, 1, 3, 2, 2)
    assert c.response_ratio == 0.75 and c.most_common_req_fc == 0x0D
    assert {r["Label"] for r in captures.payload_dataset(spark, folder, "X", 20000).collect()} == {"X"}
    assert captures.payload_dataset(spark, folder, port=1).count() == 0


def test_flow_statistics_of_a_capture(spark, folder):
    p = read_pcap(spark, folder + "/COLD_RESTART.pcap")
    rows = flows.flow_features(p).orderBy("timestamp").collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port) == (*B, *A)
    assert (r.tot_fwd_pkts, r.tot_bwd_pkts, r.fin_flag_cnt, r.fwd_act_data_pkts) == (1, 2, 1, 1)
    assert (r.flow_duration, r.flow_iat_mean, r.bwd_iat_tot, r.fwd_iat_tot) == (2 * S, S, S, 0)
    assert (r.active_max, r.idle_max, r.subflow_bwd_pkts, r.down_up_ratio) == (2 * S, 0, 2.0, 2.0)
    assert (rows[1].src_ip, rows[1].tot_fwd_pkts, rows[1].flow_duration, rows[1].flow_byts_s) == (A[0], 1, 0, 0.0)


def test_score_captures(spark, folder):
    data = clean.rename_flow_columns(flows.flow_features(read_pcap(spark, folder)))
    train = data.withColumn("Label", F.when(F.col("`FIN Flag Cnt`") > 0, "COLD_RESTART").otherwise("NORMAL"))
    model = models.fit_model(train, ["FIN Flag Cnt", "Idle Max"], kind="tree", depth=2)
    scored, summary = captures.score_captures(spark, folder, model)
    assert {r["class"]: r["count"] for r in summary.collect()}["TOTAL"] == scored.count()
    assert scored.where("predicted_label = 'COLD_RESTART'").count() == 1


def test_a_chain_of_passes_reads_once(spark, tmp_path):
    """The whole plan, without broadcast: one scan and one exchange of rows, which all passes share."""
    traffic.packets(traffic.load_events(spark, "/root/testdata/sf0.001")).drop("file").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p")).withColumn("file", F.lit("x"))
    frames = p.select(F.col("src_ip").alias("session"), F.col("pkt_no").alias("seq"), F.col("ts_us").alias("at_us"),
                      F.col("event_type").alias("type"), F.col("user_id").alias("point_id"), "value")
    chains = {
        "sessionize": lambda: flows.sessionize(p.drop("payload"), 15 * S), "flow_features": lambda: flows.flow_features(p),
        "payload_sessions": lambda: sessions.payload_sessions(p), "replayed_frames": lambda: detect.replayed_frames(frames),
    }
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for name, made in chains.items():
            plan = made()._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1, name
            of_rows = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
            assert sum("ReusedExchange" not in x for x in of_rows) == 1 < len(of_rows), name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
