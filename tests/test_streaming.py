"""Streams in several batches, with gaps, ties at the edges and late closing rows."""

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import wire
from fieldwire.functions.net import FLOW_KEY, canonical_key
from fieldwire.operators import clean, detect, flows, models
from fieldwire.operators.joins import suppress_covered
from fieldwire.plans.sessions import payload_sessions
from fieldwire.schemas import PACKETS
from fieldwire.streaming import queries as live, state

S = 1_000_000
T0 = 1_700_000_000 * S
ATTACK = wire.frame(0xC4, 1, 2, b"\xc0\xc0\x0d")
PROBE = wire.frame(0xC9, 1, 2)
READ = wire.frame(0xC4, 1, 2, b"\xc0\xc0\x01\x3c\x01\x06")


def packet(no, sec, payload, src="10.0.0.1", back=False, flags=24):
    ends = (src, 40000, "10.0.0.9", 20000)
    a = ends[2:] + ends[:2] if back else ends
    return ("f", no, T0 + int(sec * S), *a, 6, 40 + len(payload), 40, flags, 512, len(payload), bytearray(payload))


def packets(n):
    """n seconds of traffic of three sources, one of them hot."""
    rows = []
    for i in range(n):
        rows.append(packet(len(rows), i, ATTACK if i % 3 else READ))
        if i % 2:
            rows.append(packet(len(rows), i, PROBE * 2, flags=17 if i % 31 == 0 else 24))
        if i % 7 == 0:
            rows.append(packet(len(rows), i + 0.5, READ, "10.0.0.2"))
            rows.append(packet(len(rows), i + 0.6, READ, "10.0.0.2", back=True))
        if i % 45 == 0:
            rows.append(packet(len(rows), i + 0.7, b"", "10.0.0.3", flags=17))
            rows.append(packet(len(rows), i + 0.8, ATTACK, "10.0.0.3"))
    return rows


@pytest.fixture()
def feed(spark, tmp_path):
    """Packets as one file per time slice, read one file per batch."""
    live.use_rocksdb(spark)
    rows = packets(200)
    df = spark.createDataFrame(rows, PACKETS)
    for i in range(5):
        df.where(F.floor((F.col("ts_us") - T0) / (40 * S)) == i).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    return df, live.stream_packets(spark, str(tmp_path / "in"), maxFilesPerTrigger=1, latestFirst=False)


@pytest.fixture()
def unordered(spark, tmp_path):
    """The same rows dealt to three files without order, one a batch."""
    live.use_rocksdb(spark)
    df = spark.createDataFrame(packets(200), PACKETS)
    for i in range(3):
        df.where(F.col("pkt_no") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, live.stream_packets(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)


def run(build, tmp_path):
    """Results and late rows of a query over ended streams."""
    return live.run_to_end(build, f"{tmp_path}/{uuid.uuid4().hex}")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cooldown_and_bursts_equal_batch(feed, tmp_path):
    df, stream = feed
    cols = ["src_ip", "ts_us", "pkt_no", "frame_no"]
    f = flows.frames_of(df, 20000)
    got, late = run(lambda end: live.live_command_injection(end(stream)), tmp_path)
    assert rows(got, *cols, "fc") == rows(detect.command_injection_alerts(f), *cols, "fc") and not late.count()
    got, late = run(lambda end: live.live_scan_burst(end(stream), 8), tmp_path)
    assert got.count() and rows(got, *cols) == rows(detect.scan_burst_alerts(f, 8), *cols) and not late.count()


RECORD = ["a_ip", "start_us", "end_us", "total_frames", "fwd_frames", "unique_fcs", "most_common_req_fc",
          "fc_read", "link_status_count", "mean_udata_len", "min_udata_len"]


@pytest.mark.parametrize("idle", [5 * S, S // 4])
def test_flow_records_equal_batch(feed, tmp_path, idle):
    df, stream = feed
    got, late = run(lambda end: live.live_flow_features(end(stream), idle, delay="5 seconds"), tmp_path)
    assert rows(got, *RECORD) == rows(payload_sessions(df, idle), *RECORD) and not late.count()


def test_late_rows_are_kept_and_settled(unordered, tmp_path):
    df, stream = unordered
    cols = ["src_ip", "fc", "ts_us", "pkt_no", "frame_no"]
    f = flows.frames_of(df, 20000).where("fc IN (13, 14, 15, 18, 20, 21)")
    want = rows(detect.command_injection_alerts(f), *cols)
    got, late = run(lambda end: live.live_command_injection(end(stream), delay="5 seconds"), tmp_path)
    assert late.count() and rows(got, *cols) != want
    # each attack frame has either been taken in order or lies in the side table
    assert {r.pkt_no for r in late.collect()} <= {r.pkt_no for r in f.collect()}
    settled = live.settled(got, late, ["src_ip", "fc"], lambda only: detect.command_injection_alerts(only(f)).drop("attack_class"))
    assert rows(settled, *cols) == want

    got, late = run(lambda end: live.live_flow_features(end(stream), 5 * S, delay="5 seconds"), tmp_path)
    keyed = df.withColumns(canonical_key())
    settled = live.settled(got, late, FLOW_KEY, lambda only: payload_sessions(only(keyed).drop(*FLOW_KEY, "is_ab"), 5 * S))
    assert late.count() and rows(settled, *RECORD) == rows(payload_sessions(df, 5 * S), *RECORD)


def test_rows_in_any_order_within_the_delay_are_not_late(unordered, tmp_path):
    df, stream = unordered
    got, late = run(lambda end: live.live_flow_features(end(stream), 5 * S, delay="1 hour"), tmp_path)
    assert not late.count() and rows(got, *RECORD) == rows(payload_sessions(df, 5 * S), *RECORD)


def test_suppression_equals_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    v = [(T0 + i * 10 * S, i, "a" if i % 2 else "b", 1, "b" if i % 2 else "a", 1, "REPLAY" if i % 3 else "NORMAL")
         for i in range(40)]
    a = [("alert", "a", 1, "b", 1, (7, "s7"), T0 + 15 * S), ("alert", "b", 1, "a", 1, (8, "s8"), T0 + 130 * S),
         ("alert", "b", 1, "a", 1, (9, "s9"), T0 + 130 * S), ("flow", "a", 1, "b", 1, (1, "x"), T0 + 200 * S),
         ("alert", "q", 1, "r", 1, (1, "x"), T0 + 395 * S)]
    vd = spark.createDataFrame(v, "ts_us LONG, event_id LONG, src_ip STRING, src_port INT, dst_ip STRING, "
                                  "dst_port INT, label STRING")
    ad = spark.createDataFrame(a, "event_type STRING, src_ip STRING, src_port INT, dest_ip STRING, dest_port INT,"
                                  " alert STRUCT<signature_id: LONG, signature: STRING>, ts_us LONG")
    want = {tuple(r) for r in suppress_covered(vd, ad).select("event_id", "kind", "sig_id", "sig_name").collect()}
    at = {r[0]: r for r in want}
    assert at[2][1:] == ("SUPPRESS", 7, "s7")  # reversed tuple
    assert at[7][1:] == ("SUPPRESS", 7, "s7") and at[8][1] == "ALERT-AI"  # 55 s and 65 s old
    assert at[19][1:] == ("SUPPRESS", 9, "s9")  # exactly at the edge, latest of two
    assert at[3][1:] == ("ok", None, None)
    vd.repartition(1).write.parquet(str(tmp_path / "v"))
    ad.repartition(1).write.json(str(tmp_path / "a"))
    got, late = run(lambda end: live.live_suppress(end(spark.readStream.schema(vd.schema).parquet(str(tmp_path / "v"))),
                                                   end(live.stream_alerts(spark, str(tmp_path / "a")))), tmp_path)
    assert {tuple(r) for r in got.select("event_id", "kind", "sig_id", "sig_name").collect()} == want and not late.count()


def test_scoring_stream_equals_batch(spark, tmp_path):
    cols = ["src_ip", "src_port", "dst_port", "idle_max"]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("src_ip,src_port,dst_port,idle_max\nx,1,20000,5\nx,1,20000\nx,1,80,5\n")
    (folder / "b.csv").write_text('src_ip,src_port,dst_port,idle_max\n"y,z",20000,1,50\nq,20000,1,inf,9\n')
    train = spark.createDataFrame([(float(i), "NORMAL" if i < 20 else "REPLAY") for i in range(60)],
                                  "`Idle Max` DOUBLE, Label STRING")
    model = models.fit_model(train, ["Idle Max"], kind="tree", depth=2)
    out = live.score_flows(live.stream_flow_csv(spark, str(folder), cols), model)
    live.write_verdicts(out, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "o")), "src_ip", "dst_port", "predicted_label")
    assert got == [("x", 20000.0, "NORMAL"), ("y,z", 1.0, "REPLAY")]
    kind = clean.verdict_kind(F.col("predicted_label"), F.lit(False))
    live.write_verdicts(out.select(kind.alias("k")), str(tmp_path / "ko"), str(tmp_path / "ks")).awaitTermination()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "ko")).orderBy("k").collect()] == ["ALERT-AI", "ok"]


def test_keys_that_share_a_bucket_do_not_mix(feed, tmp_path, monkeypatch):
    """All keys in one group, over several batches: flows go on, windows and silences are each key's own."""
    monkeypatch.setattr(live, "BUCKETS", 1)
    df, stream = feed
    got, late = run(lambda end: live.live_flow_features(end(stream), 5 * S, delay="5 seconds"), tmp_path)
    assert rows(got, *RECORD) == rows(payload_sessions(df, 5 * S), *RECORD) and not late.count()
    cols = ["src_ip", "ts_us", "pkt_no", "frame_no"]
    got, late = run(lambda end: live.live_command_injection(end(stream)), tmp_path)
    assert rows(got, *cols, "fc") == rows(detect.command_injection_alerts(flows.frames_of(df, 20000)), *cols, "fc")


def test_rows_reach_their_bucket_packed(feed):
    """A bucket's rows come as one row a task, in their order; the detectors' plans pack before the exchange."""
    n = 1000
    rows = pa.RecordBatch.from_pydict({"ts_us": [T0 + (i * 7) % n for i in range(n)], "fc": [i if i % 3 else None for i in range(n)],
                                       state.BUCKET: pa.array([i % 5 for i in range(n)], pa.int32())})
    out = list(state.pack_buckets(iter([rows.slice(0, 300), rows.slice(300)])))
    got = pa.Table.from_batches(out).to_pylist()
    assert [r[state.BUCKET] for r in got] == [0, 1, 2, 3, 4]
    for r in got:
        mine = rows.to_pandas().iloc[r[state.BUCKET]::5].drop(columns=state.BUCKET)
        assert state.unpacked(r["rows"]).equals(mine.reset_index(drop=True)) and r["first_us"] == mine["ts_us"].min()
    for made in (live.live_flow_features(feed[1]), live.live_scan_burst(feed[1])):
        plan = made._jdf.queryExecution().analyzed().toString()
        assert plan.index("TransformWithState") < plan.index("MapInArrow")


def test_parts_are_written_by_all_tasks(spark, monkeypatch):
    from fieldwire.plans import queries

    monkeypatch.setattr(live, "run_to_end", lambda build, base: base)
    files = spark.read.parquet(f"{queries._live(spark, '/root/testdata/sf0.001', None, 3)}/in")
    assert len(files.inputFiles()) == 3 * spark.sparkContext.defaultParallelism and files.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
