import json

import pytest
from pyspark.sql import functions as F

import wire
from fieldwire.operators import clean, models
from fieldwire.sources import pcap, sinks, tables

A, B = ("10.0.0.1", 40000), ("10.0.0.2", 20000)


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("link,kind", [(1, "eth"), (1, "vlan"), (0, "null"), (12, "raw"), (101, "raw"), (113, "sll")])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pcap_links(spark, tmp_path, link, kind, order):
    payload = wire.frame(0xC4, 1, 2, b"\xc0\xc0\x01")
    records = [
        (1_000_002, wire.tcp(*A, *B, payload, flags=24, win=777, link=kind)),
        (1_000_003, wire.tcp(*B, *A, b"", flags=17, pad=b"\0" * 6, link=kind)),
        (1_000_004, wire.tcp(*A, *B, b"zz", link=kind, options=b"\1" * 12)),
    ]
    path = write(tmp_path / "x.pcap", wire.pcap(records, link, order))
    rows = pcap.read_pcap(spark, path).orderBy("pkt_no").collect()
    assert [(r.ts_us, r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.tcp_flags, r.win) for r in rows] == [
        (1_000_002, *A, *B, 24, 777), (1_000_003, *B, *A, 17, 512), (1_000_004, *A, *B, 24, 512)]
    assert [bytes(r.payload) for r in rows] == [payload, b"", b"zz"]
    assert [r.hdr_len for r in rows] == [40, 40, 52]
    loose = pcap.read_pcap(spark, path, trim=False, keep_empty=False).orderBy("pkt_no").collect()
    assert [bytes(r.payload) for r in loose] == [payload, b"\0" * 6, b"zz"]


def test_pcap_odd_files(spark, tmp_path):
    good = wire.pcap([(5, wire.tcp(*A, *B, b"x"))])
    udp = bytearray(wire.tcp(*A, *B, b"x"))
    udp[23] = 17
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 40
    write(tmp_path / "COLD_RESTART.pcap", good + b"\1" * 9)
    write(tmp_path / "EMPTY.pcap", b"")
    write(tmp_path / "NG.pcap", wire.pcap([(5, wire.tcp(*A, *B, b"x"))], magic=0x0A0D0D0A))
    write(tmp_path / "OTHER.pcap", wire.pcap([(5, bytes(udp)), (6, arp), (7, b"tiny"), (8, wire.tcp(*A, *B, b"y"))]))
    write(tmp_path / "notes.txt", b"no capture")
    rows = pcap.read_labelled_pcaps(spark, str(tmp_path)).collect()
    assert sorted((r.Label, bytes(r.payload), r.pkt_no) for r in rows) == [
        ("COLD_RESTART", b"x", 0), ("OTHER", b"y", 3)]
    assert {r.Label for r in pcap.read_labelled_pcaps(spark, str(tmp_path), "ONE").collect()} == {"ONE"}


def test_ranges_are_one_walk(spark, tmp_path):
    """Rows do not depend on the ranges: captures inside payloads, records over several ranges, both byte orders."""
    inner = wire.pcap([(7 + i, wire.tcp(*B, *A, b"q" * 30)) for i in range(12)])
    many = [(i, wire.tcp(*A, *B, bytes([i % 256]) * (i % 50))) for i in range(200)]
    nested = [(i, wire.tcp(*A, *B, inner if i % 2 else b"")) for i in range(20)]
    long = [(1, wire.tcp(*A, *B, b"\0" * 9000)), *many[:5], (2, wire.tcp(*A, *B, inner[24:]))]
    want, lengths = {}, {}
    for name, rows, order in (("many", many, "<"), ("nested", nested, ">"), ("in it", long, "<"), ("none", [], "<")):
        data = wire.pcap(rows, order=order)
        write(tmp_path / f"{name}.pcap", data + (b"\1" * 21 if name == "many" else b""))
        want[name], lengths[name] = rows, len(data)
    write(tmp_path / "other.pcap", b"\x0a\x0d\x0d\x0a" * 300)
    for size in (700, 1 << 20):
        index = pcap.capture_index(spark, str(tmp_path), size)
        got = {}
        for r in pcap.read_records(index).orderBy("file", "pkt_no").collect():
            got.setdefault(r.file.rpartition("/")[2][:-5], []).append((r.pkt_no, r.ts_us, bytes(r.data)))
        assert got == {n: [(i, *r) for i, r in enumerate(rows)] for n, rows in want.items() if rows}
        report = {r.file.rpartition("/")[2][:-5]: (r.is_capture, r.records, r.cut_bytes) for r in pcap.capture_report(index).collect()}
        assert report == {"many": (True, 200, 21), "nested": (True, 20, 0), "in it": (True, 7, 0), "none": (True, 0, 0),
                          "other": (False, 0, 0)}
    starts = [r for r in pcap.capture_index(spark, str(tmp_path / "many.pcap"), 700).collect() if r.no]
    assert len(starts) > 20 and all(r.n for r in starts[:-1])


def test_guesses_hold(tmp_path):
    """Plain captures are not walked anew: the guess is the start."""
    data = wire.pcap([(i, wire.tcp(*A, *B, bytes([i % 256]) * (i % 50))) for i in range(300)])
    path = write(tmp_path / "x.pcap", data)
    with pcap.open_file(path) as f:
        ends = [24, *(end for end, _, _ in pcap.records(f, "<", 24, len(data), len(data)))]
        for start in range(100, len(data) - 100, 997):
            assert pcap.likely_start(f, "<", 65535, start, len(data), len(data)) == next(e for e in ends if e >= start)


def test_written_captures(spark, tmp_path):
    rows = [(1_700_000_000_000_000 + i, wire.tcp(*A, *B, b"z" * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "ts_us LONG, data BINARY").repartition(3, "ts_us")
    sinks.write_pcap(df, str(tmp_path / "out"), 1)
    back = pcap.read_records(pcap.capture_index(spark, str(tmp_path / "out"), 512)).collect()
    assert sorted((r.ts_us, bytes(r.data)) for r in back) == rows
    assert {r.file.rpartition("/")[2][:5] for r in back} == {"part-"}


def test_flow_csv_and_labelled_dir(spark, tmp_path):
    write(tmp_path / "c" / "NORMAL.csv", "src_ip,src_port,flow_duration\n1.1.1.1,5,2.5\n1.1.1.2,6,bad\n")
    write(tmp_path / "c" / "COLD_RESTART.csv", "src_ip,src_port,idle_max\n1.1.1.3,7,9\n")
    write(tmp_path / "c" / "REPLAY.csv", "")
    df = tables.read_flow_csv(spark, str(tmp_path / "c" / "NORMAL.csv"))
    assert [tuple(r) for r in df.orderBy("src_port").collect()] == [("1.1.1.1", 5.0, 2.5), ("1.1.1.2", 6.0, None)]
    with pytest.raises(ValueError):
        tables.read_flow_csv(spark, str(tmp_path / "c" / "REPLAY.csv"))
    out = tables.read_labelled_dir(spark, str(tmp_path / "c"), collapse=True)
    got = {(r["src_ip"], r["Src Port"], r["Flow Duration"], r["Idle Max"], r["Label"]) for r in out.collect()}
    assert got == {("1.1.1.1", 5.0, 2.5, None, "NORMAL"), ("1.1.1.2", 6.0, None, None, "NORMAL"),
                   ("1.1.1.3", 7.0, None, 9.0, "DNP3_COMMAND_INJECTION")}
    same = tables.read_labelled_dir(spark, str(tmp_path / "c"), ["src_ip", "src_port", "x"], label="ALL")
    assert {r["Label"] for r in same.collect()} == {"ALL"}


def test_read_many_skips_bad_ones(spark, tmp_path):
    a = write(tmp_path / "a.csv", "src_port,Label\n1,NORMAL\n")
    b = write(tmp_path / "b.csv", "src_port\n1\n")
    c = write(tmp_path / "c.csv", "idle_max,Label\n3,REPLAY\n")
    out = tables.read_many(spark, [a, b, str(tmp_path / "gone.csv"), c])
    assert {(r["Src Port"], r["Idle Max"], r["Label"]) for r in out.collect()} == {
        (1.0, None, "NORMAL"), (None, 3.0, "REPLAY")}
    with pytest.raises(ValueError):
        tables.read_many(spark, [b])


def test_alerts_and_control_frames(spark, tmp_path):
    ok = {"event_type": "alert", "src_ip": "a", "src_port": 1, "dest_ip": "b", "dest_port": 2, "ts_us": 9,
          "alert": {"signature_id": 5, "signature": "s"}}
    bare = {k: v for k, v in ok.items() if k != "alert"}
    cut = {k: v for k, v in ok.items() if k != "dest_port"}
    path = write(tmp_path / "eve.json", "\n".join(
        [json.dumps(ok), json.dumps(bare), json.dumps(cut), json.dumps({**ok, "event_type": "flow"}), "{bad"]))
    got = {tuple(r) for r in tables.read_alerts(spark, path).collect()}
    assert got == {("a", 1, "b", 2, 5, "s", 9), ("a", 1, "b", 2, 0, "", 9)}
    assert {tuple(r) for r in tables.parse_alert_lines(spark.read.text(path)).collect()} == got
    lines = write(tmp_path / "f.jsonl", '{"type":"WRITE","point_id":1,"value":7,"seq":3}\n\n[1]\n"x"\n{oops\n'
                                        '{"type":"READ","point_id":"q","seq":4}\n')
    rows = tables.read_json_frames(spark, lines).orderBy("seq").collect()
    assert [(r.type, r.point_id, r.value, r.seq) for r in rows] == [("WRITE", 1, "7", 3), ("READ", None, None, 4)]
    bad = tables.parse_control_frames(spark.read.text(lines), "value")[1]
    assert {r[0] for r in bad.collect()} == {"[1]", '"x"', "{oops"}


def test_small_readers(spark, tmp_path):
    path = write(tmp_path / "h.txt", "0564\n\n  ff00 \n")
    assert [bytes(r[0]) for r in tables.read_hex_payloads(spark, path).collect()] == [b"\x05\x64", b"\xff\x00"]
    path = write(tmp_path / "features.txt", "# head\nSrc Port\n\n Idle Min \n#x\n")
    assert tables.read_feature_list(spark, path) == ["Src Port", "Idle Min"]
    path = write(tmp_path / "m.csv", "src_port,x\n 5 ,nan\nabc,1e3\n7d,-inf\n")
    got = [(r["Src Port"], r["x"], r["gone"]) for r in
           tables.read_matrix_lenient(spark, path, ["Src Port", "x", "gone"]).collect()]
    assert got == [(5.0, 0.0, 0.0), (0.0, 1000.0, 0.0), (0.0, 0.0, 0.0)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', True), (2, "plain", False)], "id LONG, t STRING, is_train BOOLEAN")
    sinks.write_labelled_csv(df.drop("is_train"), str(tmp_path / "o"))
    back = spark.read.csv(str(tmp_path / "o"), header=True, quote='"', escape='"')
    assert {tuple(r) for r in back.collect()} == {("1", 'a,"b"'), ("2", "plain")}
    sinks.write_split(df, str(tmp_path / "s"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "s" / "split=train")).collect()] == [1]


def test_model_saves_and_loads(spark, tmp_path):
    rows = [(float(i), float(i % 7), "NORMAL" if i < 50 else "REPLAY") for i in range(100)]
    df = spark.createDataFrame(rows, "`Idle Min` DOUBLE, `Flow Byts/s` DOUBLE, Label STRING")
    model = models.fit_model(df, ["Idle Min", "Flow Byts/s"], kind="tree", depth=3)
    model.save(str(tmp_path / "m"))
    again = models.FlowModel.load(str(tmp_path / "m"))
    assert again.features == model.features and again.codes == {"NORMAL": 0, "REPLAY": 1}
    out = again.predict(df).select("Label", "predicted_label", "conf").collect()
    assert all(r[0] == r[1] and r[2] == 1.0 for r in out)
    text = df.select(F.col("Idle Min").cast("string").alias("Idle Min"))
    assert again.predict(text).columns == ["Idle Min", "predicted_label", "conf"]
    parts = {(r.part, r.name) for r in model.bundle().collect()}
    assert parts == {("feature", "Idle Min"), ("feature", "Flow Byts/s"), ("label", "NORMAL"), ("label", "REPLAY")}
    (tmp_path / "junk").mkdir()
    with pytest.raises(ValueError):
        models.FlowModel.load(str(tmp_path / "junk"))


def test_strict_feature_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a INT, Label STRING")
    with pytest.raises(ValueError):
        clean.require_features(df, ["a", "b"])
    with pytest.raises(ValueError):
        clean.align_columns(df.select("a"), df.select("Label"))
    with pytest.raises(ValueError):
        clean.pick_classes(df, "nope")
    out, missing = clean.zero_fill_missing(df, ["a", "b"])
    assert missing == ["b"] and out.first()["b"] == 0.0


def test_column_without_values_stays_null(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, float("nan")), (None, None)], "a DOUBLE, b DOUBLE")
    out = clean.impute_own_median(df, ["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, None), (2.0, None), (3.0, None)]
