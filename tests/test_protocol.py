import random

import pytest
from pyspark.sql import functions as F

import wire
from fieldwire.constants import ATTACK_CLASSES
from fieldwire.functions import dnp3, net


def decoded(spark, payloads):
    rows = [(i, bytearray(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "i INT, payload BINARY")
    got = {r["i"]: [tuple(f) for f in r["fs"]] for r in df.select(
        "i", dnp3.parse_frames(F.col("payload")).alias("fs")).collect()}
    return [got[i] for i in range(len(payloads))]


def test_random_payloads_match_the_plain_parser(spark):
    rng = random.Random(7)
    payloads = []
    for _ in range(1500):
        buf = b""
        for _ in range(rng.randrange(5)):
            user = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 15, 16, 17, 40])))
            f = wire.frame(rng.choice([0xC4, 0xC9, 0x44]), rng.randrange(65536), rng.randrange(65536), user)
            if rng.random() < 0.1:
                f = f[:2] + bytes([rng.randrange(256)]) + f[3:]
            buf += bytes(rng.choice([0, 5, 0x64, 200]) for _ in range(rng.randrange(4))) + f
        payloads.append(buf[:len(buf) - rng.choice([0, 0, 0, 1, 7])])
    assert decoded(spark, payloads) == [wire.parse(p) for p in payloads]


@pytest.mark.parametrize("payload", [
    b"", b"\x05", b"\x05\x64", b"\x05\x64" * 6, b"\x05\x05\x64" + b"\0" * 8,
    wire.frame(0xC9, 1, 2), wire.frame(0xC9, 1, 2)[:-1], wire.frame(0xC9, 1, 2) * 2,
    b"\x05\x64\x02" + b"\0" * 7, wire.frame(1, 0xFFFF, 0x8081, b"\xc0\xc0\x14"),
])
def test_edges(spark, payload):
    assert decoded(spark, [payload]) == [wire.parse(payload)]


def test_null_payload_gives_no_frames(spark):
    df = spark.createDataFrame([(None,)], "payload BINARY")
    assert df.select(F.explode(dnp3.parse_frames(F.col("payload")))).count() == 0


def test_names_and_classes(spark):
    df = spark.createDataFrame([(None,), (0x14,), (0x10,), (0x82,), (0x7F,), (0x12,)], "fc INT")
    rows = df.select("fc", dnp3.fc_name(F.col("fc")).alias("n"), dnp3.attack_class(F.col("fc")).alias("a"),
                     dnp3.is_attack(F.col("fc")).alias("x")).collect()
    got = {r["fc"]: (r["n"], r["a"], r["x"]) for r in rows}
    assert got == {
        None: ("LINK_ONLY", None, False), 0x14: ("INIT_APPLICATION", "INIT_APPLICATION", True),
        0x10: ("INIT_APPLICATION", None, False), 0x82: ("UNSOLICITED_RESPONSE", None, False),
        0x7F: ("FC_0x7F", None, False), 0x12: ("STOP_APP", "STOP_APP", True),
    }
    assert 0x10 not in ATTACK_CLASSES


def test_crc(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(200):
        user = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 15, 16, 17, 32, 33, 250])))
        f = bytearray(b"\xff" * rng.randrange(3) + wire.frame(0xC4, i, 2, user))
        at = f.index(b"\x05\x64")
        bad = rng.random() < 0.4
        if bad:
            f[rng.randrange(at + 3, len(f))] ^= 1 << rng.randrange(8)
        rows.append((i, f, at, len(user)))
        want.append(not bad)
    df = spark.createDataFrame(rows, "i INT, p BINARY, pos INT, n INT")
    got = {r["i"]: r["ok"] for r in df.select("i", dnp3.frame_crc_ok("p", "pos", "n").alias("ok")).collect()}
    assert [got[i] for i in range(200)] == want


def test_poll_class(spark):
    cases = [(b"\xc0\xc0\x01\x3c\x01\x06", "CLASS_0"), (b"\xc0\xc0\x01\x3c\x04\x06", "CLASS_3"),
             (b"\xc0\xc0\x01\x00\xf0\x00", "DEVICE_ATTRIBUTES"), (b"\xc0\xc0\x02\x3c\x01\x06", None),
             (b"\xc0\xc0\x01", None), (b"\xc0\xc0\x01\x1e\x01\x06", None)]
    df = spark.createDataFrame([(i, bytearray(b"x" + wire.frame(0xC4, 1, 2, u))) for i, (u, _) in
                                enumerate(cases)], "i INT, payload BINARY")
    f = df.select("i", "payload", F.explode(dnp3.parse_frames(F.col("payload"))).alias("f"))
    got = {r["i"]: r["c"] for r in f.select("i", dnp3.poll_class(
        F.col("payload"), F.col("f.pos"), F.col("f.fc"), F.col("f.user_data_len")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, c in cases]


def test_starts_frame(spark):
    df = spark.createDataFrame([(bytearray(b"\x05\x64\x00"),), (bytearray(b"\x00\x05\x64"),), (bytearray(b""),)],
                               "p BINARY")
    assert [r[0] for r in df.select(dnp3.starts_frame(F.col("p"))).collect()] == [True, False, False]


def test_routable_agrees_with_the_address_rules(spark):
    import ipaddress

    texts = ["10.0.0.1", "127.0.0.1", "127.9.9.9", "256.1.1.1", "1.2.3", "01.2.3.4", "::1", "::", "fe80::1",
             "2001:db8::8:800:200c:417a", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "0:0:0:0:0:0:0:1",
             ":::", "12345::", "g::1", "", "host", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1", "1:"]

    def plain(t):
        try:
            return not ipaddress.ip_address(t).is_loopback
        except ValueError:
            return False

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i INT, ip STRING")
    got = {r["i"]: r["r"] for r in df.select("i", net.routable(F.col("ip")).alias("r")).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == {t: plain(t) for t in texts}
    assert got[99] is False


def test_port_rule(spark):
    df = spark.createDataFrame([("20000", "1"), ("1", "20000"), ("x", "20000"), ("1", "2"), (None, "20000")],
                               "s STRING, d STRING")
    rule = net.touches_port(F.col("s"), F.col("d"), 20000)
    assert [r[0] for r in df.select(rule).collect()] == [True, True, False, False, False]
    assert df.where(net.touches_port(F.col("s"), F.col("d"), 0)).count() == 5
