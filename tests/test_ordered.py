"""Carried cells, cooldowns and quantiles against brute force, with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from fieldwire.operators import ordered as o


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randrange(-5000, 40000), rng.choice([None, 1, 2, 3])))
    return rows, spark.createDataFrame(rows, "id LONG, k STRING, ts LONG, v INT").cache()


def per_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running(events):
    rows, df = events
    got = {r["id"]: (r["p"], r["s"]) for r in o.running(
        df, ["k"], ["ts", "id"], o.cell("ts", 500), last={"p": F.col("v")},
        sums={"s": F.coalesce("v", F.lit(0))}).collect()}
    want = {}
    for rs in per_key(rows).values():
        last, total = None, 0
        for r in rs:
            total += r[3] or 0
            want[r[0]] = (last, total)
            last = r[3] if r[3] is not None else last
    assert got == want


def test_global_row_numbers(events):
    rows, df = events
    got = {r["id"]: r["rn"] for r in o.row_numbers(df, ["ts", "id"], o.cell("ts", 700)).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}


@pytest.mark.parametrize("keep", [0, 1, 1234, 3000])
def test_cut_at_rank(events, keep):
    rows, df = events
    got = {r["id"] for r in o.cut_at_rank(df, ["ts", "id"], o.cell("ts", 700), F.lit(keep))
           .where("kept").collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[:keep]}


def fire(rows, c):
    out = set()
    for rs in per_key(rows).values():
        last = None
        for r in rs:
            if last is None or r[2] - last >= c:
                out.add(r[0])
                last = r[2]
    return out


@pytest.fixture(params=[10_000, 7])
def batches(spark, request):
    """Cells that lie in one Arrow batch, and cells that span several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("c,width", [(40, 500), (700, 500), (3, 1), (3, 100_000)])
def test_cooldown(events, batches, c, width):
    rows, df = events
    got = [r["id"] for r in o.cooldown(df, ["k"], "ts", ["id"], c, width).collect()]
    assert len(got) == len(set(got)) and set(got) == fire(rows, c)


def test_cooldown_runs_nothing_before_it_is_asked_for_rows(spark):
    df = spark.createDataFrame([(1, "a", 0)], "id LONG, k STRING, ts LONG").withColumn("ts", F.raise_error(F.lit("read")).cast("long"))
    o.cooldown(df, ["k"], "ts", ["id"], 5, 100)


def test_cooldown_of_keys_without_rows_null_keys_and_null_times(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 3), (3, None, 9), (4, "a", None), (5, "a", -7), (6, "a", -3), (7, "a", -2)], "id LONG, k STRING, ts LONG")
    assert sorted(r["id"] for r in o.cooldown(df, ["k"], "ts", ["id"], 5, 10).collect()) == [1, 3, 5, 7]
    assert o.cooldown(df.limit(0), ["k"], "ts", ["id"], 5, 10).count() == 0


def test_cooldown_boundary(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", 9), (4, "a", 10)], "id LONG, k STRING, ts LONG")
    assert sorted(r["id"] for r in o.cooldown(df, ["k"], "ts", ["id"], 5, 100).collect()) == [1, 2, 4]
    assert o.cooldown(df, ["k"], "ts", ["id"], 0, 100).count() == 4


def test_sliding_count(events):
    rows, df = events
    got = {r["id"]: r["n"] for r in o.sliding_count(df, ["k"], "ts", ["id"], 60, "n").collect()}
    want = {}
    for rs in per_key(rows).values():
        for i, r in enumerate(rs):
            want[r[0]] = sum(1 for q in rs[:i + 1] if q[2] >= r[2] - 60)
    assert got == want


def test_windows_opened(events, batches):
    rows, df = events
    got = {r["id"]: (r["window_open"], r["window_pos"]) for r in o.windows_opened(
        df, ["k"], "ts", ["id"], 300, 500).where("k IS NOT NULL").collect()}
    want = {}
    for k, rs in per_key(rows).items():
        opened, pos = None, 0
        for r in rs if k else []:
            if opened is None or r[2] - opened >= 300:
                opened, pos = r[2], 0
            pos += 1
            want[r[0]] = (opened, pos)
    assert got == want


@pytest.mark.parametrize("forward", [False, True])
def test_asof(events, forward):
    rows, df = events
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {r["id"]: r["t"] for r in o.asof(
        left, right, ["k"], "ts", "ts", F.col("ts"), "t", 500, forward).collect()}
    want = {}
    for r in rows:
        if r[0] % 2 == 0:
            near = [q[2] for q in rows if q[0] % 2 == 1 and q[1] == r[1]
                    and (q[2] >= r[2] if forward else q[2] <= r[2])]
            want[r[0]] = (min(near) if forward else max(near)) if near else None
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 4001])
def test_exact_quantiles(spark, n):
    import numpy as np

    rng = random.Random(5)
    inf = float("inf")
    rows = [(float(rng.choice([1, 1, 1, 2, rng.random() * 9])), rng.gauss(0, 1),
             None if i % 3 else float("nan"), 7.0, rng.choice([inf, inf, -inf, -0.0, rng.random()])) for i in range(n)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE")
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = o.exact_quantiles(df, ["a", "b", "c", "d", "e"], probs)
    assert got["c"] == [None] * len(probs)
    for j, c in enumerate("ab"):
        assert got[c] == pytest.approx(list(np.quantile([r[j] for r in rows], probs)), abs=1e-12)
    assert got["d"] == [7.0] * len(probs)
    e = sorted(r[4] for r in rows)
    for p, q in zip(probs, got["e"]):
        low, high = e[int(p * (n - 1))], e[min(int(p * (n - 1)) + 1, n - 1)]
        assert q == low if low == high else low <= q <= high


def test_values_of_a_narrow_range_are_spread_over_cells(spark):
    """A day of microseconds, and values that lie in one spot but for a few."""
    day = spark.range(20_000).selectExpr("0 AS pos", "cast(1700000000000000 + id * 4320000 as double) AS v")
    spot = spark.range(20_000).selectExpr("1 AS pos", "CASE WHEN id < 5 THEN pow(10, 3 * id) * IF(id = 4, double('inf'), 1) ELSE 1 + id * 1e-9 END AS v")
    celled = o.even_cells(day.union(spot), "pos", "v")
    assert celled.count() == 40_000
    assert celled.groupBy("pos", "__cell").count().agg(F.max("count")).first()[0] < 2000
    rows = sorted((r["pos"], r["v"], r["__cell"]) for r in celled.collect())
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])
