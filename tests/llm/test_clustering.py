import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwire.llm import clustering as c

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, size, scale=256, prefix="2:"):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{prefix}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        groups = {}
        for (_, v), j in zip(kept, at):
            groups.setdefault(j, []).append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if (g := groups.get(j)) else m for j, m in enumerate(centroids)]
    out = []
    for i, v in kept:
        d, j = near(v)
        out.append((i, j, d, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    inertia = {}
    for _, j, d, _ in out:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i is None, i or 0, j, d, inertia[j], sum(inertia.values()), h) for i, j, d, h in out))


def got(spark, rows, k, rounds, size):
    df = c.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, size)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,scale", [(1, 0.1), (2, 3.0), (3, 0.004)])
def test_like_rounds_over_all_pairs(spark, seed, scale):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, scale) for _ in range(5)] for _ in range(9)]
    rows = [(i, [m + rng.gauss(0, scale / 3) for m in rng.choice(middles)]) for i in range(300)]
    assert got(spark, rows, 12, 5, 5) == brute(rows, 12, 5, 5)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [0.5, -0.25]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]),
            (8, [-0.001, 0.001]), (None, [0.25, 0.25]), (9, [0.0, 0.0]), (10, [1.0, 2.0, 3.0])] + [(20 + i, [1.0, 1.0]) for i in range(40)]
    for k in (1, 2, 4, 100):
        assert got(spark, rows, k, 3, 2) == brute(rows, k, 3, 2)


def test_empty_and_clashing_columns(spark):
    assert got(spark, [], 4, 2, 2) == []
    rows = [(i, [i / 7, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(x) for x in ("v", "cluster", "before", "upper", "lower", "scanned", "distance")])
    assert c.clustered(df, 3, 2, 2).count() == 20


def test_numbers_beyond_the_limit_are_held_at_it(spark):
    rows = [(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [3e38, -3e38])]
    out = {r.vec_id: r for r in c.clustered(spark.createDataFrame(rows, SCHEMA), 2, 1, 2).collect()}
    assert all(r.distance < 1 << 63 for r in out.values()) and out[1].cluster == out[3].cluster


def test_the_loss_bounds_every_point_of_a_sphere_and_is_below_the_full_drift():
    rng = np.random.default_rng(4)
    less = 0
    for _ in range(200):
        old = rng.normal(0, 50, (4, 3))
        new = old + rng.normal(0, 20, (4, 3))
        radius = rng.uniform(0, 60, 4)
        loss = c.loosening(old, new, radius)
        for a in range(4):
            x = rng.normal(size=(400, 3))
            x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * rng.uniform(0, 1, (400, 1)) ** (1 / 3)
            gain = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in range(4) if j != a)
            drift = max(np.linalg.norm(new[j] - old[j]) for j in range(4) if j != a)
            assert gain <= loss[a] <= drift * (1 + 1e-6)
            less += loss[a] < 0.9 * drift
    assert less > 200


def test_few_vectors_are_scanned_once_clusters_settle(spark):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 6]]) for i in range(600)]
    whole = c.whole_numbers(spark.createDataFrame(rows, SCHEMA), 8)
    scans = c.lloyd(whole, c.hashed_seeds(whole, 6, "2:"), 5).scans
    assert scans[0] == 600 and scans[-1] < 60
