"""Centroid clustering of whole-number vectors: rounds of assignment and means that scan few vectors.

Each vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other. When
centroids move, the lower bound is loosened by the most that one move can bring a centroid nearer to any point
of the vector's cluster sphere. Planar geometry bounds that below the length of the move (``loosening``). Vectors
whose bounds part stay where they are; all others are scanned over all centroids in whole numbers, so that the
outcome is exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Components are held between plus and minus this, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Centroids and their number of components are sent to every task.
MOST_CENTROIDS = 4096
#: Vectors scanned by one round of array operations.
ROWS = 8192
#: Bounds are moved apart by these shares, far above what doubles lose.
SLACK, ANGLE_SLACK = 1e-12, 1e-6

STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower double, scanned boolean"
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("before", pa.int32()),
                    ("upper", pa.float64()), ("lower", pa.float64()), ("scanned", pa.bool_())])


def whole_numbers(vectors: DataFrame, size: int = 64, scale: float = 256.0) -> DataFrame:
    """``vec_id``, ``v``: floor(``scale`` * x) of each component x, for the vectors of exactly ``size`` components, none
    null or non-finite; other vectors are left out. Numbers beyond ``LIMIT`` become ``LIMIT``."""
    e = vectors["embedding"]
    fit = (F.size(e) == size) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(LIMIT))
    return vectors.filter(fit).select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        F.transform(e, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale))).cast("int")).alias("v"))


def hashed_seeds(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``prefix`` and id; ties by components, null ids last."""
    h = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


# --- in tasks -------------------------------------------------------------------------------------

def squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact: as doubles where all sums stay below 2^53."""
    most = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0))
    if int(most) ** 2 * 4 * v.shape[1] < 1 << 53:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def own_squares(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v - centroids[cluster]) ** 2).sum(1)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number at a tie), upper and lower bound of each row."""
    at, upper, lower = [], [], []
    for s in range(0, len(v), ROWS):
        d = squares(v[s:s + ROWS], centroids)
        a = d.argmin(1)
        rows = np.arange(len(d))
        upper.append(np.sqrt(d[rows, a].astype(np.float64)))
        d[rows, a] = np.iinfo(np.int64).max
        lower.append(np.sqrt(d.min(1).astype(np.float64)))
        at.append(a)
    return np.concatenate(at), np.concatenate(upper) * (1 + SLACK), np.concatenate(lower) * (1 - SLACK)


@dataclass
class Move:
    """From ``old`` to ``new`` centroids: each one's way, what lower bounds lose by cluster, and half the way from a
    new centroid to the next one, within which no other can be nearer."""

    new: np.ndarray
    way: np.ndarray
    loss: np.ndarray
    half: np.ndarray


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most by which any other centroid's move brings it nearer to a point of the cluster's
    sphere (centre: its old centroid).

    For a move from p to q of length w and a point x at distance s from their midpoint, seen from there under the
    angle t against the move, |x-p| - |x-q| = 2 w s cos t / (|x-p| + |x-q|), and the sum below is between 2 s and
    2 s + w. In the plane of the move and the sphere's centre the sphere is a disc, seen from the midpoint under the
    angle phi give or take arcsin(radius / R). So the move gains at most w cos t with the least t of the disc; where
    even that is obtuse, the centroid goes away from the whole sphere and the bound rises."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    loss = np.full(len(old), -np.inf)
    for j in range(len(old)):
        step = new[j] - old[j]
        w = float(np.sqrt((step ** 2).sum()))
        if w == 0:
            gain = np.zeros(len(old))
        else:
            out = old - (old[j] + new[j]) / 2
            far = np.sqrt((out ** 2).sum(1))
            outside = far > radius
            safe = np.where(outside, far, 1.0)
            phi = np.arccos(np.clip(out @ step / (safe * w), -1, 1))
            t = np.maximum(0, phi - np.arcsin(np.clip(radius / safe, 0, 1)))
            gap = 2 * np.maximum(0, far - radius)
            gain = w * np.cos(t)
            gain = np.where(gain < 0, gain * gap / (gap + w), gain)
            gain = np.where(outside, np.minimum(w, gain + ANGLE_SLACK * w), w)
        gain[j] = -np.inf
        loss = np.maximum(loss, gain)
    return loss


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    between = squares(new, new).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    return Move(new, way, loosening(old, new, radius), np.sqrt(between.min(1)) / 2 * (1 - SLACK))


def numbers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel().astype(np.int32)))


def first_assignment(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, upper, lower = scan(numbers(b.column("v")), centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(a.astype(np.int32)), pa.array(np.full(len(a), -1, np.int32)), pa.array(upper),
                                                  pa.array(lower), pa.array(np.ones(len(a), bool))], schema=_STATE)

    return rows.mapInArrow(run, STATE)


def next_assignment(state: DataFrame, move: Move) -> DataFrame:
    """The state after the move: bounds first, then the exact distance to the own centroid, then a scan of what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            before = b.column("cluster").to_numpy()
            a = before.copy()
            upper = (b.column("upper").to_numpy() + move.way[a]) * (1 + SLACK)
            lower, loss = b.column("lower").to_numpy(), move.loss[a]
            # with one centroid there is no other: the lower bound is infinite and stays so
            lower = np.where(np.isfinite(lower), lower - loss - SLACK * (np.abs(lower) + np.abs(np.where(np.isfinite(loss), loss, 0))), lower)
            open_ = np.flatnonzero(upper >= np.maximum(lower, move.half[a]))
            scanned = np.zeros(len(a), bool)
            if len(open_):
                v = numbers(b.column("v").take(pa.array(open_)))
                upper[open_] = np.sqrt(own_squares(v, move.new, a[open_]).astype(np.float64)) * (1 + SLACK)
                still = upper[open_] >= np.maximum(lower[open_], move.half[a[open_]])
                rows = open_[still]
                if len(rows):
                    a[rows], upper[rows], lower[rows] = scan(v[still], move.new)
                    scanned[rows] = True
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(a), pa.array(before), pa.array(upper), pa.array(lower), pa.array(scanned)], schema=_STATE)

    return state.mapInArrow(run, STATE)


def with_distance(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = own_squares(numbers(b.column("v")), centroids, b.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d), b.column("scanned")], ["vec_id", "cluster", "distance", "scanned"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, scanned boolean")


# --- rounds ---------------------------------------------------------------------------------------

@dataclass
class Clusters:
    """``members``: ``vec_id``, ``cluster``, squared ``distance``, ``scanned`` (whether the last assignment looked at all
    centroids). ``scans``: vectors scanned in each assignment; ``inertia``: distances added up by cluster."""

    members: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]
    scans: list[int]


def _changes(state: DataFrame, k: int, size: int) -> list:
    """What vectors that changed cluster add to the sums of clusters and take from them: ``c``, component ``i`` (-1: their
    number), ``s``. Tasks add up first, so at most one row a task and sum is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.append(numbers(b.column("v")), np.ones((b.num_rows, 1), np.int64), axis=1)
                old = b.column("before").to_numpy()
                np.add.at(total, b.column("cluster").to_numpy(), v)
                np.subtract.at(total, old[old >= 0], v[old >= 0])
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(np.where(i == size, -1, i).astype(np.int32)), pa.array(total[c, i])], ["c", "i", "s"])

    parts = state.filter("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "c int, i int, s long")
    return parts.groupBy("c", "i").agg(F.sum("s").alias("s")).collect()


def lloyd(rows: DataFrame, seeds: np.ndarray, rounds: int) -> Clusters:
    """``rounds`` rounds of assigning the ``rows`` (``vec_id``, ``v``) to the nearest centroid and replacing each non-empty
    centroid by the floor of its vectors' mean; then a last assignment.

    Ties go to the smaller number, empty centroids stay, repeated vectors count each. Each round's state is a
    written table; sums follow from the vectors that changed cluster. Only centroids and rows of one a cluster
    come to the driver. Without seeds there are no members."""
    if len(seeds) > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids")
    if not len(seeds):
        return Clusters(rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, scanned boolean"), seeds, {}, [])
    k, size = seeds.shape
    now, sums, counts = seeds, [[0] * size for _ in range(k)], [0] * k
    state, scans = first_assignment(rows, now), []
    for _ in range(rounds):
        state = written(state, "cluster-state")
        for c, i, s in _changes(state, k, size):
            if i < 0:
                counts[c] += s
            else:
                sums[c][i] += s
        means = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, now.tolist())], np.int64)
        spheres = state.groupBy("cluster").agg(F.max("upper").alias("r"), F.sum(F.col("scanned").cast("long")).alias("scans")).collect()
        scans.append(sum(r["scans"] for r in spheres))
        radius = np.zeros(k)
        radius[[r["cluster"] for r in spheres]] = [r["r"] for r in spheres]
        state, now = next_assignment(state, moved(now, means, radius)), means
    members = written(with_distance(state, now), "cluster-members")
    totals = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.sum(F.col("scanned").cast("long")).alias("scans")).collect()
    scans.append(sum(r["scans"] for r in totals))
    return Clusters(members, now, {r["cluster"]: int(r["d"]) for r in totals}, scans)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, seed_prefix: str = "2:") -> DataFrame:
    """One row per vector that ``whole_numbers`` keeps: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` (null beyond 64 bits), ``centroid_sha256`` (of the final centroid's components,
    joined by commas) and ``scanned``. Repeated ids are rows of their own; an empty table gives no rows."""
    rows = whole_numbers(vectors, size, scale)
    got = lloyd(rows, hashed_seeds(rows, k, seed_prefix), rounds)
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(got.inertia.values()))
    about = [(c, fits(d), whole, hashlib.sha256(",".join(map(str, got.centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(got.inertia.items())]
    about = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.members.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
