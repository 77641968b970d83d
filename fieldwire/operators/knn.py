"""Exact k nearest neighbours without a cross join.

Points are assigned to pivots. The triangle inequality bounds which pivot cells can
hold one of a row's k nearest, so a row visits only those cells. Cells are split into
blocks of bounded size by the training row's hash; a block answers its visitors with
their k best inside it, and the answers are merged. Nothing is sampled or dropped: the
pivots only decide how much work is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage


def _pivots(train: DataFrame, vec: str, row_id: str, n: int) -> np.ndarray:
    """n training vectors by hash order; a bounded set."""
    rows = train.orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(n).select(vec).collect()
    return np.unique(np.array([r[0] for r in rows], dtype=np.float64), axis=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, computed by difference so that equal points are at 0."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        out[:, j] = np.sqrt(((a - b[j]) ** 2).sum(axis=1))
    return out


def _nearest(tests: np.ndarray, have: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test row, row of ``have`` and distance of the k nearest, of equal ones the first of ``have``.

    A matrix product names the rows that can be among them, its rounding counted in; only their distances are
    computed by difference."""
    size = (tests ** 2).sum(axis=1)[:, None], (have ** 2).sum(axis=1)[None, :]
    near = size[0] + size[1] - 2 * (tests @ have.T)
    slack = 4e-15 * (tests.shape[1] + 8) * (size[0] + size[1].max())
    if np.isfinite(near).all() and np.isfinite(slack).all():
        kth = min(k, len(have)) - 1
        who, pick = np.nonzero(near <= np.partition(near, kth, axis=1)[:, [kth]] + slack)
    else:
        who, pick = (x.ravel() for x in np.indices(near.shape))
    dist = np.empty(len(who))
    for at in range(0, len(who), 65_536):
        s = slice(at, at + 65_536)
        dist[s] = np.sqrt(((tests[who[s]] - have[pick[s]]) ** 2).sum(axis=1))
    order = np.lexsort((pick, dist, who))
    first = np.searchsorted(who, np.arange(len(tests)))
    order = order[np.arange(len(order)) - first[who[order]] < k]
    return who[order], pick[order], dist[order]


class Cells:
    """A block of vectors in cells around some of them, so that a row visits only cells that can hold one of its k
    nearest. Answers are those of :func:`_nearest`."""

    def __init__(self, have: np.ndarray, k: int):
        self.have, self.k = have, k
        self.centres = np.unique(have[::max(1, math.isqrt(len(have)))], axis=0)
        d = _distances(have, self.centres)
        of, far = d.argmin(axis=1), d.min(axis=1)
        self.members = [np.flatnonzero(of == j) for j in range(len(self.centres))]
        self.radius = np.array([far[m].max() if len(m) else -np.inf for m in self.members])
        self.full = np.array([len(m) >= k for m in self.members])

    def nearest(self, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _distances(tests, self.centres)
        if not self.full.any() or not np.isfinite(d).all() or not np.isfinite(self.have).all():
            return _in_parts(tests, self.have, self.k)
        bound = (d + self.radius)[:, self.full].min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12
        visit, own = d - self.radius <= bound, d.argmin(axis=1)
        found = []
        for j in np.unique(own):
            rows = np.flatnonzero(own == j)
            near = np.sort(np.concatenate([self.members[c] for c in np.flatnonzero(visit[rows].any(axis=0))]))
            who, pick, dist = _in_parts(tests[rows], self.have[near], self.k)
            found.append((rows[who], near[pick], dist))
        who, pick, dist = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(who, kind="stable")
        return who[order], pick[order], dist[order]


def _in_parts(tests: np.ndarray, have: np.ndarray, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_nearest`, for so many rows at once."""
    found = [(at + who, pick, dist) for at in range(0, len(tests), rows) for who, pick, dist in [_nearest(tests[at:at + rows], have, k)]]
    return tuple(np.concatenate(x) for x in zip(*found))


#: Rows that meet a block of few vectors at once.
MET_ROWS = 4_096


def _few(train: DataFrame, vec: str, *columns: str) -> tuple[list[list], np.ndarray]:
    """``columns`` and vectors of a block of training rows, ordered by the first column and the vector."""
    rows = sorted(map(tuple, train.select(columns[0], vec, *columns[1:]).collect()), key=lambda r: r[:2])
    return [[r[i] for r in rows] for i in (0, *range(2, len(columns) + 1))], np.array([r[1] for r in rows], dtype=np.float64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _nearest_of_few(train: DataFrame, test: DataFrame, k: int, vec: str, row_id: str) -> DataFrame:
    """:func:`knn` where the training rows are no more than a block: each task has them and answers its own rows."""
    (ids,), have = _few(train, vec, row_id)
    kind = train.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {test.schema[row_id].dataType.simpleString()}, neighbour {kind}, distance double, rank int"
    if not ids:
        return train.sparkSession.createDataFrame([], schema)
    ids = np.array(ids)

    def answer(batches):
        cells = Cells(have, k)
        for b in batches:
            for at in range(0, b.num_rows, MET_ROWS):
                part = b.slice(at, MET_ROWS)
                who, pick, dist = cells.nearest(_vectors(part.column(1), have.shape[1]))
                rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who)), pa.array(ids[pick]), pa.array(dist), pa.array(rank, pa.int32())],
                    [row_id, "neighbour", "distance", "rank"])

    return test.select(row_id, F.col(vec).cast("array<double>")).mapInArrow(answer, schema)


def knn(
    train: DataFrame, test: DataFrame, k: int = 5, vec: str = "embedding", row_id: str = "vec_id",
    pivots: int = 32, block_rows: int = 4096,
) -> DataFrame:
    """(test id, neighbour id, distance, rank) of the k nearest training rows.

    Ties in distance go to the smaller training id.
    """
    train = cut_lineage(train.select(row_id, F.col(vec).cast("array<double>").alias(vec)))
    if train.count() <= block_rows:
        return _nearest_of_few(train, test, k, vec, row_id)
    centres = _pivots(train, vec, row_id, pivots)
    k_near = T.StructType.fromDDL("pivot INT, dist DOUBLE")

    @F.pandas_udf(k_near)
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(v.to_numpy()).astype(np.float64), centres)
        best = d.argmin(axis=1)
        return pd.DataFrame({"pivot": best.astype("int32"), "dist": d[np.arange(len(d)), best]})

    base = cut_lineage(
        train.select(F.col(row_id).alias("nid"), F.col(vec).cast("array<double>").alias("nv"))
        .withColumn("p", nearest_pivot("nv")).select("nid", "nv", "p.pivot", "p.dist")
    )
    closest = Window.partitionBy("pivot").orderBy("dist", "nid")
    near = {
        r["pivot"]: sorted(r["ds"]) for r in base.withColumn(
            "r", F.row_number().over(closest)).where(F.col("r") <= k)
        .groupBy("pivot").agg(F.collect_list("dist").alias("ds")).collect()
    }
    stats = {r["pivot"]: (r["lo"], r["hi"], r["n"]) for r in base.groupBy("pivot").agg(
        F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")
    ).collect()}
    used = sorted(stats)
    low = np.array([stats[p][0] for p in used])
    high = np.array([stats[p][1] for p in used])
    blocks = [-(-stats[p][2] // block_rows) for p in used]
    held = [np.array(near[p]) for p in used]
    used_centres = centres[used]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_to_visit(v: pd.Series) -> pd.Series:
        d = _distances(np.stack(v.to_numpy()).astype(np.float64), used_centres)
        reach = np.concatenate([d[:, [j]] + held[j] for j in range(len(used))], axis=1)
        kth = min(k, reach.shape[1]) - 1
        bound = np.partition(reach, kth, axis=1)[:, [kth]] * (1 + 1e-9) + 1e-12
        visit = (d - high <= bound) & (low - d <= bound)
        return pd.Series([[int(used[j]) for j in np.flatnonzero(row)] for row in visit])

    n_blocks = F.create_map(*[F.lit(int(x)) for p, b in zip(used, blocks) for x in (p, b)])
    blocked = base.select(
        "pivot", F.pmod(F.xxhash64("nid"), n_blocks[F.col("pivot")]).cast("int").alias("blk"),
        "nid", "nv",
    )
    visitors = cut_lineage(
        test.select(F.col(row_id).alias("tid"), F.col(vec).cast("array<double>").alias("tv"))
        .withColumn("pivot", F.explode(cells_to_visit("tv")))
        .withColumn("blk", F.explode(F.sequence(F.lit(0), n_blocks[F.col("pivot")] - 1)))
    )

    def answer(tests, rows: pd.DataFrame):
        if not len(rows):
            return
        rows = rows.sort_values("nid")
        have = np.stack(rows["nv"].to_numpy())
        ids = rows["nid"].to_numpy()
        for batch in tests:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                who, pick, dist = _nearest(np.stack(part["tv"].to_numpy()), have, k)
                yield pd.DataFrame({"tid": part["tid"].to_numpy()[who], "nid": ids[pick], "dist": dist})

    def block(tests: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = list(answer([tests], rows)) if len(tests) else []
        return pd.concat(parts) if parts else pd.DataFrame(
            {"tid": pd.Series(dtype="int64"), "nid": pd.Series(dtype="int64"),
             "dist": pd.Series(dtype="float64")}
        )

    # visitors of one block are split further, so that both sides of a group are bounded
    per_block = visitors.groupBy("pivot", "blk").agg(F.count(F.lit(1)).alias("v"))
    tiles = per_block.withColumn("tiles", F.ceil(F.col("v") / block_rows).cast("int")).drop("v")
    v = visitors.join(tiles, ["pivot", "blk"]).withColumn(
        "tile", F.pmod(F.xxhash64("tid"), F.col("tiles")).cast("int")
    ).drop("tiles")
    b = blocked.join(tiles, ["pivot", "blk"]).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    ).drop("tiles")
    group = ["pivot", "blk", "tile"]
    found = v.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(
        block, "tid LONG, nid LONG, dist DOUBLE"
    )
    best = Window.partitionBy("tid").orderBy("dist", "nid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("tid").alias(row_id), F.col("nid").alias("neighbour"), F.col("dist").alias("distance"),
        "rank",
    )


def knn_classify(
    train: DataFrame, test: DataFrame, k: int = 5, label: str = "label", vec: str = "embedding",
    row_id: str = "vec_id", **options,
) -> DataFrame:
    """Majority vote of the k nearest; of equal votes the smallest label."""
    near = knn(train, test, k, vec, row_id, **options)
    voters = train.select(F.col(row_id).alias("neighbour"), F.col(label).alias("vote"))
    votes = near.join(voters, "neighbour").groupBy(row_id, "vote").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(row_id).agg(
        F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("prediction")
    )


def knn_predict(
    train: DataFrame, test: DataFrame, k: int = 5, label: str = "label", vec: str = "embedding",
    row_id: str = "vec_id", block_rows: int = 4096, **options,
) -> DataFrame:
    """Rows of ``test`` with the ``prediction`` of :func:`knn_classify`. Where the training rows are no more than a
    block each task has them: a row's vote is taken where it is, and nothing is shuffled."""
    if train.limit(block_rows + 1).count() > block_rows or train.isEmpty():
        return test.join(knn_classify(train, test, k, label, vec, row_id, block_rows=block_rows, **options), row_id)
    (_, votes), have = _few(train.withColumn(vec, F.col(vec).cast("array<double>")), vec, row_id, label)
    names = sorted({v for v in votes if v is not None})
    # of equal votes the smallest label wins, null before all others
    code = np.array([0 if v is None else 1 + names.index(v) for v in votes])

    @F.arrow_udf(train.schema[label].dataType)
    def voted(v: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cells, labels = Cells(have, k), pa.array([None, *names])
        for column in v:
            won = [np.zeros(0, int)]
            for at in range(0, len(column), MET_ROWS):
                tests = _vectors(column.slice(at, MET_ROWS), have.shape[1])
                who, pick, _ = cells.nearest(tests)
                n = np.bincount(who * (len(names) + 1) + code[pick], minlength=len(tests) * (len(names) + 1))
                won.append(n.reshape(len(tests), -1).argmax(axis=1))
            yield labels.take(pa.array(np.concatenate(won)))

    return test.withColumn("prediction", voted(F.col(vec).cast("array<double>")))
