"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mixed, pieces, texts, tokens, utf8, written


@dataclass(frozen=True)
class Training:
    """``most_rows`` bounds the labelled rows that are fitted: those least by hash, about as many.

    ``shards`` learn side by side and their leaders are averaged after each of ``rounds``; ``alpha``,
    ``beta``, ``l1`` and ``l2`` are the usual parameters of the update."""
    bits: int = 18
    most_rows: int = 24_000
    shards: int = 8
    rounds: int = 2
    epochs: int = 6
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001


def grams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the rows' word n-grams, sorted by row and feature.

    N-grams: words (signs apart from letters), pairs of words, and for each word whether it equals one
    of the two before, a back-reference that does not name the word. Values are counts over the root of
    their squared sum, so a text's length does not matter."""
    h, row, _, _ = tokens(data, at, split_signs=True)
    pair = row[1:] == row[:-1]
    two = mixed(h[1:] * np.uint64(3) + h[:-1])[pair]
    same = (pair & (h[1:] == h[:-1])).astype(np.uint64)
    if len(h) > 2:
        same[1:] |= ((h[2:] == h[:-2]) & (row[2:] == row[:-2])).astype(np.uint64) << np.uint64(1)
    back = mixed(same + np.uint64(0x5EED))[pair]
    feature = np.concatenate([h, two, back]) >> np.uint64(64 - bits)
    key = (np.concatenate([row, row[1:][pair], row[1:][pair]]).astype(np.uint64) << np.uint64(bits)) | feature
    key, count = np.unique(key, return_counts=True)
    row, feature = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=len(at) - 1))
    return row, feature, count / norm[row]


def leader(z: np.ndarray, n: np.ndarray, p: Training) -> np.ndarray:
    """Weights that minimise the regularised sum of all gradients seen; small sums give exact zeros."""
    step = (p.beta + np.sqrt(n)) / p.alpha + p.l2
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / step)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, p: Training, seed: int) -> None:
    """Follow-the-regularised-leader over the rows, changing ``z`` and ``n``; each row touches its own features."""
    order = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            feature, value, y = rows[k]
            w = leader(z[feature], n[feature], p)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            more = n[feature] + g * g
            z[feature] += g - (np.sqrt(more) - np.sqrt(n[feature])) / p.alpha * w
            n[feature] = more


def labelled(docs: DataFrame, labels: DataFrame, column: str, p: Training) -> DataFrame:
    """``shard``, ``text``, ``y`` of the rows to fit.

    A row is fitted when crc32 of its id as text leaves a remainder other than 1 by 3 and its label is
    not null; of several labels of an id the largest counts. The bound on rows is a cut on a hash of
    the id, so no task sorts all ids; the chosen ids are at most about ``most_rows`` and are broadcast."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
           .filter("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 3 <> 1")
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    total = ids.count()
    cut = int(min(1.0, p.most_rows / max(1, total)) * (1 << 30))
    ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    return texts(docs).join(F.broadcast(ids), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(p.shards)).cast("int").alias("shard"), "doc_id", "text", "y")


def _shard_learner(state, seed: int, p: Training):
    """What one shard does in a round: its features once, then the updates from the shared state."""
    size = 1 << p.bits

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        data, at = utf8(pa.concat_arrays(group.column("text").chunks))
        items, y = [], group.column("y").to_numpy()
        for i, j in pieces(at):
            row, feature, value = grams(data[at[i]:at[j]], at[i:j + 1] - at[i], p.bits)
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            for k in range(j - i):
                s = slice(cuts[k], cuts[k + 1])
                items.append((np.append(feature[s], size).astype(np.int32), np.append(value[s], 1.0).astype(np.float32), y[i + k]))
        mz, mn = (x.copy() for x in state.value)
        learn(items, mz, mn, p, seed)
        touched = np.flatnonzero(mn)
        return pa.table({"feature": touched, "z": mz[touched], "n": mn[touched]})

    return shard


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", p: Training = Training()) -> np.ndarray:
    """Weights of the features, the last one being the intercept.

    What the driver holds is the bounded state of 2 ** ``bits`` features, summed on the executors.
    Without fitted rows all weights are zero, and every score is a half."""
    size = 1 << p.bits
    rows = written(labelled(docs, labels, column, p).repartition(p.shards, "shard"), "training-rows")
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for r in range(p.rounds):
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        found = (rows.groupBy("shard").applyInArrow(_shard_learner(state, r, p), "feature long, z double, n double")
                 .groupBy("feature").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("k")).toPandas())
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        z[found["feature"]] = found["z"] / found["k"]
        n[found["feature"]] = found["n"] / found["k"]
        state.unpersist()
    return leader(z, n, p).astype(np.float32)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, of every row; texts do not leave the task.

    A text without words scores by the intercept alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            data, at = utf8(b.column("text"))
            out = np.empty(len(at) - 1)
            for i, j in pieces(at):
                row, feature, value = grams(data[at[i]:at[j]], at[i:j + 1] - at[i], bits)
                out[i:j] = np.bincount(row, w[feature] * value, minlength=j - i) + w[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def filter_quality(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """``docs`` with all columns, without the rows that score below ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights) - 1))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            data, at = utf8(b.column(place))
            keep = np.empty(len(at) - 1, bool)
            for i, j in pieces(at):
                row, feature, value = grams(data[at[i]:at[j]], at[i:j + 1] - at[i], bits)
                keep[i:j] = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature] * value, minlength=j - i) + w[-1], -35, 35))) >= least
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Training = Training()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``.

    ``held_out``: the row's label was never fitted. A null id is held out by none (false)."""
    return scores(docs, fit(docs, labels, "quality", p)).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
