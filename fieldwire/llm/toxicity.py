"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) is the logistic of one weighted sum less the k-th threshold, so grades share all weights
and differ in ordered thresholds alone. The expected grade is the sum of these probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mixed, pieces, prefix_hashes, span_hashes, texts, tokens, utf8, written
from .quality import Training, labelled


@dataclass(frozen=True)
class Ordinal:
    """``most_rows`` bounds the labelled rows that are fitted (as in ``quality.Training``); ``grades`` above 0;
    features in fewer than ``least_rows`` fitted rows, or with log odds nearer to zero than
    ``least_odds``, are not used; ``prefixes`` of words in bytes."""
    bits: int = 20
    most_rows: int = 24_000
    shards: int = 8
    rounds: int = 3
    epochs: int = 10
    grades: int = 3
    rate: float = 0.5
    l1: float = 0.002
    l2: float = 0.0005
    least_rows: int = 4
    least_odds: float = 1.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10)


def features(data: np.ndarray, at: np.ndarray, p: Ordinal, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value, sorted by row and feature: words, and the first bytes of longer words.

    The value is one plus the logarithm of the count: one word weighs as much in a long text as in a short
    one. ``use`` marks the features that matter; others are left out before anything is sorted."""
    lower, h, row, start, end = tokens(data, at, split_signs=True, with_text=True)
    prefix = prefix_hashes(lower)
    rows, found = [row], [h]
    for n in p.prefixes:
        long = np.flatnonzero(end - start > n)
        found.append(mixed(span_hashes(prefix, start[long], start[long] + n) + np.uint64(n)))
        rows.append(row[long])
    row, feature = np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - p.bits)).astype(np.int64)
    if use is not None:
        some = np.flatnonzero(use[feature])
        row, feature = row[some], feature[some]
    key, count = np.unique((row.astype(np.int64) << p.bits) | feature, return_counts=True)
    return key >> p.bits, key & ((1 << p.bits) - 1), 1 + np.log(count)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def gradient(total: float, cuts: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    """Derivatives of minus the log likelihood of grade ``y``: by the weighted sum, by each threshold.

    P(y) = F(total - cut below y) - F(total - cut above y); outside the ends F is 1 and 0."""
    above = logistic(total - cuts)
    low = 1.0 if y == 0 else above[y - 1]
    high = 0.0 if y == len(cuts) else above[y]
    p = max(low - high, 1e-9)
    d_low, d_high = low * (1 - low), high * (1 - high)
    by_cut = np.zeros(len(cuts))
    if y > 0:
        by_cut[y - 1] = d_low / p
    if y < len(cuts):
        by_cut[y] = -d_high / p
    return -(d_low - d_high) / p, by_cut


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray


def graded(rows: list[tuple[np.ndarray, np.ndarray, int]], marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Grade of each row: 0 where it is not labelled toxic, else 1 plus how many ``edges`` its dose of marks passes."""
    dose = np.array([marks[f] @ v for f, v, _ in rows])
    return np.array([0 if not y else 1 + int(np.searchsorted(edges, d, "right")) for (_, _, y), d in zip(rows, dose)])


def learner(state, seed: int, p: Ordinal):
    """What one shard does in a round: adaptive gradient steps with soft thresholds for the weights."""
    def shard(group: pa.Table) -> pa.Table:
        weights, squares, cuts, marks, edges, use = state.value
        weights, squares, cuts = weights.copy(), squares.copy(), cuts.copy()
        rows = sparse_rows(group, p, use)
        grade = graded(rows, marks, edges)
        order, cut_squares = np.random.default_rng(seed), np.ones(len(cuts))
        for _ in range(p.epochs):
            for k in order.permutation(len(rows)):
                f, v, _ = rows[k]
                by_sum, by_cut = gradient(weights[f] @ v, cuts, grade[k])
                g = by_sum * v + p.l2 * weights[f]
                squares[f] += g * g
                step = p.rate / np.sqrt(1 + squares[f])
                w = weights[f] - step * g
                weights[f] = np.sign(w) * np.maximum(np.abs(w) - step * p.l1, 0)
                cut_squares += by_cut ** 2
                cuts = np.maximum.accumulate(cuts - p.rate / np.sqrt(cut_squares) * by_cut)
        touched = np.flatnonzero(squares)
        at = np.concatenate([touched, len(weights) + np.arange(len(cuts))])
        return pa.table({"feature": at, "w": np.concatenate([weights[touched], cuts]), "q": np.concatenate([squares[touched], cut_squares])})
    return shard


def sparse_rows(group: pa.Table, p: Ordinal, use: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    group = group.sort_by("doc_id")
    data, at = utf8(pa.concat_arrays(group.column("text").chunks))
    y, out = group.column("y").to_pylist(), []
    for i, j in pieces(at):
        row, feature, value = features(data[at[i]:at[j]], at[i:j + 1] - at[i], p, use)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        feature, value = feature.astype(np.int32), value.astype(np.float32)
        out += [(feature[cut[k]:cut[k + 1]].copy(), value[cut[k]:cut[k + 1]].copy(), y[i + k]) for k in range(j - i)]
    return out


def marks_of(rows: DataFrame, p: Ordinal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How strongly each feature marks toxic rows, the doses that part their grades, and which features are used.

    A feature's mark is its log odds of being in toxic against other rows where that is over 2 and it is in
    three toxic rows or more, else 0. A row's dose is the sum of its marks; toxic rows are parted into
    ``grades`` of equal size by dose, as the labels tell toxic rows but not how severe they are."""
    def counted(group: pa.Table) -> pa.Table:
        found = sparse_rows(group, p)
        toxic, other = (np.bincount(np.concatenate([f for f, _, y in found if bool(y) == side] or [np.zeros(0, np.int64)]), minlength=1 << p.bits) for side in (True, False))
        at = np.flatnonzero(toxic + other)
        n = sum(bool(y) for *_, y in found)
        return pa.table({"feature": np.append(at, 1 << p.bits), "toxic": np.append(toxic[at], n), "other": np.append(other[at], len(found) - n)})

    c = rows.groupBy("shard").applyInArrow(counted, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") + F.col("other") >= p.least_rows).toPandas()
    marks, use = np.zeros(1 << p.bits), np.zeros(1 << p.bits, bool)
    whole = c[c.feature == 1 << p.bits]
    if len(whole):
        n, m = float(whole.toxic.iloc[0]), float(whole.other.iloc[0])
        odds = np.log((c.toxic + 0.5) / (n - c.toxic + 0.5)) - np.log((c.other + 0.5) / (m - c.other + 0.5))
        good = (odds > 2) & (c.toxic >= 3) & (c.feature < 1 << p.bits)
        marks[c.feature[good]] = odds[good]
        use[c.feature[(np.abs(odds) >= p.least_odds) & (c.feature < 1 << p.bits)]] = True
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def doses(group: pa.Table) -> pa.Table:
        return pa.table({"dose": np.array([shared.value[f] @ v for f, v, y in sparse_rows(group, p) if y], float)})

    quantiles = [k / p.grades for k in range(1, p.grades)]
    row = rows.groupBy("shard").applyInArrow(doses, "dose double").agg(F.percentile("dose", quantiles).alias("q")).first()
    return marks, np.array(row["q"] if row and row["q"] else np.arange(1, p.grades), float), use


def fit(docs: DataFrame, labels: DataFrame, p: Ordinal = Ordinal()) -> Model:
    """Shards learn side by side from shared weights; weights and thresholds are averaged after each round.

    The driver holds the bounded state of 2 ** ``bits`` features. Rows are fitted as in ``quality.labelled``."""
    rows = written(labelled(docs, labels, "toxic", Training(bits=p.bits, most_rows=p.most_rows, shards=p.shards)).repartition(p.shards, "shard"), "toxicity-rows")
    size = 1 << p.bits
    weights, squares, cuts = np.zeros(size), np.zeros(size), np.linspace(2, 4, p.grades)
    marks, edges, use = marks_of(rows, p)
    for r in range(p.rounds):
        state = docs.sparkSession.sparkContext.broadcast((weights, squares, cuts, marks, edges, use))
        found = (rows.groupBy("shard").applyInArrow(learner(state, r, p), "feature long, w double, q double")
                 .groupBy("feature").agg(F.avg("w").alias("w"), F.avg("q").alias("q")).toPandas())
        if not len(found):
            break
        both = np.concatenate([weights, cuts])
        both[found["feature"]] = found["w"]
        weights, cuts = both[:size], np.maximum.accumulate(both[size:])
        q = np.append(squares, np.zeros(len(cuts)))
        q[found["feature"]] = found["q"]
        squares = q[:size]
        state.unpersist()
    return Model(weights.astype(np.float32), cuts)


def severity(docs: DataFrame, model: Model, p: Ordinal = Ordinal()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``severity`` (expected grade), ``grade`` (the likeliest one),
    ``p_toxic`` (probability of a grade above 0), ``toxic`` (that probability is a half or more).

    Whole texts are read; null text is empty, and a text without words has the grade of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        use = weights != 0
        for b in batches:
            data, at = utf8(b.column("text"))
            total = np.zeros(len(at) - 1)
            for i, j in pieces(at):
                row, feature, value = features(data[at[i]:at[j]], at[i:j + 1] - at[i], p, use)
                total[i:j] = np.bincount(row, weights[feature] * value, minlength=j - i)
            above = logistic(total[:, None] - cuts)
            ends = np.hstack([np.ones((len(total), 1)), above, np.zeros((len(total), 1))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(1)), pa.array(np.argmax(ends[:, :-1] - ends[:, 1:], 1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
