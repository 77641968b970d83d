"""Fitted models whose rows are scored in array batches: forests, boosted trees, perceptrons and linear separators over
random Fourier features. Spark's own models score row by row, which costs many times as much for these."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, LinearSVCModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel,
)
from pyspark.sql import Column, SparkSession, functions as F

from ..session import checkpoint_folder

#: Codes and, where the model has them, the classes' probabilities of a matrix of scaled features.
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]]


def fourier(x: np.ndarray, out: int, gamma: float | None = None, seed: int = 42) -> np.ndarray:
    """Random Fourier features of the Gaussian kernel."""
    n = x.shape[1]
    g = 1.0 / n if gamma is None else gamma
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2 * g), (n, out))
    shift = rng.uniform(0.0, 2 * np.pi, out)
    return np.sqrt(2.0 / out) * np.cos(x @ weights + shift)


def _trees(model) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Depth, split feature, threshold, children (left and right by turns; a leaf is its own) and nodes of each tree."""
    spark = SparkSession.active()
    path = f"{checkpoint_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes: dict[int, list] = {}
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:  # one tree alone
        data = data.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    for tree, n in data.select("treeID", "nodeData").collect():
        nodes.setdefault(tree, []).append(n)
    out = []
    for tree in sorted(nodes):
        rows = sorted(nodes[tree], key=lambda n: n["id"])
        leaf = [n["leftChild"] < 0 for n in rows]
        child = [c for n, end in zip(rows, leaf) for c in ((n["id"],) * 2 if end else (n["leftChild"], n["rightChild"]))]
        depth = [0] * len(rows)
        for n, end in zip(rows, leaf):  # children have greater ids
            if not end:
                depth[n["leftChild"]] = depth[n["rightChild"]] = depth[n["id"]] + 1
        out.append((max(depth), np.array([0 if end else n["split"]["featureIndex"] for n, end in zip(rows, leaf)]),
                    np.array([np.inf if end else n["split"]["leftCategoriesOrThreshold"][0] for n, end in zip(rows, leaf)]),
                    np.array(child), rows))
    return out


def _added(trees: list, values: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Sum over trees, in their order, of the ``values`` of the leaf that a row ends in."""
    parts = [(*t[:4], v) for t, v in zip(trees, values)]

    def run(x: np.ndarray) -> np.ndarray:
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros((len(x), parts[0][4].shape[1]))
        for depth, feature, threshold, child, value in parts:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = child.take(2 * at + (flat.take(first + feature.take(at)) > threshold.take(at)))
            total += value.take(at, axis=0)
        return total

    return run


def _tree(model) -> Scorer:
    trees = _trees(model)
    votes = _added(trees, [np.array([n["impurityStats"] for n in trees[0][4]], dtype=np.float64)])

    def run(x):
        v = votes(x)
        return v.argmax(axis=1), v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)

    return run


def _forest(model) -> Scorer:
    trees = _trees(model)
    counts = [np.array([n["impurityStats"] for n in t[4]], dtype=np.float64) for t in trees]
    votes = _added(trees, [c / np.maximum(c.sum(axis=1, keepdims=True), 1e-300) for c in counts])

    def run(x):
        v = votes(x)
        return v.argmax(axis=1), v / v.sum(axis=1, keepdims=True)

    return run


def _boosted(model) -> Scorer:
    trees = _trees(model)
    margin = _added(trees, [w * np.array([[n["prediction"]] for n in t[4]]) for w, t in zip(model.treeWeights, trees)])

    def run(x):
        m = margin(x)[:, 0]
        p = 1.0 / (1.0 + np.exp(-2.0 * m))
        return (m > 0).astype(int), np.column_stack([1.0 - p, p])

    return run


def _perceptron(model) -> Scorer:
    weights, sizes, layers, at = model.weights.toArray(), model.getLayers(), [], 0
    for n, m in zip(sizes, sizes[1:]):
        layers.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m

    def run(x):
        for k, (w, bias) in enumerate(layers):
            x = x @ w + bias
            if k < len(layers) - 1:
                with np.errstate(over="ignore"):
                    x = 1.0 / (1.0 + np.exp(-x))
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return x.argmax(axis=1), e / e.sum(axis=1, keepdims=True)

    return run


def _separator(model, rff: int) -> Scorer:
    w, bias, cut = model.coefficients.toArray(), model.intercept, model.getThreshold()
    return lambda x: ((fourier(x, rff) @ w + bias > cut).astype(int), None)


def scorer(model, rff: int = 0, tree: bool = False) -> Scorer | None:
    """The array form of a fitted model, or None where Spark's own way is as good; with ``tree`` also that of one tree."""
    if tree and isinstance(model, DecisionTreeClassificationModel):
        return _tree(model)
    if isinstance(model, RandomForestClassificationModel):
        return _forest(model)
    if isinstance(model, GBTClassificationModel):
        return _boosted(model)
    if isinstance(model, MultilayerPerceptronClassificationModel):
        return _perceptron(model)
    if isinstance(model, LinearSVCModel) and rff:
        return _separator(model, rff)
    return None


#: Rows that are scored at once: what they need fits a core's cache.
BATCH = 2_048


def scores(score: Scorer, features: Column) -> Column:
    """``code`` and ``probabilities`` (null where there are none) of an array column of scaled features."""

    @F.arrow_udf("struct<code: int, probabilities: array<double>>")
    def run(v: pa.Array) -> pa.Array:
        n = len(v)
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        found = [score(x[k:k + BATCH]) for k in range(0, n, BATCH)]
        codes = pa.array(np.concatenate([f[0] for f in found]) if n else [], pa.int32())
        if not n or found[0][1] is None:
            p = pa.nulls(n, pa.list_(pa.float64()))
        else:
            flat = np.concatenate([f[1] for f in found])
            p = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([codes, p], ["code", "probabilities"])

    return run(features)
