"""Feature selection: variance, correlation, information, importance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from .clean import quoted
from ..session import cut_lineage
from .ordered import exact_quantiles, matrix


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value, from one aggregation."""
    row = df.agg(*[
        (F.max(quoted(c)) > F.min(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)
    ]).first()
    return [c for c, varies in zip(columns, row) if varies]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """|Pearson r| of every ordered column pair; null where a column is constant.

    A pair counts the rows in which both have a finite value. One scan gives the columns'
    means, another the pairs' sums of centred values: each task adds up matrix products of
    its batches, one row per pair, so any width takes the same way. Values are tested for being
    finite there too: one compiled method for many columns is too long to be fast.
    """
    plain = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def totals(batches):
        n, total = np.zeros(len(columns)), np.zeros(len(columns))
        for b in batches:
            x = matrix(b.columns)
            there = np.isfinite(x)
            n += there.sum(axis=0)
            total += np.where(there, x, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(columns), dtype=np.int32)), pa.array(n), pa.array(total)], ["pos", "n", "x"])

    means = plain.mapInArrow(totals, "pos int, n double, x double").groupBy("pos").agg(
        F.try_divide(F.sum("x"), F.sum("n")).alias("mean")).collect()
    found = {r["pos"]: r["mean"] for r in means}
    centre = np.array([found.get(i) or 0.0 for i in range(len(columns))])
    left, right = np.triu_indices(len(columns), 1)

    def sums(batches):
        total = np.zeros((6, len(left)))
        for b in batches:
            x = matrix(b.columns) - centre
            there = np.isfinite(x)
            if there.all():
                s, q = x.sum(axis=0), (x * x).sum(axis=0)
                total += np.array([np.full(len(left), float(len(x))), s[left], s[right], q[left], q[right], (x.T @ x)[left, right]])
                continue
            x, m = np.where(there, x, 0.0), there.astype(float)
            products = (m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x)
            total += np.array([p[left, right] for p in products])
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, total)],
            ["left_pos", "right_pos", "n", "x", "y", "xx", "yy", "xy"])

    schema = "left_pos int, right_pos int, n double, x double, y double, xx double, yy double, xy double"
    s = plain.mapInArrow(sums, schema).groupBy("left_pos", "right_pos").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = [F.col(q) - F.col(v) * F.col(v) / F.col("n") for v, q in (("x", "xx"), ("y", "yy"))]
    # rounding leaves a little spread in a constant column
    constant = [d <= F.col(q) * 1e-13 for d, q in zip(spread, ("xx", "yy"))]
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.sqrt(spread[0]) * F.sqrt(spread[1]))
    names = F.array(*[F.lit(c) for c in columns])
    return s.select(
        names[F.col("left_pos")].alias("left"), names[F.col("right_pos")].alias("right"), "left_pos", "right_pos",
        F.when((F.col("n") > 1) & ~constant[0] & ~constant[1], F.abs(r)).alias("r"))


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Columns with any earlier column above the threshold, kept or not."""
    if len(columns) < 2:
        return []
    hits = correlation_pairs(df, columns).where(F.col("r") > threshold)
    named = {r["right"] for r in hits.select("right").distinct().collect()}
    return [c for c in columns if c in named]


def mutual_information(
    df: DataFrame, columns: list[str], label: str = "Label", bins: int = 10
) -> DataFrame:
    """Mutual information (nats) of each column, cut at its quantiles, with the label.

    Unlike a nearest-neighbour estimate this is exact for the binned column and needs one
    shuffle of at most columns x bins x classes rows. Rows without a value of a column do not
    count for it; infinities lie in the end bins.
    """
    plain = df.select(quoted(label).cast("string").alias("y"), *[
        quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)
    ])
    edges = exact_quantiles(plain, plain.columns[1:], [b / bins for b in range(1, bins)])
    cuts = [np.array([e for e in edges[c] if e is not None and e == e]) for c in plain.columns[1:]]

    def counted(batches):
        for b in batches:
            y = b.column(0).dictionary_encode("encode")
            names, k = y.indices.to_numpy(zero_copy_only=False), max(1, len(y.dictionary))
            found = []
            for cut, x in zip(cuts, matrix(b.columns[1:]).T):
                there = ~np.isnan(x)
                n = np.bincount(np.searchsorted(cut, x[there]) * k + names[there])
                at = np.flatnonzero(n)
                found.append((at, n[at]))
            pos = np.repeat(np.arange(len(found), dtype=np.int32), [len(at) for at, _ in found])
            at, n = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pos), pa.array((at // k).astype(np.int32)), y.dictionary.take(pa.array(at % k)), pa.array(n.astype(np.int64))],
                ["pos", "bin", "y", "n"])

    joint = plain.mapInArrow(counted, "pos int, bin int, y string, n long").groupBy("pos", "bin", "y").agg(
        F.sum("n").alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("pos"))
    in_bin = F.sum("n").over(Window.partitionBy("pos", "bin"))
    in_y = F.sum("n").over(Window.partitionBy("pos", "y"))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        joint.withColumns({"t": total, "b": in_bin, "k": in_y})
        .groupBy("pos").agg(
            F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("k"))))
            .alias("score")
        )
        .select(names[F.col("pos")].alias("feature"), F.col("pos").alias("position"), "score")
    )


def importance(
    df: DataFrame, columns: list[str], label: str = "Label", trees: int = 100, depth: int = 6,
    seed: int = 42,
) -> DataFrame:
    """Forest feature importance (boosting where the label has two classes)."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    plain = df.select(quoted(label).cast("string").alias("y"), *[
        quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)
    ])
    indexed = StringIndexer(
        inputCol="y", outputCol="code", stringOrderType="alphabetAsc"
    ).fit(plain)
    rows = VectorAssembler(
        inputCols=plain.columns[1:], outputCol="v"
    ).transform(indexed.transform(plain))
    args = dict(featuresCol="v", labelCol="code", maxDepth=depth, seed=seed)
    if len(indexed.labels) == 2:
        model = GBTClassifier(maxIter=trees, stepSize=0.1, **args).fit(rows)
    else:
        model = RandomForestClassifier(numTrees=trees, **args).fit(rows)
    scores = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(c, i, float(s)) for i, (c, s) in enumerate(zip(columns, scores))],
        "feature STRING, position INT, score DOUBLE",
    )


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best features, in original column order."""
    return scores.orderBy(F.desc("score"), "position").limit(k).orderBy("position")


def top_report(scores: DataFrame, n: int = 5) -> DataFrame:
    """Best n with rounded scores."""
    return scores.orderBy(F.desc("score"), "position").limit(n).select(
        "feature", F.round("score", 4).alias("score")
    )


def select_features(
    df: DataFrame, columns: list[str], mode: str, label: str = "Label", trees: int = 100,
    threshold: float = 0.95, known: dict | None = None, fit_on: DataFrame | None = None,
) -> list[str]:
    """``all``, ``variance``, ``top-K``, ``importance-K``, ``corr-K`` or ``smart-K``.

    ``known`` keeps scores and statistics between calls over the same rows, by kind and columns. Importance is
    fitted on ``fit_on``, or on ``df``; all else is a statistic of ``df``."""
    known = {} if known is None else known

    def varying() -> list[str]:
        key = "varying", tuple(columns)
        if key not in known:
            known[key] = varying_columns(df, columns)
        return known[key]

    if mode == "all":
        return list(columns)
    if mode == "variance":
        return varying()
    m = re.fullmatch(r"(top|importance|corr|smart)-(\d+)", mode)
    if not m:
        raise ValueError(f"unknown selection mode {mode!r}")
    kind, k = m.group(1), min(int(m.group(2)), len(columns))
    pool = list(columns)
    if kind == "smart":
        pool = varying()
    if kind in ("smart", "corr"):
        key = "correlated", tuple(pool), threshold
        if key not in known:
            known[key] = set(correlated_columns(df, pool, threshold))
        pool = [c for c in pool if c not in known[key]]
    by_information = kind in ("top", "corr")
    key = by_information, tuple(pool)
    if key not in known:
        known[key] = cut_lineage(
            mutual_information(df, pool, label) if by_information else importance(df if fit_on is None else fit_on, pool, label, trees))
    scores = known[key]
    return [r["feature"] for r in top_k(scores, k).collect()]


# Selection modes compared on the same data.
SWEEP_MODES = [
    "all", "variance", "smart-30", "smart-40", "smart-50", "importance-30", "importance-40",
    "top-30", "top-40",
]
