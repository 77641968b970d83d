"""Scores of predictions against truth, all from the k x k table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import running, value_cell

ROUND = 4


def confusion_counts(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", times: str | None = None) -> DataFrame:
    """(y_true, y_pred, n): the only pass over the rows. ``times``: how many rows a row stands for."""
    return df.groupBy(
        F.col(truth).cast("string").alias("y_true"), F.col(pred).cast("string").alias("y_pred")
    ).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, f1, support per class; a class never seen or predicted scores 0."""
    same = F.col("y_true") == F.col("y_pred")
    parts = counts.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")),
    )))
    if labels is not None:
        known = F.array(*[F.lit(str(v)) for v in labels])
        extra = counts.agg(F.count(F.lit(1)).alias("x")).select(
            F.explode(known).alias("label"),
            *[F.lit(0).cast("long").alias(c) for c in ("support", "tp", "predicted")]
        )
        parts = parts.unionByName(extra)
    c = parts.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"),
    )
    return c.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("support")),
        "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    }).select("label", "precision", "recall", "f1", "support", "tp", "predicted")


def metrics(counts: DataFrame, average: str = "macro", positive: str = "1") -> DataFrame:
    """One row: accuracy and precision, recall, f1 under ``binary``, ``macro`` or ``weighted``."""
    p = per_class(counts)
    accuracy = _ratio(F.sum("tp"), F.sum("support"))
    names = ("precision", "recall", "f1")
    if average == "binary":
        vals = [F.coalesce(F.max(F.when(F.col("label") == positive, F.col(c))), F.lit(0.0))
                for c in names]
    elif average == "macro":
        vals = [F.coalesce(F.avg(c), F.lit(0.0)) for c in names]
    elif average == "weighted":
        vals = [_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in names]
    else:
        raise ValueError(f"unknown average {average!r}")
    return p.agg(
        F.round(accuracy, ROUND).alias("accuracy"),
        *[F.round(v, ROUND).alias(c) for c, v in zip(names, vals)],
    )


def classification_report(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Per class, then accuracy, macro and weighted averages."""
    p = per_class(counts, labels)
    n = F.sum("support")
    rows = [F.struct(
        F.lit("accuracy").alias("label"),
        *[_ratio(F.sum("tp"), n).alias(c) for c in ("precision", "recall", "f1")],
        n.alias("support"),
    ), F.struct(
        F.lit("macro avg").alias("label"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"),
    ), F.struct(
        F.lit("weighted avg").alias("label"),
        *[_ratio(F.sum(F.col(c) * F.col("support")), n).alias(c)
          for c in ("precision", "recall", "f1")], n.alias("support"),
    )]
    tail = p.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return p.drop("tp", "predicted").unionByName(tail)


def worst_classes(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Classes by rising f1."""
    return per_class(counts, labels).select("label", "f1").orderBy("f1", "label")


def confusion_matrix(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Rows true, columns predicted, 0 where nothing fell; every label has its row."""
    all_rows = counts.agg(F.count(F.lit(1)).alias("x")).select(
        F.explode(F.array(*[F.lit(str(v)) for v in labels])).alias("y_true"),
        F.lit(None).cast("string").alias("y_pred"), F.lit(0).cast("long").alias("n"),
    )
    return (
        counts.where(F.col("y_true").isin([str(v) for v in labels])).unionByName(all_rows)
        .groupBy("y_true").pivot("y_pred", [str(v) for v in labels]).agg(F.sum("n")).na.fill(0)
    )


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "score", cells: int = 4096) -> DataFrame:
    """Area under the ROC curve; tied scores count half. Null if a class is absent.

    Rows collapse to one per distinct score; the positives below each are a running sum
    over score cells, so no task sees all scores.
    """
    return area(score_counts(df, truth, score), cells=cells)


def score_counts(df: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """(s, pos, neg): how many rows of either class have a score."""
    s, y = F.col(score).cast("double"), F.col(truth).cast("int")
    return df.where(s.isNotNull() & y.isNotNull()).groupBy(s.alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def area(per: DataFrame, by: tuple[str, ...] = (), cells: int = 4096) -> DataFrame:
    """:func:`roc_auc` of :func:`score_counts`, one for each value of ``by``."""
    # cells by signed logarithm: it keeps the order and spreads probabilities and amounts alike
    chunk = value_cell(F.col("s"), cells)
    cum = running(per, [*by], ["s"], chunk, sums={"neg_upto": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    return cum.groupBy(*by).agg(
        F.round(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), ROUND).alias("roc_auc")
    )


def threshold_predict(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def rank_models(results: DataFrame) -> DataFrame:
    """Models by falling f1, the name breaking ties."""
    return results.orderBy(F.desc("f1"), "model")


def best_model(results: DataFrame) -> DataFrame:
    return rank_models(results).limit(1)
