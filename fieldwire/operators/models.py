"""Scaling, classifiers, prediction, persistence and comparison."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import BENIGN
from ..session import cut_lineage
from . import evaluate
from .clean import (
    align_columns, encode_labels, decode_labels, impute_lenient, impute_own_median, label_codes,
    label_set, lenient_number, payload_classes_only, quoted,
)
from .knn import knn_predict
from .ordered import matrix
from .scoring import BATCH, fourier, scorer, scores
from .select import SWEEP_MODES, select_features


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per feature; a zero deviation counts as 1."""
    aggs = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(features)],
    )
    rows = [F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
        F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
    ) for i, c in enumerate(features)]
    return aggs.select(F.inline(F.array(*rows)))


def standard_scale(df: DataFrame, features: list[str], stats: list) -> DataFrame:
    """Scaled copies of the features; ``stats`` are the rows of :func:`scaler_stats`."""
    return df.withColumns({
        r["feature"]: (quoted(r["feature"]) - F.lit(r["mean"])) / F.lit(r["scale"])
        for r in stats if r["feature"] in features
    })


def _scaling_stage(features: list[str], stats: list, out: str) -> list:
    """Pipeline stages from raw feature columns to one scaled vector."""
    cols = ", ".join(
        f"(CAST(`{r['feature']}` AS DOUBLE) - CAST({r['mean']!r} AS DOUBLE)) / "
        f"CAST({r['scale']!r} AS DOUBLE) AS __x{r['position']}" for r in stats
    )
    return [
        SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__x{i}" for i in range(len(features))], outputCol=out),
        SQLTransformer(statement="SELECT * EXCEPT ({}) FROM __THIS__".format(
            ", ".join(f"__x{i}" for i in range(len(features)))
        )),
    ]


def classifier(kind: str, n_classes: int, n_features: int, seed: int = 42, rows: int = 1, **opt):
    """An estimator on columns ``features`` and ``label_code``."""
    io = dict(featuresCol="features", labelCol="label_code")
    if kind == "logistic":
        # L2 strength: the inverse of C summed over rows becomes a per-row mean here
        return LogisticRegression(maxIter=opt.get("max_iter", 1000), regParam=1.0 / max(rows, 1), **io)
    if kind == "tree":
        # Spark looks for cuts among max(bins^2, 10000) rows: with so many bins among all of them
        bins = max(32, math.isqrt(rows) + 1) if opt.get("all_cuts") else 32
        return DecisionTreeClassifier(maxDepth=opt.get("depth", 30), maxBins=bins, seed=seed, **io)
    if kind == "forest":
        return RandomForestClassifier(
            numTrees=opt.get("trees", 400), maxDepth=opt.get("depth", 16), seed=seed, **io
        )
    if kind == "boost":
        one = GBTClassifier(
            maxIter=opt.get("trees", 400), maxDepth=opt.get("depth", 8), stepSize=0.1, seed=seed, **io
        )
        return one if n_classes == 2 else OneVsRest(classifier=one, parallelism=4, **io)
    if kind == "svm":
        one = LinearSVC(maxIter=opt.get("max_iter", 100), regParam=1.0 / max(rows, 1), **io)
        return one if n_classes == 2 else OneVsRest(classifier=one, parallelism=4, **io)
    if kind == "mlp":
        layers = [n_features, *opt.get("hidden", (256, 128, 64)), n_classes]
        return MultilayerPerceptronClassifier(
            layers=layers, maxIter=opt.get("max_iter", 100), blockSize=128, seed=seed, **io
        )
    raise ValueError(f"unknown classifier {kind!r}")


def random_fourier(
    df: DataFrame, vector: str, out: int = 256, gamma: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Replace a vector column by random Fourier features of the Gaussian kernel, so that a
    linear separator approximates an RBF one."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(list(fourier(x, out, gamma, seed)))

    return df.withColumn(vector, array_to_vector(lift(vector_to_array(vector))))


@dataclass
class FlowModel:
    """Fitted scaler and classifier with the feature order and label codes."""

    pipeline: PipelineModel
    features: list[str]
    codes: dict[str, int]
    stats: list[dict]
    kind: str = "forest"
    rff: int = 0

    def predict(self, df: DataFrame, out: str = "predicted_label", keep_code: bool = False) -> DataFrame:
        """Add the predicted label and, where the classifier has one, its probability.

        Absent, unparsable or non-finite features count as 0. Works on streams too.
        """
        safe = {f: f"__f{i}" for i, f in enumerate(self.features)}
        clean = impute_lenient(df.withColumns(
            {s: quoted(f) if f in df.columns else F.lit(0.0) for f, s in safe.items()}
        ), list(safe.values()))
        head, tail = self.pipeline.stages[:-1], self.pipeline.stages[-1]
        vec = PipelineModel(head).transform(clean)
        score = scorer(tail, self.rff)
        if score is None:
            if self.rff:
                vec = random_fourier(vec, "features", self.rff)
            scored = tail.transform(vec)
            if "probability" in scored.columns:
                scored = scored.withColumn("__p", vector_to_array("probability"))
        else:
            scored = vec.withColumn("__s", scores(score, vector_to_array("features"))).withColumns(
                {"prediction": F.col("__s.code"), "__p": F.col("__s.probabilities")})
        scored = decode_labels(scored, self.codes, "prediction", out)
        has = "__p" in scored.columns and "probabilityCol" in {p.name for p in tail.params}
        conf = F.col("__p")[F.col("prediction").cast("int")] if has else F.lit(None).cast("double")
        extra = [F.col("prediction").cast("int").alias("code")] if keep_code else []
        score = [F.col("__p").alias("probabilities")] if keep_code and has else []
        return scored.select(
            *[quoted(c) for c in df.columns], out, conf.alias("conf"), *extra, *score
        )

    def save(self, path: str) -> None:
        """Pipeline under ``path/pipeline``, the rest as one JSON line under ``path/meta``."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = json.dumps({
            "format": "fieldwire-flow-model", "features": self.features, "codes": self.codes,
            "stats": self.stats, "kind": self.kind, "rff": self.rff,
        })
        _spark().createDataFrame([(meta,)], "value STRING").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta"
        )

    @staticmethod
    def load(path: str) -> "FlowModel":
        try:
            meta = json.loads(_spark().read.text(f"{path}/meta").first()["value"])
        except Exception as e:
            raise ValueError(f"{path} holds no flow model") from e
        if meta.pop("format", None) != "fieldwire-flow-model":
            raise ValueError(f"{path} holds no flow model")
        return FlowModel(PipelineModel.load(f"{path}/pipeline"), **meta)

    def bundle(self) -> DataFrame:
        """Scaler and label tables: (part, position, name, mean, scale)."""
        rows = [("feature", s["position"], s["feature"], s["mean"], s["scale"]) for s in self.stats]
        rows += [("label", i, v, None, None) for v, i in sorted(self.codes.items(), key=lambda x: x[1])]
        return _spark().createDataFrame(
            rows, "part STRING, position INT, name STRING, mean DOUBLE, scale DOUBLE"
        )


def scale_by_bundle(df: DataFrame, bundle: DataFrame) -> DataFrame:
    """Features scaled as an exported bundle says; absent, unparsable or non-finite ones count as 0."""
    stats = bundle.where("part = 'feature'").orderBy("position").collect()
    names = [s["name"] for s in stats]
    clean = impute_lenient(df, names)
    return clean.withColumns({
        s["name"]: (quoted(s["name"]) - F.lit(s["mean"])) / F.lit(s["scale"]) for s in stats
    })


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()


#: Rows of a task of a fit, at least.
FIT_TASK_ROWS = 4_000


def fit_model(
    train: DataFrame, features: list[str], label: str = "Label", kind: str = "forest",
    codes: dict[str, int] | None = None, seed: int = 42, rff: int = 0, **opt,
) -> FlowModel:
    """Scale, then fit. ``codes`` fixes the label codes, for labels train does not hold. A tree with ``all_cuts``
    takes its thresholds from all rows; else from 10,000 of them, as Spark's trees do."""
    safe = [f"__f{i}" for i in range(len(features))]
    # the fit passes over the matrix many times: write it once to the shared folder. Each pass starts a task per
    # partition, of which a large table leaves many with a few rows
    rows = cut_lineage(train.select(
        quoted(label), *[quoted(f).cast("double").alias(s) for f, s in zip(features, safe)]))
    codes = codes or label_codes(label_set(rows, label=label), label)
    rows = encode_labels(rows, codes, label).where("label_code IS NOT NULL").select("label_code", *safe)
    n = rows.count()
    rows = rows.coalesce(max(1, -(-n // FIT_TASK_ROWS)))
    stats = scaler_stats(rows, safe).orderBy("position").collect()
    vec = Pipeline(stages=_scaling_stage(safe, stats, "features")).fit(rows)
    ready = vec.transform(rows)
    if kind == "svm" and rff:
        ready = random_fourier(ready, "features", rff)
    est = classifier(kind, len(codes), rff or len(features), seed, n, **opt)
    ready = ready.select("label_code", "features").persist()
    fitted = est.fit(ready)
    ready.unpersist()
    return FlowModel(
        PipelineModel(vec.stages + [fitted]), list(features), codes,
        [{**r.asDict(), "feature": f} for r, f in zip(stats, features)], kind,
        rff if kind == "svm" else 0,
    )


# The benchmark's classifiers and their sizes.
BENCH_MODELS = {
    "Logistic Regression": ("logistic", {"max_iter": 1000}),
    "Decision Tree": ("tree", {"depth": 30}),
    "Random Forest": ("forest", {"trees": 200}),
    "Boosted Trees": ("boost", {"trees": 200, "depth": 6}),
    "SVM (RBF)": ("svm", {"rff": 256}),
    "MLP": ("mlp", {"hidden": (256, 128, 64)}),
}
KNN_NAME = "KNN (k=5)"

RESULT_SCHEMA = (
    "model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, roc_auc DOUBLE, "
    "train_sec DOUBLE, infer_sec DOUBLE, rows LONG"
)


def compare_models(
    train: DataFrame, test: DataFrame, features: list[str], label: str = "Label",
    models: dict | None = None, row_id: str | None = None, seed: int = 42,
) -> DataFrame:
    """Scores, seconds and rows scored per classifier. With two classes the scores are those of the
    second class and the area under the curve is added; ``row_id`` adds nearest neighbours."""
    # every model reads the rows to fit and to score again: they are looked up in the table once
    train, test = (d.select(*[quoted(c) for c in dict.fromkeys([*([row_id] if row_id else []), label, *features]) if c in d.columns])
                   for d in (train, test))
    train, test = cut_lineage(train), test.cache()
    codes = label_codes(label_set(train, label=label), label)
    binary = len(codes) == 2
    if binary and BENIGN in codes:
        codes = {k: int(k != BENIGN) for k in codes}
    positive = [k for k, v in codes.items() if v == 1]
    results, curves = [], []

    def scored(name, rows: DataFrame, t_train: float, prob: str | None):
        rows = rows.select(quoted(label), "predicted_label", *([F.col(prob)[1].alias("score")] if binary and prob else [])).cache()
        t0 = time.time()
        counts = cut_lineage(evaluate.confusion_counts(rows, label, "predicted_label"))
        m = evaluate.metrics(counts, "binary" if binary else "macro", positive[0] if binary else "1").first()
        n = counts.agg(F.sum("n")).first()[0]
        t_infer = time.time() - t0
        if "score" in rows.columns:
            truth = (quoted(label) == positive[0]).cast("int")
            per = evaluate.score_counts(rows.select(truth.alias("y_true"), "score"))
            curves.append(cut_lineage(per.withColumn("model", F.lit(name))))
        rows.unpersist()
        results.append((name, m["accuracy"], m["precision"], m["recall"], m["f1"],
                        round(t_train, 2), round(t_infer, 4), n))

    for name, (kind, opt) in (BENCH_MODELS if models is None else models).items():
        t0 = time.time()
        model = fit_model(train, features, label, kind, codes, seed, **opt)
        t_train = time.time() - t0
        out = model.predict(test, keep_code=True)
        scored(name, out, t_train, "probabilities" if "probabilities" in out.columns else None)
    if row_id:
        stats = scaler_stats(train, features).collect()
        side = [standard_scale(d, features, stats).select(
            row_id, label, F.array(*[quoted(c) for c in features]).alias("v")
        ) for d in (train, test)]
        t0 = time.time()
        out = knn_predict(side[0], side[1], 5, label, "v", row_id).withColumnRenamed("prediction", "predicted_label")
        t_train = time.time() - t0
        scored(KNN_NAME, out, t_train, None)
    test.unpersist()
    areas = {}
    if curves:  # of all models at once: the plan has a dozen stages however few rows there are
        areas = dict(map(tuple, evaluate.area(reduce(DataFrame.unionByName, curves), ("model",)).collect()))
    return train.sparkSession.createDataFrame([(*r[:5], areas.get(r[0]), *r[5:]) for r in results], RESULT_SCHEMA)


def sweep_features(
    train: DataFrame, test: DataFrame, columns: list[str], label: str = "Label",
    modes: list[str] | None = None, kind: str = "forest", trees: int = 100,
    whole: DataFrame | None = None, **opt,
) -> DataFrame:
    """One row per selection mode: features kept, accuracy, macro f1, rows scored. ``whole`` are the rows whose
    statistics choose the features, where ``train`` is only a part of them."""
    train, found, known = train.cache(), [], {}
    for mode in SWEEP_MODES if modes is None else modes:
        kept = select_features(train if whole is None else whole, columns, mode, label, trees,
                               known=known, fit_on=train)
        found.append((mode, kept, fit_model(
            train, kept, label, kind, **({"trees": trees} if kind in ("forest", "boost") else {}), **opt)))
    train.unpersist()
    rows = []
    for (mode, kept, _), counts in zip(found, confusions([model for *_, model in found], test, label)):
        m = evaluate.metrics(counts, "macro").first()
        rows.append((mode, len(kept), m["accuracy"], m["f1"], counts.agg(F.sum("n")).first()[0]))
    return train.sparkSession.createDataFrame(
        rows, "mode STRING, features INT, accuracy DOUBLE, macro_f1 DOUBLE, rows LONG"
    )


def confusions(found: list[FlowModel], df: DataFrame, label: str = "Label") -> list[DataFrame]:
    """:func:`evaluate.confusion_counts` of each model over the rows of ``df``.

    Models with an array form share one pass: batches of rows are scored by all of them and counted where they are."""
    names = list(dict.fromkeys(f for m in found for f in m.features))
    forms = [(k, scorer(m.pipeline.stages[-1], m.rff, True)) for k, m in enumerate(found)]
    parts = []
    for k, score in forms:
        m = found[k]
        stats = sorted(m.stats, key=lambda s: s["position"])
        parts.append((k, score, np.array([names.index(f) for f in m.features], dtype=int),
                      np.array([s["mean"] for s in stats], dtype=float), np.array([s["scale"] for s in stats], dtype=float)))
    arrays = [p for p in parts if p[1] is not None]
    types = {f.name: f.dataType for f in df.schema}

    def number(c: str):
        if c not in types:
            return F.lit(0.0)
        return quoted(c).cast("double") if isinstance(types[c], T.NumericType) else lenient_number(quoted(c))

    def counted(batches):
        for b in batches:
            y = b.column(0).dictionary_encode("encode")
            truth, size = y.indices.to_numpy(zero_copy_only=False), max(1, len(y.dictionary))
            x = matrix(b.columns[1:])
            x = np.where(np.isfinite(x), x, 0.0)
            model, code, true, n = [], [], [], []
            for k, score, at, mean, scale in arrays:
                codes = np.concatenate([score((x[r:r + BATCH, at] - mean) / scale)[0] for r in range(0, len(x), BATCH)] or [np.zeros(0, int)])
                many = np.bincount(codes * size + truth)
                seen = np.flatnonzero(many)
                model.append(np.full(len(seen), k, np.int32))
                code.append((seen // size).astype(np.int32))
                true.append(seen % size)
                n.append(many[seen].astype(np.int64))
            model, code, true, n = map(np.concatenate, (model, code, true, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(model), pa.array(code), y.dictionary.take(pa.array(true)), pa.array(n)], ["model", "code", "y", "n"])

    if arrays:
        rows = df.select(quoted(label).cast("string").alias("y"), *[number(c).alias(f"x{i}") for i, c in enumerate(names)])
        scored = cut_lineage(rows.mapInArrow(counted, "model int, code int, y string, n long")
                             .groupBy("model", "code", "y").agg(F.sum("n").alias("n")))
    out = []
    for k, score, *_ in parts:
        if score is None:
            out.append(cut_lineage(evaluate.confusion_counts(found[k].predict(df), label, "predicted_label")))
        else:
            mine = decode_labels(scored.where(F.col("model") == k), found[k].codes, "code", "predicted_label")
            out.append(evaluate.confusion_counts(mine, "y", "predicted_label", "n"))
    return out


def train_and_report(
    train: DataFrame, test: DataFrame, label: str = "Label", mode: str = "all",
    kind: str = "forest", payload: bool = False, **opt,
) -> tuple[FlowModel, DataFrame]:
    """Align, impute, select, fit on train with the labels of both sets, report on test.

    ``payload`` keeps only the classes the payload path can tell apart.
    """
    if payload:
        train, test = payload_classes_only(train, label)[0], payload_classes_only(test, label)[0]
    train, test = align_columns(train, test)
    columns = [c for c in train.columns if c != label and isinstance(
        train.schema[c].dataType, T.NumericType)]
    train, test = impute_own_median(train, columns), impute_own_median(test, columns)
    kept = select_features(train, columns, mode, label, trees=opt.get("trees", 100))
    codes = label_codes(label_set(train, test, label=label), label)
    model = fit_model(train, kept, label, kind, codes, **opt)
    counts = evaluate.confusion_counts(model.predict(test), label, "predicted_label")
    return model, evaluate.classification_report(counts, sorted(codes))
