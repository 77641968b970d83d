import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwire.operators import evaluate, joins, knn, models, select
from fieldwire.operators.models import sweep_features


def brute(train, test, k):
    out = {}
    for tid, tv in test:
        near = sorted((float(np.sqrt(((np.array(tv) - np.array(v)) ** 2).sum())), i) for i, v in train)
        out[tid] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("block_rows,pivots", [(4096, 8), (16, 5), (16, 1)])
def test_knn_is_exact_with_a_third_of_copies(spark, block_rows, pivots):
    rng = random.Random(2)
    point = lambda: [rng.gauss(0, 1) for _ in range(4)]
    copy = point()
    train = [(i, copy if i % 3 == 0 else point()) for i in range(240)]
    test = [(1000 + i, copy if i == 0 else point()) for i in range(40)]
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>"
    rows = knn.knn(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), 5,
                   pivots=pivots, block_rows=block_rows).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert got == brute(train, test, 5)


def test_knn_with_fewer_rows_than_k(spark):
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>"
    train = spark.createDataFrame([(1, [0.0]), (2, [5.0])], schema)
    test = spark.createDataFrame([(9, [4.0])], schema)
    assert [r["neighbour"] for r in knn.knn(train, test, 5).orderBy("rank").collect()] == [2, 1]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = rng.choice("abc")
        good = "abc".index(y) + rng.random()
        noise = [rng.random() for _ in range(16)]
        rows.append((y, 1.0, good, good * 3 + 1e-3 * rng.random(), *noise))
    names = ["flat", "good", "twin"] + [f"n{i}" for i in range(16)]
    return spark.createDataFrame(rows, ", ".join(["Label STRING"] + [f"{n} DOUBLE" for n in names])).cache(), names


def test_selection_modes(wide):
    df, names = wide
    pick = lambda mode: select.select_features(df, names, mode, trees=10)
    assert pick("all") == names
    assert pick("variance") == names[1:]
    assert set(pick("top-2")) == {"good", "twin"}
    assert "twin" not in pick("corr-5") and "good" in pick("corr-1")
    assert pick("smart-1") == ["good"] and len(pick("smart-99")) == len(names) - 2
    for bad in ("top", "best-3", "top-x"):
        with pytest.raises(ValueError):
            pick(bad)


def test_correlation_paths_agree(wide):
    df, names = wide
    few = names[1:10]
    assert select.correlated_columns(df, few) == ["twin"]
    assert select.correlated_columns(df, names[1:]) == ["twin"]
    assert select.correlated_columns(df, names) == ["twin"]


def test_scores_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y_true STRING, y_pred STRING")
    counts = evaluate.confusion_counts(df)
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in
           evaluate.per_class(counts, ["a", "b", "c", "z"]).collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (0.0, 0.0, 0), "c": (0.0, 0.0, 1), "z": (0.0, 0.0, 0)}
    m = {r["y_true"]: tuple(r)[1:] for r in evaluate.confusion_matrix(counts, ["a", "b", "c", "z"]).collect()}
    assert m == {"a": (1, 1, 0, 0), "b": (0, 0, 0, 0), "c": (1, 0, 0, 0), "z": (0, 0, 0, 0)}
    one = spark.createDataFrame([(1, 0.5)], "y_true INT, score DOUBLE")
    assert evaluate.roc_auc(one).first()[0] is None


def test_roc_with_ties(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.choice([-2.5, 0.0, 0.25, 0.5, 1e6])) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = evaluate.roc_auc(spark.createDataFrame(rows, "y_true INT, score DOUBLE")).first()[0]
    assert got == pytest.approx(want, abs=5e-5)


def test_overlapping_attack_runs(spark):
    rng = random.Random(6)
    runs = [(rng.choice("ABC"), s := rng.randrange(1000), s + rng.randrange(-1, 300)) for _ in range(25)]
    flows = [(i, rng.randrange(-50, 1300)) for i in range(300)] + [(900 + i, r[1]) for i, r in enumerate(runs)] + [
        (950 + i, r[2]) for i, r in enumerate(runs)]
    want = {}
    for i, t in flows:
        hit = [(-s, label) for label, s, e in runs if s <= t <= e]
        want[i] = min(hit)[1] if hit else "NORMAL"
    out = joins.label_by_window(
        spark.createDataFrame(flows, "id LONG, ts_us LONG"),
        spark.createDataFrame(runs, "label STRING, start_us LONG, stop_us LONG"), chunk_us=64)
    assert {r["id"]: r["label"] for r in out.select("id", F.col("label")).collect()} == want


def test_comparisons_score_every_row_that_is_not_fitted(spark, monkeypatch):
    from fieldwire.plans import queries

    folder, seen = "/root/testdata/sf0.001", {}
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()

    def record(name, columns):
        def run(train, test, *args, whole=None, **opt):
            seen[name] = (train.count(), test.count(), train.join(test, "row", "left_semi").count(),
                          rows if whole is None else whole.count())
            return spark.range(0).selectExpr(*[f"{c}" for c in columns])
        return run

    monkeypatch.setattr(queries.models, "compare_models", record("compare", ["'' AS model", "1L AS rows", "1.0D AS accuracy", "1.0D AS f1"]))
    monkeypatch.setattr(queries.models, "sweep_features", record("sweep", ["'' AS mode", "1L AS rows", "1 AS features", "1.0D AS accuracy"]))
    queries.compare_models(spark, folder)
    queries.sweep_features(spark, folder)
    for fitted, scored, both, whole in seen.values():
        assert 0 < fitted < 3000 and fitted + scored == rows and both == 0 and whole == rows


def test_selection_statistics_of_the_whole(spark):
    rows = spark.range(400).selectExpr(
        "cast(id % 2 as string) AS Label", "cast(id % 2 as double) AS a", "cast(id >= 100 as double) AS late", "id")
    train, test = rows.where("id < 100"), rows.where("id >= 100")
    kept = lambda **opt: sweep_features(train, test, ["a", "late"], modes=["variance"], kind="tree", **opt).first()["features"]
    assert kept() == 1 and kept(whole=rows) == 2


def three_classes(spark, parts=1):
    return spark.range(0, 900, 1, parts).selectExpr(
        "array('A', 'B', 'C')[id % 3] AS Label", "cast(id % 3 + (id * 7919 % 997) / 600 as double) AS a",
        "cast(id * 31 % 101 as double) AS b", "cast(id % 2 * 5 + id % 7 as double) AS c")


@pytest.mark.parametrize("kind,opt", [("forest", {"trees": 12, "depth": 9}), ("boost", {"trees": 5, "depth": 4}),
                                      ("mlp", {"hidden": (7, 5), "max_iter": 20}), ("svm", {"rff": 16, "max_iter": 10})])
def test_array_scores_are_those_of_sparks_models(spark, monkeypatch, kind, opt):
    df = three_classes(spark)
    df = df if kind in ("forest", "mlp") else df.withColumn("Label", F.when(df.Label == "B", "ATTACK").otherwise("NORMAL"))
    model = models.fit_model(df, ["a", "b", "c"], kind=kind, **opt)
    both = []
    for way in (models.scorer, lambda *_: None):
        monkeypatch.setattr(models, "scorer", way)
        out = model.predict(df, keep_code=True)
        assert ("ArrowEvalPython" in out._jdf.queryExecution().toString()) == (not both or kind == "svm")
        both.append((out.columns, out.orderBy("a", "b", "c").collect()))
    assert both[0][0] == both[1][0]
    for x, y in zip(both[0][1], both[1][1]):
        assert (x.predicted_label, x.code) == (y.predicted_label, y.code)
        assert x.conf == y.conf is None or x.conf == pytest.approx(y.conf, abs=1e-9)
        if kind != "svm":
            assert list(x.probabilities) == pytest.approx(list(y.probabilities), abs=1e-9)


def test_tasks_of_a_fit_follow_its_rows(spark, monkeypatch):
    """A large table leaves few rows in many partitions, and a fit has hundreds of passes."""
    seen, plain = [], models.classifier

    def classifier(*args, **opt):
        est = plain(*args, **opt)
        fit = est.fit
        monkeypatch.setattr(est, "fit", lambda df: (seen.append(df.rdd.getNumPartitions()), fit(df))[1])
        return est

    monkeypatch.setattr(models, "classifier", classifier)
    models.fit_model(three_classes(spark, 40), ["a", "b", "c"], kind="tree")
    monkeypatch.setattr(models, "FIT_TASK_ROWS", 100)
    models.fit_model(three_classes(spark, 40), ["a", "b", "c"], kind="tree")
    assert seen == [1, 9]


@pytest.mark.parametrize("block_rows", [4096, 64])
def test_neighbours_of_equal_and_huge_vectors(spark, block_rows):
    rng = random.Random(5)
    train = [(i, [float(rng.randrange(3)) for _ in range(3)] if i % 4 else [1e200, 0.0, float(i)]) for i in range(200)]
    test = [(1000 + i, [float(rng.randrange(3)) + 1e-9, 0.0, 1.0]) for i in range(20)] + [(2000, [1e200, 0.0, 3.0])]
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>"
    with np.errstate(over="ignore"):
        rows = knn.knn(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), 5, block_rows=block_rows).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["vec_id"], []).append(r["neighbour"])
        assert got == brute(train, test, 5)


def test_matrix_products_name_the_neighbours(monkeypatch):
    """Distances by difference are computed for few pairs, and what is found is what all differences give."""
    rng = np.random.default_rng(3)
    have, tests = rng.normal(size=(500, 64)) + 1e4, rng.normal(size=(40, 64)) + 1e4
    have[400:] = have[0]
    tests[0] = have[0]
    d = knn._distances(tests, have)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    who, pick, dist = knn._nearest(tests, have, 5)
    assert (pick.reshape(40, 5) == want).all() and (dist.reshape(40, 5) == np.take_along_axis(d, want, axis=1)).all()


def test_scored_flows_are_made_once(spark, monkeypatch):
    from fieldwire.plans import queries

    seen, plain = [], queries.models.fit_model
    monkeypatch.setattr(queries.models, "fit_model", lambda train, *a, **o: (seen.append(train), plain(train, *a, **o))[1])
    out = queries.scored_flows(spark, "/root/testdata/sf0.001")
    assert all("events.parquet" not in df._jdf.queryExecution().toString() for df in (*seen, out)) and seen


def test_modes_share_statistics_of_the_whole(wide, monkeypatch):
    df, names = wide
    calls, known = [], {}
    for name in ("varying_columns", "correlated_columns"):
        monkeypatch.setattr(select, name, lambda *a, name=name, plain=getattr(select, name): (calls.append(name), plain(*a))[1])
    kept = [select.select_features(df, names, mode, trees=3, known=known) for mode in ("variance", "smart-1", "smart-99")]
    assert sorted(calls) == ["correlated_columns", "varying_columns"]
    assert kept == [select.select_features(df, names, mode, trees=3) for mode in ("variance", "smart-1", "smart-99")]


def test_payload_tree_is_fitted_on_all_records(spark, monkeypatch, tmp_path):
    """However few rows other models are fitted on; a record's class comes from the events in it."""
    from fieldwire.plans import queries
    from fieldwire.plans.sessions import payload_sessions

    kinds = "array('view', 'purchase', 'click', 'signup', 'error', 'view')"
    spark.range(600).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 7200000000) AS ts", "id * id % 40 AS user_id",
        f"IF(id % 97 = 96, NULL, {kinds}[cast(id * 7 % 11 % 6 as int)]) AS event_type", "1.5D AS value", "'{}' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "FIT_ROWS", 30)
    seen, plain = [], queries.models.fit_model
    monkeypatch.setattr(queries.models, "fit_model", lambda train, *a, **o: (seen.append(train.collect()), plain(train, *a, **o))[1])
    queries.payload_tree(spark, str(tmp_path))
    all_records = payload_sessions(queries.packets(spark, str(tmp_path)), 4 * queries.HOUR, chunk_us=queries.DAY).count()
    assert len(seen[0]) == all_records > 200
    assert all((r.Label == "COLD_RESTART") == (r.attack_fc_count > 0) for r in seen[0])
    assert {r.Label for r in seen[0]} == {"COLD_RESTART", "NORMAL"}


def test_a_tree_of_all_cuts_sees_every_row(spark):
    rows = spark.range(0, 30_000, 1, 2).selectExpr("id", "IF(id = 17003, 'ATTACK', 'NORMAL') AS Label", "cast(id = 17003 as double) AS x", "cast(id % 7 as double) AS y")
    model = models.fit_model(rows, ["x", "y"], kind="tree", all_cuts=True)
    assert [r.id for r in model.predict(rows).where("predicted_label = 'ATTACK'").collect()] == [17003]


@pytest.mark.parametrize("kind,opt", [("tree", {"depth": 5}), ("forest", {"trees": 5, "depth": 4}), ("logistic", {"max_iter": 20})])
def test_confusions_are_those_of_predictions(spark, kind, opt):
    df = three_classes(spark)
    found = [models.fit_model(df, names, kind=kind, **opt) for names in (["a", "b", "c"], ["c", "a"], ["b"])]
    odd = df.selectExpr("IF(b = 7, NULL, IF(b = 9, 'NEW', Label)) AS Label", "CASE WHEN c = 3 THEN NULL WHEN c = 4 THEN double('nan') ELSE a END AS a",
                        "IF(b = 50, 'x', concat(' ', b)) AS b", "IF(b = 20, double('inf'), c) AS c")
    for model, counts in zip(found, models.confusions(found, odd)):
        want = evaluate.confusion_counts(model.predict(odd), "Label", "predicted_label")
        assert counts.columns == want.columns
        assert sorted(map(str, counts.collect())) == sorted(map(str, want.collect()))
    assert all(c.count() == 0 for c in models.confusions(found[:2], df.limit(0)))


def test_a_sweep_reads_the_rows_to_score_once(spark):
    n = spark.sparkContext.accumulator(0)
    rows = spark.range(400).selectExpr("cast(id % 2 as string) AS Label", "cast(id % 2 as double) AS a", "cast(id % 5 as double) AS b", "id")

    def passing(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    test = rows.where("id >= 100")
    out = sweep_features(rows.where("id < 100"), test.mapInArrow(passing, test.schema), ["a", "b"], modes=["all", "variance", "top-1"], kind="tree")
    assert [(r["mode"], r["rows"], r["accuracy"]) for r in out.collect()] == [("all", 300, 1.0), ("variance", 300, 1.0), ("top-1", 300, 1.0)]
    assert n.value == 300


def test_cells_find_the_neighbours():
    rng = np.random.default_rng(8)
    for have, tests in ((rng.normal(size=(700, 3)), rng.normal(size=(900, 3)) * 2), (rng.integers(0, 4, (600, 2)) * 1.0, rng.integers(0, 5, (300, 2)) * 1.0),
                        (np.ones((50, 2)), np.zeros((9, 2))), (rng.normal(size=(3, 2)), rng.normal(size=(5, 2)))):
        for x, y in zip(knn.Cells(have, 5).nearest(tests), knn._nearest(tests, have, 5)):
            assert (x == y).all()


def test_neighbours_vote_where_a_row_is(spark):
    rng = random.Random(4)
    point = lambda: [float(rng.randrange(4)), float(rng.randrange(4))]
    train = spark.createDataFrame([(i, rng.choice(["a", "b", None, "c"]), point()) for i in range(90)], "vec_id LONG, label STRING, embedding ARRAY<DOUBLE>")
    test = spark.createDataFrame([(i // 2, point()) for i in range(0, 120, 2)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    want = {r.vec_id: r.prediction for r in knn.knn_classify(train, test, 5).collect()}
    for rows in (4096, 32):
        out = knn.knn_predict(train, test, 5, block_rows=rows)
        assert {r.vec_id: r.prediction for r in out.collect()} == want and len(want) == 60
        assert ("Join" in out._jdf.queryExecution().toString()) == (rows == 32)


def test_models_are_compared_on_rows_read_once(spark):
    n = spark.sparkContext.accumulator(0)
    rows = three_classes(spark).where("Label <> 'C'").selectExpr("IF(Label = 'A', 'ATTACK', 'NORMAL') AS Label", "a", "b", "c", "monotonically_increasing_id() AS id")
    train, test = rows.where("id % 3 = 0").localCheckpoint(), rows.where("id % 3 > 0").localCheckpoint()

    def passing(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    kinds = {"t": ("tree", {"depth": 2}), "l": ("logistic", {"max_iter": 5}), "s": ("svm", {"rff": 8, "max_iter": 5})}
    found = {r["model"]: r for r in models.compare_models(
        train, test.mapInArrow(passing, test.schema), ["b", "c"], models=kinds, row_id="id").collect()}
    assert [*found] == ["t", "l", "s", "KNN (k=5)"] and {r["rows"] for r in found.values()} == {test.count()} == {n.value}
    for name, (kind, opt) in kinds.items():
        out = models.fit_model(train, ["b", "c"], kind=kind, codes={"NORMAL": 0, "ATTACK": 1}, **opt).predict(test, keep_code=True)
        assert found[name]["accuracy"] == evaluate.metrics(evaluate.confusion_counts(out, "Label", "predicted_label"), "binary", "ATTACK").first()["accuracy"]
        want = evaluate.roc_auc(out.selectExpr("int(Label = 'ATTACK') AS y_true", "probabilities[1] AS score")).first()[0] if kind != "svm" else None
        assert found[name]["roc_auc"] == want
