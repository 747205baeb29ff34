import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidewright.functions.draws import Draws
from tidewright.functions.hashing import row_hash
from tidewright.modeling import learners, training
from tidewright.operators import evaluate, explain
from tidewright.schema import TableError
from tidewright.session import scratch_path

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    cls = (0.5 * x[:, 0] + 0.3 * x[:, 1] - 0.2 * x[:, 2] + rng.normal(0, 0.1, 300) > 0).astype(int)
    reg = 2.5 * x[:, 0] + 1.8 * x[:, 1] - 1.2 * x[:, 2] + rng.normal(0, 0.5, 300)
    rows = [(i, *map(float, x[i]), int(cls[i]), float(reg[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, c int, r double").repartition(2).cache()


@pytest.mark.parametrize("name", ["logistic_regression", "decision_tree_classifier", "svc", "random_forest_classifier", "gradient_boosting_classifier"])
def test_classifiers(data, name):
    out = learners.predict_batch(learners.fit(data, FEATURES, "c", name, max_iter=50, trees=10), data, FEATURES)
    right = out.filter(F.col("prediction") == F.col("c").cast("string")).count()
    assert right > 270 and out.filter("confidence is null").count() == 0


@pytest.mark.parametrize("name", ["linear_regression", "svr", "decision_tree_regressor", "random_forest_regressor", "gradient_boosting_regressor"])
def test_regressors(data, name):
    model = learners.fit(data, FEATURES, "r", name, max_iter=100, trees=20)
    assert evaluate.regression_metrics(model.transform(data), "r", "prediction")["r2_score"] > 0.7


def test_ridge_closed_form(data):
    model = learners.learner_of(learners.fit(data, FEATURES, "r", "ridge_regression", alpha=50.0))
    rows = data.select(*FEATURES, "r").toPandas().to_numpy()
    x, y = rows[:, :3] - rows[:, :3].mean(axis=0), rows[:, 3] - rows[:, 3].mean()
    want = np.linalg.solve(x.T @ x + 50 * np.eye(3), x.T @ y)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_refusals(spark, data):
    with pytest.raises(TableError):
        learners.fit(data.limit(5), FEATURES, "c", "logistic_regression")
    with pytest.raises(TableError):
        learners.fit(data.withColumn("c", F.lit(1)), FEATURES, "c", "logistic_regression")
    model = learners.fit(data, FEATURES, "c", "decision_tree_classifier")
    with pytest.raises(TableError):
        learners.predict_batch(model, data.withColumn("x1", F.lit(None).cast("double")), FEATURES)
    with pytest.raises(TableError):
        learners.predict_batch(model, data.withColumn("x1", F.lit("a")), FEATURES)
    assert learners.resolve("random_forest", "regression") == "random_forest_regressor"
    assert learners.resolve("ridge", "regression") == "ridge_regression"
    with pytest.raises(TableError):
        learners.resolve("ridge", "classification")


def test_save_and_load(spark, data):
    for name, target in (("svc", "c"), ("decision_tree_regressor", "r")):
        model = learners.fit(data, FEATURES, target, name, max_iter=20)
        again = learners.load_model(learners.save_model(model, scratch_path(spark, "model")))
        a = learners.predict_batch(model, data, FEATURES).orderBy("id").select("prediction").collect()
        assert a == learners.predict_batch(again, data, FEATURES).orderBy("id").select("prediction").collect()


def test_selection_goes_on_after_a_failure(data):
    names = ["linear_regression", "decision_tree_regressor", "lasso_regression"]
    found = training.automl_select(data, FEATURES, "r", "id", names, folds=2, overrides={"lasso_regression": {"alpha": -1.0}})
    board = {e["algorithm"]: e for e in found["leaderboard"]}
    assert board["lasso_regression"]["status"] == "failed"
    assert found["problem"] == "regression" and found["best"]["algorithm"] == "linear_regression"


def test_selection_fits_its_learners_together(data, monkeypatch):
    """The first fit of either learner waits for the first one of the other."""
    met, lock, begun, plain = threading.Barrier(2), threading.Lock(), set(), training._trained

    def trained(df, features, target, algorithm, *more, **params):
        with lock:
            first = algorithm not in begun
            begun.add(algorithm)
        if first:
            met.wait(60)
        return plain(df, features, target, algorithm, *more, **params)

    monkeypatch.setattr(training, "_trained", trained)
    found = training.automl_select(data, FEATURES, "r", "id", ["linear", "ridge"], folds=2)
    assert [e["status"] for e in found["leaderboard"]] == ["ok", "ok"], found


def test_selection_of_many_rows_starts_fewer_fits_at_once(spark):
    slots = max(training.PARALLEL_FITS, spark.sparkContext.defaultParallelism)
    assert training._fits_at_once(spark, 0) == training._fits_at_once(spark, training.SLOT_ROWS) == slots
    assert training._fits_at_once(spark, 10**9) == training.LEAST_FITS


def test_every_row_is_predicted_once(data):
    """The median error reads the predictions several times; the model reads the rows once."""
    read = data.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def predicted(x):
        read.add(1)
        return 2.0 * x

    found = training.evaluate(data.withColumn("prediction", predicted("x1")), "r", "regression")
    assert read.value == 300
    y, p = np.array(data.select("r", 2 * F.col("x1")).collect()).T
    assert found["r2_score"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert found["median_absolute_error"] == pytest.approx(np.median(np.abs(y - p)), rel=1e-2)


def test_forests_keep_the_node_of_each_row(data):
    """The trees are those of a forest that walks down from its roots at each level."""
    learner = learners.estimator("random_forest_regressor", 300, trees=5)
    assert learner.getCacheNodeIds()
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data.withColumn("label", F.col("r")))
    kept, walked = learner.fit(rows), learner.copy({learner.cacheNodeIds: False}).fit(rows)
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_fourier_features_are_cosines(spark, data):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(data)
    lift = learners.FourierFeatures(inputCol="x", outputCol="z", gamma=0.3, size=16)
    found = lift.transform(rows).select("x", "z").collect()
    rng = np.random.default_rng(learners.SEED)
    w = rng.normal(0.0, np.sqrt(0.6), (3, 16))
    b = rng.uniform(0.0, 2 * np.pi, 16)
    for r in found:
        assert r["z"].toArray() == pytest.approx(np.sqrt(2 / 16) * np.cos(r["x"].toArray() @ w + b), abs=1e-12)
    assert lift.transform(rows.limit(0)).collect() == []


def test_tuning_keeps_the_best(data):
    found = training.tune_grid(data, FEATURES, "r", "decision_tree_regressor", "id", {"max_depth": [1, 4]}, 2)
    assert len(found["trials"]) == 2 and found["params"] == {"max_depth": 4}
    assert training.reduced_grid({"a": [1, 2, 3, 4, 5]}) == {"a": [1, 3, 5]}


def test_attributions_of_a_linear_model(data):
    model = learners.fit(data, FEATURES, "r", "linear_regression")
    weights = dict(zip(FEATURES, learners.learner_of(model).coefficients.tolist()))
    exact = {(r["id"], r["feature"]): r["shap"] for r in explain.shap_linear(data, "id", weights).collect()}
    sampled = explain.shap_sampling(model, data, "id", FEATURES, 4).collect()
    assert len(sampled) == 900
    for r in sampled:
        assert r["shap"] == pytest.approx(exact[r["id"], r["feature"]], abs=1e-8)
    for r in explain.mean_substitution_importance(model, data, "id", FEATURES).collect():
        assert r["importance"] == pytest.approx(abs(exact[r["id"], r["feature"]]), abs=1e-8)
    spread = data.select(*[F.stddev_pop(c) for c in FEATURES]).first()
    for r in explain.lime_local(model, data.limit(5), "id", FEATURES, 60).collect():
        assert np.sign(r["weight"]) == np.sign(weights[r["feature"]])
    assert len(spread) == 3


def test_binary_and_weighted_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    assert evaluate.classification_metrics(df, "y", "p") == pytest.approx({"accuracy": 0.75, "precision": 1.0, "recall": 0.5, "f1_score": 2 / 3})
    never = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert evaluate.classification_metrics(never, "y", "p")["precision"] == 0.0


def test_selection_takes_neighbours_along(spark):
    rows = [(i, float(i % 7), float(i % 5), "big" if i % 7 > 3 else "small", 2.0 * (i % 7) - (i % 5)) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind string, y double")
    for target, algorithms in (("kind", ["knn", "decision_tree"]), ("y", ["knn", "linear"])):
        found = training.automl_select(df, ["a", "b"], target, "id", algorithms, folds=2)
        assert [e["status"] for e in found["leaderboard"]] == ["ok", "ok"], found
        # Every point has copies of itself on both sides of each fold.
        assert all(e["cv_score"] > 0.9 for e in found["leaderboard"])


def test_draws_are_row_hashes(spark):
    keys = [None, "7", "x" * 30, "y" * 80]
    rows = spark.createDataFrame([(k, i, j) for k in keys for i in (0, 9, 10, 120) for j in range(4)], "k string, i int, j int")
    want = rows.select("k", "i", "j", row_hash(F.col("k"), F.col("i"), F.col("j"), seed=5).alias("h")).collect()
    drawn = Draws(121, 4, 5)
    held = {k: drawn.of(k) for k in keys}
    assert all(held[r["k"]][r["i"], r["j"]] == r["h"] for r in want)


@pytest.mark.parametrize("target, algorithm", [("number", "linear_regression"), ("two", "logistic_regression"), ("three", "logistic_regression")])
def test_local_fits_of_linear_models_make_no_rows(spark, monkeypatch, target, algorithm):
    rows = [(None if i == 3 else i // 2, float(i % 7), float(i % 5), i * 0.5, i % 2, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, number double, two int, three int")
    model = learners.fit(df, ["a", "b"], target, algorithm)
    quick = explain.lime_local(model, df, "id", ["a", "b"], 50).collect()
    assert len(quick) == 2 * len({r[0] for r in rows})
    monkeypatch.setattr(explain, "_linear_score", lambda *_: None)
    slow = {(r["id"], r["feature"]): r["weight"] for r in explain.lime_local(model, df, "id", ["a", "b"], 50).collect()}
    assert all(abs(slow[r["id"], r["feature"]] - r["weight"]) < 1e-9 for r in quick)
    monkeypatch.undo()
    monkeypatch.setattr(explain, "_scored_sums", None)
    assert explain.lime_local(model, df.filter("id = 1"), "id", ["a", "b"], 50).count() == 2
