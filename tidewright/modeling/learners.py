"""The learners by name, as Spark ML pipelines over named feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..schema import TableError, numeric_columns, q, require
from .boosting import fit_softmax_trees
from .sigmoid import Sigmoids, fit_sigmoids, held_out_margins

CLASSIFIERS = (
    "random_forest_classifier",
    "logistic_regression",
    "gradient_boosting_classifier",
    "svc",
    "knn_classifier",
    "decision_tree_classifier",
)
REGRESSORS = (
    "random_forest_regressor",
    "linear_regression",
    "ridge_regression",
    "lasso_regression",
    "gradient_boosting_regressor",
    "svr",
    "knn_regressor",
    "decision_tree_regressor",
)
SEED = 42
MAX_ITER = 1000
TREES = 100
MAX_DEPTH = 30  # the deepest that Spark's trees go
NEIGHBORS = 5


def resolve(name: str, problem: str) -> str:
    """Full name of a learner: short names depend on the problem type."""
    known = CLASSIFIERS if problem == "classification" else REGRESSORS
    ending = "classifier" if problem == "classification" else "regressor"
    for candidate in (name, f"{name}_{ending}", f"{name}_regression"):
        if candidate in known:
            return candidate
    if name == "svm":
        return "svc" if problem == "classification" else "svr"
    raise TableError(f"unknown {problem} algorithm {name!r}; known: {known}")


def _dense_vectors(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as vectors in the form in which columns hold them, without an object for each."""
    n, width = rows.shape
    values = pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1], pa.array(rows.ravel()))
    kind, none = pa.array(np.ones(n, dtype=np.int8)), pa.nulls(n, pa.int32())
    return pa.StructArray.from_arrays([kind, none, pa.nulls(n, pa.list_(pa.int32())), values], ["type", "size", "indices", "values"])


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: a linear learner on them approximates an RBF kernel."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, size=256, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.arrow_udf(VectorUDT())
        def lift(values: pa.Array) -> pa.Array:
            n = len(values)
            flat = np.empty((0, size))
            if n:
                x = values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                rng = np.random.default_rng(seed)
                w = rng.normal(0.0, np.sqrt(2 * gamma), (x.shape[1], size))
                b = rng.uniform(0.0, 2 * np.pi, size)
                flat = np.sqrt(2 / size) * np.cos(x @ w + b)
            return _dense_vectors(flat)

        return df.withColumn(self.getOutputCol(), lift(vector_to_array(self.getInputCol())))


def _kernel_width(df: DataFrame, features: Sequence[str]) -> float:
    """The scale rule: 1 / (features x variance of all feature values)."""
    row = df.agg(
        *[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.avg(q(c).cast("double") * q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    d = len(features)
    mean = sum(row[f"m{i}"] for i in range(d)) / d
    variance = sum(row[f"s{i}"] for i in range(d)) / d - mean * mean
    return 1 / (d * variance) if variance > 0 else 1.0


def estimator(name: str, rows: int, classes: int = 2, spread: float = 1.0, **params: Any):
    """The Spark learner of a name; `rows` converts a penalty on sums into one on means.

    Spark also divides the squared penalty by the deviation of the target, so ridge regression
    multiplies it back (`spread`).
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    trees = params.get("trees", TREES)
    tree = {"maxDepth": params.get("max_depth") or MAX_DEPTH, "minInstancesPerNode": params.get("min_samples_leaf", 1), "seed": SEED}
    # Every row keeps its node in each tree, else it would walk down from the root of all trees again at each level.
    forest = {"numTrees": trees, "cacheNodeIds": True, "checkpointInterval": -1}
    if name == "random_forest_classifier":
        return RandomForestClassifier(**forest, **tree, **common)
    if name == "random_forest_regressor":
        return RandomForestRegressor(**forest, **tree, **common)
    if name == "decision_tree_classifier":
        return DecisionTreeClassifier(**tree, **common)
    if name == "decision_tree_regressor":
        return DecisionTreeRegressor(**tree, **common)
    boost = {"maxIter": trees, "maxDepth": params.get("max_depth", 3), "stepSize": params.get("learning_rate", 0.1), "seed": SEED}
    if name == "gradient_boosting_classifier":
        return GBTClassifier(**boost, **common)
    if name == "gradient_boosting_regressor":
        return GBTRegressor(**boost, **common)
    if name == "logistic_regression":
        # C weighs the sum of losses, regParam their mean.
        penalty = 1 / (params.get("C", 1.0) * max(rows, 1))
        mix = 1.0 if params.get("penalty") == "l1" else 0.0
        return LogisticRegression(
            maxIter=params.get("max_iter", MAX_ITER), tol=1e-4, regParam=penalty, elasticNetParam=mix, standardization=False, **common
        )
    if name == "svc":
        one = LinearSVC(maxIter=params.get("max_iter", MAX_ITER), tol=1e-3, regParam=1 / (params.get("C", 1.0) * max(rows, 1)), **common)
        return one if classes == 2 else OneVsRest(classifier=one, parallelism=4, **common)
    if name == "svr":
        return LinearRegression(loss="huber", maxIter=params.get("max_iter", MAX_ITER), regParam=1 / (params.get("C", 1.0) * max(rows, 1)), **common)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, solver="normal", **common)
    if name == "ridge_regression":
        return LinearRegression(
            regParam=params.get("alpha", 1.0) * spread / max(rows, 1), elasticNetParam=0.0, standardization=False, solver="normal", **common
        )
    if name == "lasso_regression":
        return LinearRegression(
            regParam=params.get("alpha", 1.0), elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=MAX_ITER, **common
        )
    raise TableError(f"no Spark learner named {name!r}")


def feature_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Check that the features are numeric and free of gaps."""
    features = require(df, features)
    usable = numeric_columns(df, booleans=True)
    wrong = [c for c in features if c not in usable]
    if wrong:
        raise TableError(f"features are not numeric, encode them first: {wrong}")
    return df


def fit(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, weight: str | None = None, **params: Any
) -> PipelineModel:
    """Fit a learner; the model turns tables with the feature columns into predictions."""
    features = list(features)
    feature_frame(df, features)
    data = df.na.drop(subset=[*features, target])
    rows = data.count()
    if rows < 10:
        raise TableError(f"10 complete rows are needed, got {rows}")
    classify = algorithm in CLASSIFIERS
    assembler = VectorAssembler(inputCols=features, outputCol="raw_features")
    stages: list = [assembler]
    labels: list[str] = []
    if classify:
        index = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(data)
        labels = list(index.labels)
        if len(labels) < 2:
            raise TableError("the target has a single value")
        labelled = index.transform(data)
    else:
        labelled = data.withColumn("label", q(target).cast("double"))
    if algorithm in ("svc", "svr") and params.get("kernel", "rbf") != "linear":
        gamma = params.get("gamma", "scale")
        width = _kernel_width(data, features) if gamma == "scale" else 1 / len(features) if gamma == "auto" else float(gamma)
        stages.append(FourierFeatures(inputCol="raw_features", outputCol="features", gamma=float(width)))
    else:
        assembler.setOutputCol("features")
    if algorithm == "gradient_boosting_classifier" and len(labels) > 2:
        options = {"rounds": params.get("trees", TREES), "depth": params.get("max_depth") or 3, "rate": params.get("learning_rate", 0.1)}
        boosted = fit_softmax_trees(labelled, features, len(labels), weight=weight, **options)
        return PipelineModel([*stages, boosted, IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)])
    spread = 1.0
    if algorithm == "ridge_regression":
        spread = labelled.agg(F.stddev_pop("label")).first()[0] or 1.0
    learner = estimator(algorithm, rows, len(labels) or 2, spread, **params)
    if weight is not None:
        learner.setWeightCol(weight)
    if algorithm == "svc" and params.get("probability", True):
        columns = [c.name for c in labelled.schema if c.name in (*features, "label", weight)]
        narrow = labelled.select(*[q(c) for c in columns]).persist()
        try:
            margins = held_out_margins(narrow, features, lambda part: Pipeline(stages=[*stages, learner]).fit(part))
            curves = fit_sigmoids(margins, len(labels))
            fitted = Pipeline(stages=[*stages, learner]).fit(narrow).stages
        finally:
            narrow.unpersist()
        return PipelineModel([*fitted, curves, IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)])
    stages.append(learner)
    if classify:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels))
    return Pipeline(stages=stages).fit(labelled)


def label_model(labels: Sequence[str], target: str) -> StringIndexerModel:
    return StringIndexerModel.from_labels(list(labels), inputCol=target, outputCol="label", handleInvalid="keep")


def learner_of(model: PipelineModel):
    """The fitted learner stage."""
    return next(s for s in reversed(model.stages) if not isinstance(s, (IndexToString, VectorAssembler, FourierFeatures, Sigmoids)))


def predict_batch(model: PipelineModel, df: DataFrame, features: Sequence[str], probabilities: bool = False, check: bool = True) -> DataFrame:
    """Add `prediction` and `confidence`; gaps and non-numeric features are refused.

    Confidence is the largest class probability, or the largest margin of learners without one (support vector machines fitted with
    `probability=False`).
    """
    feature_frame(df, features)
    if check:
        gap = F.lit(False)
        for c in features:
            gap = gap | q(c).isNull()
        if not df.filter(gap).isEmpty():
            raise TableError("features hold missing values")
    scored = model.transform(df)
    out = [q(c) for c in df.columns]
    if "predicted_label" in scored.columns:
        out.append(F.col("predicted_label").alias("prediction"))
        if "probability" in scored.columns:
            share = vector_to_array("probability")
            out.append(F.array_max(share).alias("confidence"))
            if probabilities:
                out.append(share.alias("probabilities"))
        else:
            out.append(F.array_max(F.transform(vector_to_array("rawPrediction"), F.abs)).alias("confidence"))
    else:
        out.append(F.col("prediction"))
    return scored.select(*out)


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """`(feature, importance)`: of trees, or absolute coefficients averaged over classes."""
    learner = learner_of(model)
    if hasattr(learner, "featureImportances"):
        values = learner.featureImportances.toArray()
    elif hasattr(learner, "coefficientMatrix"):
        values = np.abs(learner.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(learner, "coefficients"):
        values = np.abs(learner.coefficients.toArray())
    else:
        raise TableError("this learner has no importances of its own; use the substitution importance")
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
