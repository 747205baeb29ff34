"""Attributions of predictions to features."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.draws import Draws
from ..functions.hashing import SPAN, row_hash
from ..schema import q, require_numeric

LOCAL_ROWS = 500  # rows of a task whose perturbations are scored in numpy


def _means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: float(row[i]) for i, c in enumerate(features)}


def _score(scored: DataFrame) -> Column:
    """What is explained: the probability of the last class, else the prediction."""
    if "probability" in scored.columns:
        share = vector_to_array("probability")
        return F.element_at(share, -1)
    return F.col("prediction")


def mean_substitution_importance(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """`(key, feature, importance)`: change of the score when a feature is set to its mean.

    All variants of a row are scored in one pass; rows move by key once, before they are multiplied.
    """
    features = require_numeric(df, features)
    means = _means(df, features)
    variants = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                *[(F.lit(means[c]) if c == name else q(c).cast("double")).alias(c) for c in features],
            )
            for name in [None, *features]
        ]
    )
    scored = model.transform(df.repartition(q(key)).select(q(key), F.explode(variants).alias("v")).select(q(key), "v.*"))
    values = scored.select(q(key), "feature", _score(scored).alias("s"))
    # One row per feature of the same key: at most the number of features plus one.
    wide = values.groupBy(q(key)).agg(
        F.max(F.when(F.col("feature").isNull(), F.col("s"))).alias("base"),
        F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "s"))).alias("all"),
    )
    return wide.select(q(key), "base", F.explode("all").alias("x")).select(
        q(key), "x.feature", F.abs(F.col("base") - F.col("x.s")).alias("importance")
    )


def shap_linear(df: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """Exact attributions of a linear model: `(key, feature, shap)` = coefficient x (value - mean)."""
    features = require_numeric(df, list(coefficients))
    means = _means(df, features)
    cells = [
        F.struct(F.lit(c).alias("feature"), ((q(c) - F.lit(means[c])) * F.lit(float(w))).alias("shap"))
        for c, w in coefficients.items()
    ]
    return df.select(q(key), F.inline(F.array(*cells)))


def shap_sampling(
    model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], permutations: int = 8, seed: int = 42
) -> DataFrame:
    """Shapley values estimated over feature orders, with the means as background.

    Along an order features switch one by one from mean to value; a feature earns the change
    its switch brings. All steps of a row are scored in one pass; rows move by key once, before that.
    """
    features = require_numeric(df, features)
    means = _means(df, features)
    rng = random.Random(seed)
    orders = []
    for i in range(permutations):
        # Orders come with their reverse, which cancels part of the sampling error.
        orders.append(list(reversed(orders[-1])) if i % 2 else rng.sample(features, len(features)))
    steps = []
    for order in orders:
        for j in range(len(order) + 1):
            on = set(order[:j])
            steps.append(
                F.struct(
                    F.lit(order[j - 1] if j else None).cast("string").alias("gains"),
                    F.lit(order[j] if j < len(order) else None).cast("string").alias("loses"),
                    *[(q(c).cast("double") if c in on else F.lit(means[c])).alias(c) for c in features],
                )
            )
    scored = model.transform(df.repartition(q(key)).select(q(key), F.explode(F.array(*steps)).alias("v")).select(q(key), "v.*"))
    s = _score(scored)
    moves = F.array(
        F.struct(F.col("gains").alias("feature"), s.alias("d")), F.struct(F.col("loses").alias("feature"), (-s).alias("d"))
    )
    changes = scored.select(q(key), F.inline(moves)).filter(F.col("feature").isNotNull())
    return changes.groupBy(q(key), "feature").agg((F.sum("d") / F.lit(len(orders))).alias("shap"))


def global_importance(local: DataFrame, value: str = "shap") -> DataFrame:
    """`(feature, importance, mean_value)`: mean absolute and mean attribution."""
    return local.groupBy("feature").agg(F.avg(F.abs(q(value))).alias("importance"), F.avg(q(value)).alias("mean_value"))


def top_k_features(importances: DataFrame, n: int = 10, value: str = "importance") -> DataFrame:
    return importances.orderBy(F.desc(F.abs(q(value))), "feature").limit(n)


def _linear_score(model: PipelineModel, features: Sequence[str]) -> Callable[[np.ndarray], np.ndarray] | None:
    """The score of a linear or logistic model for rows of the features as an array; None for other models."""
    stages = [s for s in model.stages if not isinstance(s, IndexToString)]
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], (LinearRegressionModel, LogisticRegressionModel)):
        return None
    names, learner = stages[0].getInputCols(), stages[1]
    if set(names) - set(features) or learner.getFeaturesCol() != stages[0].getOutputCol():
        return None
    logistic = isinstance(learner, LogisticRegressionModel)
    rows = learner.coefficientMatrix.toArray() if logistic else learner.coefficients.toArray()[None, :]
    offsets = learner.interceptVector.toArray() if logistic else np.array([learner.intercept])
    weights = np.zeros((len(rows), len(features)))
    for c, of_class in zip(names, rows.T):
        weights[:, list(features).index(c)] += of_class

    def score(x: np.ndarray) -> np.ndarray:
        margins = x @ weights.T + offsets
        if not logistic:
            return margins[:, 0]
        with np.errstate(over="ignore"):
            if len(weights) == 1:
                return 1 / (1 + np.exp(-margins[:, 0]))
            shares = np.exp(margins - margins.max(axis=1, keepdims=True))
            return shares[:, -1] / shares.sum(axis=1)

    return score


def _local_sums(
    df: DataFrame, key: str, features: Sequence[str], score: Callable[[np.ndarray], np.ndarray], spread: Sequence[float], samples: int, seed: int, rows: int
) -> DataFrame:
    """`(key, left, right)`: the normal equations of each row, its perturbations drawn and scored where the row is."""
    d = len(features)
    width = 0.75 * d**0.5
    upper = np.triu_indices(d + 1)
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LOCAL_ROWS))
    values = [q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    taken = df.select(q(key), q(key).cast("string").alias("__text"), *values).repartition(pieces)
    cells = T.ArrayType(T.DoubleType())
    schema = T.StructType([taken.schema[0], T.StructField("left", cells), T.StructField("right", cells)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(samples, 2 * d, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            if np.isnan(x).any():
                raise ValueError("features hold missing values")
            lefts, rights = [], []
            for text, point in zip(batch.column(1).to_pylist(), x):
                hashed = draws.of(text)
                z = np.sqrt(-2 * np.log((hashed[:, ::2] + 1) / float(SPAN + 1))) * np.cos(2 * np.pi * (hashed[:, 1::2] / float(SPAN)))
                z[0] = 0.0  # the first sample is the row itself
                s = score(point + z * np.asarray(spread))
                w = np.exp(-np.sum(z * z, axis=1) / (width * width))
                terms = np.column_stack([np.ones(samples), z])
                weighed = terms * w[:, None]
                lefts.append((weighed.T @ terms)[upper])
                rights.append(weighed.T @ s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lefts, pa.list_(pa.float64())), pa.array(rights, pa.list_(pa.float64()))], names=schema.names)

    found = taken.mapInArrow(summed, schema)
    # Rows of one key are fitted together.
    return found.groupBy(q(key)).agg(
        F.array(*[F.sum(F.col("left")[i]) for i in range(len(upper[0]))]).alias("left"), F.array(*[F.sum(F.col("right")[i]) for i in range(d + 1)]).alias("right")
    )


def _scored_sums(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], spread: Sequence[float], samples: int, seed: int) -> DataFrame:
    """`(key, left, right)`: the normal equations of each row, its perturbations scored by the model as rows."""
    d = len(features)
    width = 0.75 * d**0.5

    def noise(i: int) -> Column:
        u = (row_hash(q(key), F.col("__i"), F.lit(2 * i), seed=seed) + 1) / F.lit(float(SPAN + 1))
        v = row_hash(q(key), F.col("__i"), F.lit(2 * i + 1), seed=seed) / F.lit(float(SPAN))
        return F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)

    drawn = df.select(q(key), *[q(c).cast("double").alias(c) for c in features]).repartition(q(key)).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    )
    # The first sample is the row itself.
    drawn = drawn.withColumns({f"__z{i}": F.when(F.col("__i") > 0, noise(i)).otherwise(F.lit(0.0)) for i in range(d)})
    moved = drawn.withColumns({c: q(c) + F.col(f"__z{i}") * F.lit(spread[i]) for i, c in enumerate(features)})
    scored = model.transform(moved)
    far = sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(d)), F.lit(0.0))
    w = F.exp(-far / F.lit(width * width))
    columns = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(d)]]
    weighed = scored.withColumn("__w", w).withColumn("__s", _score(scored))
    sums = [F.sum(F.col("__w") * a * b) for i, a in enumerate(columns) for b in columns[i:]]
    right = [F.sum(F.col("__w") * F.col("__s") * a) for a in columns]
    return weighed.groupBy(q(key)).agg(F.array(*sums).alias("left"), F.array(*right).alias("right"))


def lime_local(
    model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], samples: int = 5_000, seed: int = 42
) -> DataFrame:
    """`(key, feature, weight)`: linear fit around each row, nearer perturbations weigh more.

    Perturbations are drawn from hashes, scored in one pass and summed into the normal
    equations of each row. Those of linear models are drawn, scored and summed where the row is, and never become rows;
    other models score them as rows.
    """
    features = require_numeric(df, features)
    d = len(features)
    row = df.agg(*[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(features)], F.count("*").alias("n")).first()
    spread = [float(row[i] or 0.0) or 1.0 for i in range(d)]
    score = _linear_score(model, features)
    if score is None:
        normal = _scored_sums(model, df, key, features, spread, samples, seed)
    else:
        normal = _local_sums(df, key, features, score, spread, samples, seed, row["n"])

    @F.pandas_udf("array<double>")
    def solve(left: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        upper = np.triu_indices(d + 1)
        for values, y in zip(left, target):
            a = np.zeros((d + 1, d + 1))
            a[upper] = values
            a = a + np.triu(a, 1).T
            a[np.diag_indices(d + 1)] += [0.0] + [1e-6] * d
            out.append(np.linalg.solve(a, np.asarray(y))[1:])
        return pd.Series(out)

    fitted = normal.withColumn("w", solve("left", "right"))
    cells = [F.struct(F.lit(c).alias("feature"), F.col("w")[i].alias("weight")) for i, c in enumerate(features)]
    return fitted.select(q(key), F.inline(F.array(*cells)))
