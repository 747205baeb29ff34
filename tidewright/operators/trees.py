"""Exact attributions of tree models.

A leaf adds its value where all conditions on the way to it hold. Per leaf and feature on that way the conditions are one
interval, and the share of training rows that went along at the feature's splits. With a feature known its factor is 1 or 0,
with it unknown the share; the Shapley weights of all subsets of the other features are the integral over t of the
product of `t * known + (1 - t) * share`. That product is a polynomial of lower degree than the number of features on the
way, so Gauss-Legendre points give the integral exactly, in time polynomial in the depth.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TableError, q, require_numeric
from ..session import scratch_path
from .explain import global_importance

BLOCK_BYTES = 32 << 20  # of leaves that are broadcast at once
TILE = 1 << 20  # numbers worked on at once


@dataclass
class Leaves:
    """Leaves with the same number of features on the way, over any number of trees."""

    feature: np.ndarray  # (leaves, features)
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # (leaves, outputs)

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.low, self.high, self.share, self.value))


def tree_nodes(learner, spark: SparkSession) -> DataFrame:
    """`tree, id, prediction, stats, left, right, feature, threshold, categories` of a fitted tree model, as it is saved."""
    path = scratch_path(spark, "trees")
    learner.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    return saved.select(
        "tree", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("categories"),
    )


def _weights(learner) -> list[float]:
    if hasattr(learner, "treeWeights"):
        weights = list(learner.treeWeights)
        # Forests average their trees, boosting adds them up.
        return [w / sum(weights) for w in weights] if "RandomForest" in type(learner).__name__ else weights
    return [1.0]


def tree_leaves(learner, spark: SparkSession) -> Iterator[Leaves]:
    """All leaves of the model in blocks of bounded size; values are weighted by their tree.

    Outputs are the class probabilities of trees and forests, the prediction of regressors and the margin of a boosted classifier.
    """
    name = type(learner).__name__
    if not any(kind in name for kind in ("DecisionTree", "RandomForest", "GBT")):
        raise TableError("attributions along paths need a tree, a forest or boosted trees")
    shares = "Classification" in name and "GBT" not in name
    weights = _weights(learner)
    found: dict[int, list[tuple]] = {}
    size = 0

    def flush() -> Iterator[Leaves]:
        for rows in found.values():
            yield Leaves(*[np.array(c) for c in zip(*rows)])
        found.clear()

    trees: dict[int, dict[int, tuple]] = {}
    for r in tree_nodes(learner, spark).toLocalIterator():
        if r["left"] >= 0 and r["categories"] != -1:
            raise TableError("splits by category have no interval; encode the feature first")
        trees.setdefault(r["tree"], {})[r["id"]] = (r["prediction"], r["stats"], r["left"], r["right"], r["feature"], r["threshold"])
    for tree in sorted(trees):
        nodes = trees.pop(tree)
        counts = {i: sum(n[1]) if "Classification" in name and "GBT" not in name else n[1][0] for i, n in nodes.items()}
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            i, way = stack.pop()
            prediction, stats, left, right, feature, threshold = nodes[i]
            if left < 0:
                value = [s / counts[i] for s in stats] if shares else [prediction]
                order = sorted(way)
                row = (order, *[[way[f][k] for f in order] for k in range(3)], [v * weights[tree] for v in value])
                found.setdefault(len(order), []).append(row)
                size += 32 * len(order) + 8 * len(value)
                if size > BLOCK_BYTES:
                    yield from flush()
                    size = 0
                continue
            low, high, share = way.get(feature, (-np.inf, np.inf, 1.0))
            stack.append((left, {**way, feature: (low, min(high, threshold), share * counts[left] / counts[i])}))
            stack.append((right, {**way, feature: (max(low, threshold), high, share * counts[right] / counts[i])}))
    yield from flush()


def add_attributions(leaves: Leaves, x: np.ndarray, out: np.ndarray) -> None:
    """Add what the leaves give each feature of the rows `x` to `out` (rows, features, outputs)."""
    count, width = leaves.feature.shape
    if not width:
        return  # a tree of one leaf has nothing to attribute
    points, amounts = np.polynomial.legendre.leggauss(ceil(width / 2))
    points, amounts = (points + 1) / 2, amounts / 2
    step = max(1, TILE // (len(x) * width))
    for at in range(0, count, step):
        cut = slice(at, at + step)
        feature, share = leaves.feature[cut], leaves.share[cut][None]
        cells = x[:, feature]
        known = ((cells > leaves.low[cut]) & (cells <= leaves.high[cut])).astype(float)
        total = np.zeros_like(known)
        for t, amount in zip(points, amounts):
            factor = t * known + (1 - t) * share
            total += amount * factor.prod(axis=2, keepdims=True) / factor
        gain = (known - share) * total
        flat = feature.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        for k in range(out.shape[2]):
            part = (gain * leaves.value[cut, k][None, :, None]).reshape(len(x), -1)[:, order]
            out[:, flat[order][starts], k] += np.add.reduceat(part, starts, axis=1)


def _learner(model: PipelineModel):
    from ..modeling.learners import learner_of

    return learner_of(model)


def outputs_of(learner) -> int:
    name = type(learner).__name__
    return int(learner.numClasses) if "Classification" in name and "GBT" not in name else 1


def tree_base(model: PipelineModel, spark: SparkSession) -> list[float]:
    """The mean of each output over the training rows, as the trees hold them."""
    base = np.zeros(outputs_of(_learner(model)))
    for block in tree_leaves(_learner(model), spark):
        base += (block.share.prod(axis=1)[:, None] * block.value).sum(axis=0)
    return base.tolist()


def shap_tree(
    model: PipelineModel, df: DataFrame, key: str | Sequence[str], features: Sequence[str], output: int | None = -1
) -> DataFrame:
    """`(key, feature, shap)`: exact attributions of a fitted tree, forest or boosting to its features.

    Unknown features are taken as the training rows went, so the attributions of a row sum up to its score
    minus `tree_base`. The score is the probability of class number `output` (the last one by default) of trees and
    forests, the prediction of regressors, and the margin of a boosted classifier. With `output=None` there is one row
    for each class, numbered by `class`. Rows with a missing feature have no attributions. Rows stay where they are: leaves go
    to them, in blocks of at most 32 MB.
    """
    features = require_numeric(df, features)
    keys = [key] if isinstance(key, str) else list(key)
    learner, spark = _learner(model), df.sparkSession
    width, outputs = len(features), outputs_of(learner)
    names = [f"__x{i}" for i in range(width)]
    rows = df.select(*[q(k) for k in keys], *[q(c).cast("double").alias(n) for c, n in zip(features, names)]).na.drop(subset=names)
    work = rows.withColumn("__shap", F.array_repeat(F.lit(0.0), width * outputs))
    for block in tree_leaves(learner, spark):
        shared = spark.sparkContext.broadcast(block)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaves = shared.value
            for batch in batches:
                if not batch.num_rows:
                    yield batch
                    continue
                x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
                place = batch.schema.get_field_index("__shap")
                out = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, width, outputs).copy()
                tile = max(1, min(1024, TILE // max(1, leaves.feature.shape[1])))
                for at in range(0, len(x), tile):
                    add_attributions(leaves, x[at : at + tile], out[at : at + tile])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width * outputs).cast(pa.list_(pa.float64()))
                columns = [flat if i == place else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        work = work.mapInArrow(add, work.schema)
    chosen = range(outputs) if output is None else [output % outputs]
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(k).alias("class"), F.col("__shap")[i * outputs + k].alias("shap"))
        for i, c in enumerate(features)
        for k in chosen
    ]
    found = work.select(*[q(k) for k in keys], F.inline(F.array(*cells)))
    return found if output is None else found.drop("class")


def shap_tree_importance(model: PipelineModel, df: DataFrame, key: str | Sequence[str], features: Sequence[str]) -> DataFrame:
    """`(feature, importance, mean_value)`: mean absolute and mean attribution, over the classes where there are several."""
    return global_importance(shap_tree(model, df, key, features, None))
