"""Gradient boosting for any number of classes: one tree per class and round on the gradients of the softmax.

Every level of all trees of a round is one pass: tasks sum the gradients of their rows by class, node, feature and bin, the small
histograms are added up, and the driver picks the splits. Sums of the two sides of a split are part of its histogram,
so the values of the leaves need no pass of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..schema import q

BINS = 32
FAN_IN = 16
TINY = 1e-12


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Split points of each feature: between its values where they are few, else between its quantiles."""
    out = []
    for f in features:
        values = [r[0] for r in df.select(q(f).cast("double")).distinct().limit(bins + 1).collect()]
        if len(values) > bins:
            shares = [i / bins for i in range(1, bins)]
            found = df.agg(F.percentile_approx(q(f).cast("double"), shares, 10_000)).first()[0]
            out.append(np.unique(np.array(found, dtype=float)))
            continue
        values = np.sort(np.array(values, dtype=float))
        out.append((values[:-1] + values[1:]) / 2)
    return out


# A tree is a list of nodes in levels: node i leads to 2i + 1 (at or below the threshold) and 2i + 2. Each is
# `[feature, threshold, value]`; a leaf has feature -1.
Tree = list[list[float]]


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = place_of(tree, x)
    return np.array([node[2] for node in tree])[at]


def place_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node that each row ends in, in a tree that may still grow."""
    nodes = np.array(tree, dtype=float)
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        feature = nodes[at, 0].astype(np.int64)
        open_ = feature >= 0
        if not open_.any():
            return at
        below = x[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1]
        at = np.where(open_, 2 * at + np.where(below, 1, 2), at)


def raw_scores(rounds: Sequence[Sequence[Tree]], start: Sequence[float], rate: float, x: np.ndarray) -> np.ndarray:
    out = np.tile(np.array(start, dtype=float), (len(x), 1))
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += rate * tree_values(tree, x)
    return out


def softmax(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        return np.column_stack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _histograms(
    data: DataFrame, features: int, edges: list[np.ndarray], rounds: list[list[Tree]], growing: list[Tree], start: list[float], rate: float, first: int, width: int
) -> np.ndarray:
    """`[tree, node, feature, bin, (weight, gradient, curvature)]` of the rows in the `width` nodes from `first` on."""
    shape = (len(growing), width, features, max(len(e) for e in edges) + 1, 3)
    shared = data.sparkSession.sparkContext.broadcast((rounds, growing))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_trees = shared.value
        total = np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy().astype(np.int64)
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
            chance = softmax(raw_scores(done, start, rate, x))
            bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
            for k, tree in enumerate(open_trees):
                want = (y == (1 if len(open_trees) == 1 else k)).astype(float)
                gradient = want - chance[:, 1 if len(open_trees) == 1 else k]
                curve = np.abs(gradient) * (1 - np.abs(gradient))
                node = place_of(tree, x) - first
                inside = np.flatnonzero((node >= 0) & (node < width))
                for f in range(features):
                    for s, value in enumerate((w, w * gradient, w * curve)):
                        np.add.at(total[k, :, f, :, s], (node[inside], bins[inside, f]), value[inside])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["task", "sums"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN_IN], "sums": [total.tobytes()]})

    found, tasks = data.mapInArrow(part, "task int, sums binary"), data.rdd.getNumPartitions()
    while tasks > FAN_IN:
        found = found.groupBy(F.floor(F.col("task") / FAN_IN)).applyInPandas(meet, "task int, sums binary")
        tasks = -(-tasks // FAN_IN)
    # Tasks end in any order; adding their sums in one order keeps the result the same.
    return np.sum([np.frombuffer(bytes(r["sums"])).reshape(shape) for r in found.orderBy("task").collect()], axis=0)


def _leaf(sums: np.ndarray, classes: int) -> float:
    """The step of a leaf from its weight, gradient and curvature."""
    share = (classes - 1) / classes if classes > 2 else 1.0
    return float(share * sums[1] / sums[2]) if sums[2] > TINY else 0.0


def best_split(node: np.ndarray, edges: list[np.ndarray], least: float = 1.0) -> tuple[int, int, float]:
    """`(feature, bin, gain)` of the split of `[feature, bin, sums]` that lowers the squared error most; the first among equals, feature -1 for none."""
    best = (-1, -1, TINY)
    for f, e in enumerate(edges):
        left = np.cumsum(node[f, : len(e) + 1], axis=0)
        total = left[-1]
        for b in range(len(e)):
            n, s = left[b, 0], left[b, 1]
            if n < least or total[0] - n < least:
                continue
            gain = s * s / n + (total[1] - s) ** 2 / (total[0] - n) - total[1] ** 2 / total[0]
            if gain > best[2] * (1 + 1e-9) + TINY:
                best = (f, b, gain)
    return best


def fit_softmax_trees(
    labelled: DataFrame, features: Sequence[str], classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.1, weight: str | None = None,
    bins: int = BINS, least: float = 1.0,
) -> SoftmaxTrees:
    """Boost on the class numbers in the column `label`; two classes share one tree per round."""
    w = q(weight).cast("double") if weight else F.lit(1.0)
    x = F.array(*[q(f).cast("double") for f in features])
    data = labelled.select(q("label").cast("int").alias("y"), w.alias("w"), x.alias("x")).persist()
    try:
        edges = bin_edges(labelled, features, bins)
        counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.sum("w").alias("n")).collect()}
        total = sum(counts.values())
        shares = [counts.get(k, 0.0) / total for k in range(classes)]
        start = [float(np.log(shares[1] / shares[0]))] if classes == 2 else [float(np.log(s)) for s in shares]
        done: list[list[Tree]] = []
        gains = np.zeros(len(features))
        for _ in range(rounds):
            growing: list[Tree] = [[[-1.0, 0.0, 0.0] for _ in range(2 ** (depth + 1) - 1)] for _ in start]
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                found = _histograms(data, len(features), edges, done, growing, start, rate, first, width)
                for k, tree in enumerate(growing):
                    for n in range(width):
                        node = found[k, n]
                        sums = node[0].sum(axis=0)
                        if not sums[0]:
                            continue
                        tree[first + n][2] = _leaf(sums, classes)
                        f, b, gain = best_split(node, edges, least)
                        if f < 0:
                            continue
                        gains[f] += gain
                        tree[first + n][:2] = [float(f), float(edges[f][b])]
                        left = node[f, : b + 1].sum(axis=0)
                        for side, part in ((1, left), (2, sums - left)):
                            tree[2 * (first + n) + side][2] = _leaf(part, classes)
            done.append(growing)
        importance = (gains / gains.sum() if gains.sum() > 0 else gains).tolist()
        content = json.dumps({"start": start, "rate": rate, "rounds": done, "classes": classes, "importance": importance})
        return SoftmaxTrees(content=content)
    finally:
        data.unpersist()


class SoftmaxTrees(Transformer, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted boosting model: adds `probability` and `prediction` to tables with a vector of the features."""

    content = Param(Params._dummy(), "content", "trees of each round as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, content=None, featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features", content="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _model(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.content))

    @property
    def numClasses(self) -> int:
        return self._model()["classes"]

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of the splits on each feature, summed up to one."""
        return DenseVector(self._model()["importance"])

    def _transform(self, df: DataFrame) -> DataFrame:
        model = self._model()

        @F.pandas_udf("array<double>")
        def chances(values: pd.Series) -> pd.Series:
            if values.empty:
                return values
            x = np.stack(values.to_numpy())
            return pd.Series(list(softmax(raw_scores(model["rounds"], model["start"], model["rate"], x))))

        scored = df.withColumn("probability", array_to_vector(chances(vector_to_array(self.getFeaturesCol()))))
        share = vector_to_array("probability")
        return scored.withColumn("prediction", (F.array_position(share, F.array_max(share)) - 1).cast("double"))
