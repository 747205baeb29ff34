"""Probabilities from margins: a sigmoid for each class, fitted to margins of rows that the learner did not see."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

FOLDS = 3
ROUNDS = 50


def fit_sigmoid(margins: DataFrame, margin: str = "margin", hit: str = "hit") -> tuple[float, float]:
    """`(slope, shift)` of `1 / (1 + exp(-(slope * margin + shift)))`, the likeliest for the labels in `hit`.

    Labels are drawn in a little from 0 and 1, by the numbers of both, so that margins which part them leave a finite curve. Every Newton step is
    one aggregate over the rows; a step that makes the fit worse is halved.
    """
    m = F.col(margin).cast("double")
    counts = margins.agg(F.count_if(hit), F.count_if(~F.col(hit))).first()
    high, low = (counts[0] + 1) / (counts[0] + 2), 1 / (counts[1] + 2)
    t = F.when(F.col(hit), F.lit(high)).otherwise(F.lit(low))

    def sums(slope: float, shift: float) -> tuple:
        z = F.lit(slope) * m + F.lit(shift)
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        # log(1 + exp(z)) without overflow
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        return margins.agg(*[F.sum(x) for x in (loss, m * (t - p), t - p, w * m * m, w * m, w)]).first()

    slope, shift = 0.0, math.log((counts[0] + 1) / (counts[1] + 1))
    at = sums(slope, shift)
    for _ in range(ROUNDS):
        _, ga, gb, aa, ab, bb = at
        if abs(ga) + abs(gb) < 1e-9 * max(1, sum(counts)):
            break
        det = (aa + 1e-12) * (bb + 1e-12) - ab * ab
        da, db = ((bb + 1e-12) * ga - ab * gb) / det, ((aa + 1e-12) * gb - ab * ga) / det
        step = 1.0
        while step > 1e-10:
            after = sums(slope + step * da, shift + step * db)
            if after[0] <= at[0] - 1e-4 * step * (ga * da + gb * db) or step < 1e-9:
                break
            step /= 2
        if at[0] - after[0] < 1e-13 * max(1.0, abs(at[0])) and step < 1:
            break
        slope, shift, at = slope + step * da, shift + step * db, after
    return slope, shift


def held_out_margins(data: DataFrame, features: list[str], train: Callable[[DataFrame], Transformer], folds: int = FOLDS) -> DataFrame:
    """`(label, margins)` of all rows, each from a learner that was fitted without its fold; equal rows share a fold."""
    marked = data.withColumn("__fold", F.pmod(F.xxhash64(*[F.col(f"`{f}`") for f in features], "label"), F.lit(folds)))

    def fold(i: int) -> DataFrame:
        scored = train(marked.filter(F.col("__fold") != i)).transform(marked.filter(F.col("__fold") == i))
        return scored.select("label", vector_to_array("rawPrediction").alias("margins"))

    # The fits are many small jobs each, so they are started together.
    with ThreadPool(folds) as pool:
        parts = pool.map(inheritable_thread_target(data.sparkSession)(fold), range(folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_sigmoids(margins: DataFrame, classes: int) -> Sigmoids:
    """One curve for two classes, else one for each class against the others."""
    held = margins.persist()
    try:
        pairs = [(1, 1)] if classes == 2 else [(k, k) for k in range(classes)]
        curves = [
            fit_sigmoid(held.select(F.col("margins")[k].alias("margin"), (F.col("label") == c).alias("hit")).filter("margin is not null"))
            for k, c in pairs
        ]
    finally:
        held.unpersist()
    return Sigmoids(slopes=[c[0] for c in curves], shifts=[c[1] for c in curves])


class Sigmoids(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` to tables with `rawPrediction`; several classes are scaled to sum up to one."""

    slopes = Param(Params._dummy(), "slopes", "slope of each curve", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "shift of each curve", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, slopes=None, shifts=None):
        super().__init__()
        self._setDefault(slopes=[1.0], shifts=[0.0])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        slopes, shifts = np.array(self.getOrDefault(self.slopes)), np.array(self.getOrDefault(self.shifts))

        @F.pandas_udf("array<double>")
        def chances(values: pd.Series) -> pd.Series:
            if values.empty:
                return values
            raw = np.stack(values.to_numpy())
            raw = raw[:, 1:2] if len(slopes) == 1 else raw
            p = 1 / (1 + np.exp(-(slopes * raw + shifts)))
            p = np.column_stack([1 - p, p]) if len(slopes) == 1 else p / p.sum(axis=1, keepdims=True)
            return pd.Series(list(p))

        return df.withColumn("probability", array_to_vector(chances(vector_to_array("rawPrediction"))))
