"""Linear learners scored on every fold from second moments, so that any number of trials reads the rows once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..schema import TableError, q

LINEAR = ("linear_regression", "ridge_regression")


class Moments:
    """Count, means and summed products of deviations of the columns; parts can be added up."""

    def __init__(self, n: int, mean: np.ndarray, scatter: np.ndarray):
        self.n, self.mean, self.scatter = n, mean, scatter

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), scatter)


def moment_columns(columns: Sequence[str]) -> list:
    """Aggregates from which `moments_of` builds the moments of the columns."""
    x = [q(c).cast("double") for c in columns]
    pairs = [F.covar_pop(x[i], x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *pairs]


def moments_of(row, width: int) -> Moments:
    scatter = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            scatter[i, j] = scatter[j, i] = (row[f"s{i}_{j}"] or 0.0) * row["n"]
    return Moments(row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(width)]), scatter)


def solve(moments: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept with the penalty `alpha` on the squared weights; the last column is the target."""
    d = len(moments.mean) - 1
    left = moments.scatter[:d, :d] + alpha * np.eye(d)
    weights = np.linalg.lstsq(left, moments.scatter[:d, d], rcond=None)[0]
    return weights, float(moments.mean[d] - weights @ moments.mean[:d])


def r2_of(moments: Moments, weights: np.ndarray, intercept: float) -> float:
    """R2 of a line on the rows that the moments describe."""
    d = len(moments.mean) - 1
    off = moments.mean[d] - intercept - weights @ moments.mean[:d]
    x, y = moments.scatter[:d, :d], moments.scatter[:d, d]
    error = moments.scatter[d, d] - 2 * weights @ y + weights @ x @ weights + moments.n * off * off
    return float(1 - error / moments.scatter[d, d]) if moments.scatter[d, d] > 0 else float("-inf")


def gram_fold_scores(
    data: DataFrame, features: Sequence[str], target: str, algorithm: str, folds: int
) -> Callable[[Sequence[dict[str, Any]]], list[list[float]]]:
    """Scorer of parameter sets (`alpha` of ridge regression) by R2 on every fold; `data` carries its `fold`.

    One aggregate over the rows gives the moments of each fold; every fit after that solves a matrix of the size of the features.
    """
    columns = [*features, target]
    parts = {r["fold"]: moments_of(r, len(columns)) for r in data.groupBy("fold").agg(*moment_columns(columns)).collect()}
    if sum(p.n for p in parts.values()) < 10:
        raise TableError("10 complete rows are needed")
    empty = Moments(0, np.zeros(len(columns)), np.zeros((len(columns), len(columns))))
    held = [parts.get(i, empty) for i in range(folds)]
    others = []
    for i in range(folds):
        rest = empty
        for j in range(folds):
            rest = rest + held[j] if j != i else rest
        others.append(rest)

    def penalty(trial: dict[str, Any]) -> float:
        return float(trial.get("alpha", 1.0)) if algorithm == "ridge_regression" else 0.0

    def score(trials: Sequence[dict[str, Any]]) -> list[list[float]]:
        return [[r2_of(held[i], *solve(others[i], penalty(t))) for i in range(folds)] for t in trials]

    return score
