"""Cross-validation, tuning and model selection."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluate import classification_metrics, detect_problem_type, regression_metrics
from ..operators.neighbors import knn_classify, knn_regress
from ..operators.sampling import kfold, stratified_kfold, train_test_split, train_test_split_stratified
from ..schema import TableError, q
from .closed_form import LINEAR, gram_fold_scores
from .learners import CLASSIFIERS, NEIGHBORS, REGRESSORS, feature_frame, fit, resolve
from .parzen import Range, suggest

PARALLEL_FITS = 4
# Rows that fill one slot. Fits of fewer rows leave slots free for others; more of them at once would only hold more memory.
SLOT_ROWS = 100_000
LEAST_FITS = 3

# Tuning grids. None means no depth limit, which Spark trees end at 30. Rows needed to split a
# node and the choice of a solver have no counterpart in Spark's learners and are left out.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "random_forest_classifier": {"trees": [50, 100, 200], "max_depth": [None, 10, 20], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting_classifier": {"trees": [50, 100, 150], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
    "svc": {"C": [0.1, 1.0, 10.0], "gamma": ["scale", "auto", 0.001, 0.01], "kernel": ["rbf", "linear"]},
    "random_forest_regressor": {"trees": [50, 100, 200], "max_depth": [None, 10, 20]},
    "gradient_boosting_regressor": {"trees": [50, 100, 150], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
}


class NeighborModel:
    """Nearest neighbours among the rows it was given, in the form of a fitted model."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, key: str, classify: bool, neighbors: int = NEIGHBORS):
        if not isinstance(key, str):
            raise TableError("neighbours need a key of one column")
        self.features, self.key, self.classify, self.neighbors = list(features), key, classify, neighbors
        feature_frame(train, features)
        self.train = self._points(train, q(target).alias("__y"))

    def _points(self, df: DataFrame, *more) -> DataFrame:
        return df.select(q(self.key).alias("__id"), F.array(*[q(c).cast("double") for c in self.features]).alias("__x"), *more)

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `prediction`, and `predicted_label` of a classifier."""
        find = knn_classify if self.classify else knn_regress
        found = find(self.train, self._points(df), "__id", "__x", "__y", self.neighbors).withColumnRenamed("__id", "__near")
        scored = df.join(found.select("__near", "prediction"), q(self.key) == F.col("__near")).drop("__near")
        return scored.withColumn("predicted_label", F.col("prediction").cast("string")) if self.classify else scored


def _trained(df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, **params: Any):
    if algorithm.startswith("knn"):
        return NeighborModel(df, features, target, key, algorithm in CLASSIFIERS, **params)
    return fit(df, features, target, algorithm, **params)


def evaluate(df: DataFrame, target: str, problem: str, prediction: str = "prediction") -> dict[str, float | None]:
    if problem == "classification":
        as_text = df.withColumn("__y", F.col(target).cast("string"))
        return classification_metrics(as_text, "__y", "predicted_label")
    scored = df.select(target, prediction).persist()  # the median error reads the predictions several times
    try:
        return regression_metrics(scored, target, prediction)
    finally:
        scored.unpersist()


def score_of(metrics: dict[str, float | None], problem: str) -> float:
    value = metrics["f1_score"] if problem == "classification" else metrics["r2_score"]
    return float("-inf") if value is None else value


def with_folds(df: DataFrame, target: str, key, problem: str, folds: int, seed: int = 42) -> DataFrame:
    if problem == "classification":
        return stratified_kfold(df, target, key, folds, seed)
    return kfold(df, key, folds, seed)


def _in_parallel(spark: SparkSession, tasks: Sequence[Any], run: Callable[[Any], Any], fits: int = PARALLEL_FITS) -> list[Any]:
    """Start several fits at once, so Spark can fill its slots with their small jobs."""
    with ThreadPool(min(fits, max(1, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)


def _fits_at_once(spark: SparkSession, rows: int) -> int:
    slots = max(PARALLEL_FITS, spark.sparkContext.defaultParallelism)
    return max(LEAST_FITS, min(slots, slots * SLOT_ROWS // max(rows, 1)))


def _fold_score(data: DataFrame, features: Sequence[str], target: str, algorithm: str, key, params: dict[str, Any], fold: int) -> float:
    problem = "classification" if algorithm in CLASSIFIERS else "regression"
    if algorithm == "svc":
        params = {"probability": False, **params}  # scores need no more than the side of the margin
    model = _trained(data.filter(F.col("fold") != fold), features, target, algorithm, key, **params)
    return score_of(evaluate(model.transform(data.filter(F.col("fold") == fold)), target, problem), problem)


def _fold_scores(
    data: DataFrame, features: Sequence[str], target: str, algorithm: str, key, folds: int, trials: Sequence[dict[str, Any]]
) -> list[list[float]]:
    """Score of every fold for every parameter set; `data` carries its `fold`."""
    run = lambda task: _fold_score(data, features, target, algorithm, key, *task)
    found = _in_parallel(data.sparkSession, [(t, i) for t in trials for i in range(folds)], run)
    return [found[n * folds : (n + 1) * folds] for n in range(len(trials))]


def _folded(df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, folds: int, seed: int) -> DataFrame:
    problem = "classification" if algorithm in CLASSIFIERS else "regression"
    return with_folds(df.na.drop(subset=[*features, target]), target, key, problem, folds, seed).persist()


def _summary(scores: list[float]) -> dict[str, Any]:
    mean = sum(scores) / len(scores)
    return {"scores": scores, "mean_score": mean, "std_score": math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))}


def cross_validate(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, folds: int = 5, seed: int = 42, **params: Any
) -> dict[str, Any]:
    """Scores per fold (F1 or R2), their mean and population deviation."""
    data = _folded(df, features, target, algorithm, key, folds, seed)
    try:
        return _summary(_fold_scores(data, features, target, algorithm, key, folds, [params])[0])
    finally:
        data.unpersist()


def reduced_grid(grid: dict[str, list[Any]]) -> dict[str, list[Any]]:
    """First, middle and last of lists longer than three."""
    return {k: v if len(v) <= 3 else [v[0], v[len(v) // 2], v[-1]] for k, v in grid.items()}


def _best(trials: list[dict[str, Any]], scores: list[list[float]]) -> dict[str, Any]:
    results = [{"params": t, "score": sum(s) / len(s)} for t, s in zip(trials, scores)]
    return {"trials": results, **max(results, key=lambda r: r["score"])}


def tune_grid(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, grid: dict[str, list[Any]] | None = None, folds: int = 3
) -> dict[str, Any]:
    """Best of all combinations of a grid by cross-validation."""
    grid = reduced_grid(grid or GRIDS.get(algorithm, {}))
    trials = [dict(zip(grid, values)) for values in product(*grid.values())]
    data = _folded(df, features, target, algorithm, key, folds, 42)
    try:
        return _best(trials, _fold_scores(data, features, target, algorithm, key, folds, trials))
    finally:
        data.unpersist()


def _trial_scores(
    data: DataFrame, features: Sequence[str], target: str, algorithm: str, key, folds: int
) -> Callable[[Sequence[dict[str, Any]]], list[list[float]]]:
    """Scores every fold of a list of parameter sets; linear learners need the rows once for all sets together."""
    if algorithm in LINEAR:
        return gram_fold_scores(data, features, target, algorithm, folds)
    return lambda trials: _fold_scores(data, features, target, algorithm, key, folds, trials)


def _searched(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, trials: int, folds: int, seed: int, seconds: float | None,
    batch: int, draw: Callable[[list[tuple[dict[str, Any], float]]], dict[str, Any]],
) -> dict[str, Any]:
    """Draw and score parameter sets, `batch` at a time; a set whose fit fails scores lowest and the search goes on."""
    data = _folded(df, features, target, algorithm, key, folds, seed)
    started, done, scores = time.monotonic(), [], []
    try:
        score = _trial_scores(data, features, target, algorithm, key, folds)
        while len(done) < trials and (not done or seconds is None or time.monotonic() - started < seconds):
            drawn = [draw(done) for _ in range(min(batch, trials - len(done)))]
            try:
                found = score(drawn)
            except Exception:  # one bad set must not end the search
                found = [_tried(score, params, folds) for params in drawn]
            scores += found
            done += [(params, sum(f) / len(f)) for params, f in zip(drawn, found)]
        return {**_best([d[0] for d in done], scores), "not_run": trials - len(done)}
    finally:
        data.unpersist()


def _tried(score: Callable[[Sequence[dict[str, Any]]], list[list[float]]], params: dict[str, Any], folds: int) -> list[float]:
    try:
        return score([params])[0]
    except Exception:
        return [float("-inf")] * folds


def tune_random(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, trials: int = 50, folds: int = 3,
    seed: int = 42, seconds: float | None = None, grid: dict[str, list[Any]] | None = None,
) -> dict[str, Any]:
    """Best of seeded draws from the ranges that the grid spans.

    All trials are run unless a time budget in `seconds` is given; `not_run` counts those it cut off.
    """
    rng = random.Random(seed)
    ranges = {name: Range.of(values) for name, values in (grid or GRIDS.get(algorithm, {})).items()}
    draw = lambda done: {name: r.uniform(rng) for name, r in ranges.items()}
    return _searched(df, features, target, algorithm, key, trials, folds, seed, seconds, PARALLEL_FITS, draw)


def tune_parzen(
    df: DataFrame, features: Sequence[str], target: str, algorithm: str, key, trials: int = 50, folds: int = 3,
    seed: int = 42, seconds: float | None = None, grid: dict[str, list[Any]] | None = None, startup: int = 10, batch: int = 1,
) -> dict[str, Any]:
    """Best of trials drawn where good ones are dense and others are not.

    The first `startup` trials are drawn uniformly; after that each parameter comes from the candidate with the largest
    ratio of the density of the best tenth to that of the others (see `parzen.py`). With `batch` above one that
    many trials are drawn before the next are scored, so that Spark can fit them together. All trials are run unless
    a time budget in `seconds` is given; `not_run` counts those it cut off.
    """
    rng = random.Random(seed)
    ranges = {name: Range.of(values) for name, values in (grid or GRIDS.get(algorithm, {})).items()}
    draw = lambda done: suggest(ranges, done, rng, startup)
    return _searched(df, features, target, algorithm, key, trials, folds, seed, seconds, batch, draw)


def automl_select(
    df: DataFrame, features: Sequence[str], target: str, key, algorithms: Sequence[str] | None = None, problem: str | None = None,
    test_size: float = 0.2, folds: int = 5, overrides: dict[str, dict[str, Any]] | None = None,
) -> dict[str, Any]:
    """Train every algorithm on the training side and keep the best by mean fold score.

    The test side is only used for the reported metrics. A learner that fails is reported and
    the others go on. Fits of all learners share the slots of the cluster, the more at once the fewer rows
    they have, so `seconds` of a learner, from its first fit to its last, holds time in which others ran too.
    """
    problem = problem or detect_problem_type(df, target)
    names = [resolve(a, problem) for a in algorithms] if algorithms else list(CLASSIFIERS if problem == "classification" else REGRESSORS)
    clean = df.na.drop(subset=[*features, target])
    split = (
        train_test_split_stratified(clean, target, key, test_size)
        if problem == "classification"
        else train_test_split(clean, key, test_size)
    ).persist()
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    board, best = [], None
    spark = df.sparkSession

    def attempt(task: tuple[str, int | None]) -> tuple[float, float, Any]:
        name, fold = task
        params, started = (overrides or {}).get(name, {}), time.monotonic()
        try:
            if fold is not None:
                found: Any = _fold_score(data, features, target, name, key, params, fold)
            else:
                model = _trained(train, features, target, name, key, **params)
                found = model, evaluate(model.transform(test), target, problem)
        except Exception as error:  # a failing learner must not end the search
            found = error
        return started, time.monotonic(), found

    try:
        data = with_folds(train, target, key, problem, folds).persist()
        try:
            # Different learners run side by side, so that those which hold much memory seldom meet their like.
            tasks = [(name, fold) for fold in (*range(folds), None) for name in names]
            done = _in_parallel(spark, tasks, attempt, _fits_at_once(spark, data.count()))
        finally:
            data.unpersist()
    finally:
        split.unpersist()
    for n, name in enumerate(names):
        own = done[n :: len(names)]
        results = [found for _, _, found in own]
        failed = [found for found in results if isinstance(found, Exception)]
        if failed:
            board.append({"algorithm": name, "status": "failed", "error": str(failed[0])[:200]})
            continue
        summary, (model, metrics) = _summary(results[:-1]), results[-1]
        entry = {
            "algorithm": name,
            "status": "ok",
            "cv_score": summary["mean_score"],
            "cv_std": summary["std_score"],
            "seconds": max(ended for _, ended, _ in own) - min(started for started, _, _ in own),
            **metrics,
        }
        board.append(entry)
        if best is None or entry["cv_score"] > best["cv_score"]:
            best = {**entry, "model": model}
    if best is None:
        raise TableError(f"no algorithm could be trained: {board}")
    return {"problem": problem, "leaderboard": board, "best": best}
