"""Metrics from tables of labels and predictions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..schema import TableError, q
from ..session import durable
from .quantiles import quantiles
from .ranking import running_totals

def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """`(y, p, n)`: rows of each pair of classes."""
    return df.select(q(label).alias("y"), q(prediction).alias("p")).na.drop().groupBy("y", "p").agg(F.count("*").alias("n"))


def _class_sums(pairs: DataFrame) -> DataFrame:
    """`(c, real, said, hit)` of each class."""
    none = F.lit(0).cast("long")
    own = F.struct(F.col("y").alias("c"), F.col("n").alias("real"), none.alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none).alias("hit"))
    other = F.struct(F.col("p").alias("c"), none.alias("real"), F.col("n").alias("said"), none.alias("hit"))
    return pairs.select(F.inline(F.array(own, other))).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("real", "said", "hit")])


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """`(label, prediction, n)` for every pair of classes, zeros included.

    The matrix has as many cells as classes times classes; the list of classes goes to each of them.
    """
    pairs = durable(_pairs(df, label, prediction))
    classes = _class_sums(pairs).select("c")
    # The result is the square of this list, so it is short wherever the result can be made.
    listed = classes.agg(F.sort_array(F.collect_list("c")).alias("all"))
    grid = listed.select(F.explode("all").alias("y"), "all").repartition("y").select("y", F.explode("all").alias("p"))
    cells = grid.join(pairs, ["y", "p"], "left")
    return cells.select(F.col("y").cast("string").alias("label"), F.col("p").cast("string").alias("prediction"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str, positive: Any = None) -> dict[str, float]:
    """Accuracy, precision, recall and F1: of the positive class for two classes, else weighted.

    Everything is summed in Spark, whatever the number of classes.
    """
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = part(F.col("hit"), F.col("said")), part(F.col("hit"), F.col("real"))
    scored = _class_sums(_pairs(df, label, prediction)).withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1_score", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    names = ("precision", "recall", "f1_score")
    one = F.struct(*names)
    chosen = F.max_by(one, F.col("c")) if positive is None else F.max_by(F.when(F.col("c") == F.lit(positive), one), F.col("c") == F.lit(positive))
    row = scored.agg(
        F.count("*").alias("classes"), F.sum("real").alias("rows"), F.sum("hit").alias("hits"), chosen.alias("chosen"),
        *[F.sum(F.col(n) * F.col("real")).alias(n) for n in names],
    ).first()
    if not row["rows"]:
        raise TableError("no labelled predictions")
    if row["classes"] <= 2:
        found = {n: (row["chosen"][n] if row["chosen"] is not None else 0.0) for n in names}
    else:
        found = {n: row[n] / row["rows"] for n in names}
    return {"accuracy": row["hits"] / row["rows"], **found}


def metric_rows(spark, metrics: dict[str, float | None]) -> DataFrame:
    rows = [(m, None if v is None else float(v)) for m, v in metrics.items()]
    return spark.createDataFrame(rows, "metric string, value double")


def roc_auc(df: DataFrame, label: str, score: str, positive: Any = 1, bucket_rows: int | None = None) -> float | None:
    """Area under the curve from score ranks; tied scores count half."""
    hit = q(label) == F.lit(positive)
    counts = (
        df.filter(q(label).isNotNull() & q(score).isNotNull())
        .groupBy(q(score).cast("double").alias("s"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )
    options = {"bucket_rows": bucket_rows} if bucket_rows else {}
    walked = running_totals(counts, "s", ["neg"], **options)
    row = walked.agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).first()
    return row["u"] / (row["p"] * row["n"]) if row["p"] and row["n"] else None


def roc_auc_multiclass(df: DataFrame, label: str, scores: dict[Any, str]) -> DataFrame:
    """`(class, auc)` one against the rest, and their mean under the class `*`."""
    found = [(str(c), roc_auc(df, label, s, c)) for c, s in scores.items()]
    known = [a for _, a in found if a is not None]
    found.append(("*", sum(known) / len(known) if known else None))
    return df.sparkSession.createDataFrame(found, "class string, auc double")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> dict[str, float | None]:
    """MSE, RMSE, R2, MAE, median absolute error and explained variance."""
    pairs = df.select(q(label).cast("double").alias("y"), q(prediction).cast("double").alias("p")).na.drop()
    e = F.col("y") - F.col("p")
    errors = pairs.withColumn("e", e).withColumn("a", F.abs(e))
    row = errors.agg(
        F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg("a").alias("mae"), F.var_pop("y").alias("vy"), F.var_pop("e").alias("ve")
    ).first()
    if row["mse"] is None:
        raise TableError("no labelled predictions")
    median = quantiles(errors, "a", [0.5])["a"][0]
    vy = row["vy"]
    return {
        "mse": row["mse"],
        "rmse": row["mse"] ** 0.5,
        "r2_score": 1 - row["mse"] / vy if vy else None,
        "mae": row["mae"],
        "median_absolute_error": median,
        "explained_variance": 1 - row["ve"] / vy if vy else None,
    }


def detect_problem_type(df: DataFrame, target: str) -> str:
    """Classification for non-numeric targets or when two of four signs of classes hold."""
    from ..schema import numeric_columns

    if target not in numeric_columns(df):
        return "classification"
    x = q(target)
    row = df.agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if((x.cast("double") % 1) != 0).alias("fractions")
    ).first()
    unique = df.select(x).filter(x.isNotNull()).distinct().count()
    whole = row["fractions"] == 0
    signs = [
        unique <= 10,
        unique <= max(2, row["n"] * 0.05),
        whole and unique <= 20,
        bool(whole and row["n"] and row["lo"] >= 0 and row["hi"] <= 1),
    ]
    return "classification" if sum(signs) >= 2 else "regression"
