"""Queries over the table of trained models and their versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.versions import next_version, version_compatible, version_order
from ..schema import q
from .sequences import previous


def registry_filter(
    models: DataFrame, name: str | None = None, tags: Sequence[str] | None = None, status: str | None = None
) -> DataFrame:
    """Models by name part (any case), one of the tags and status, newest update first."""
    if name is not None:
        models = models.filter(F.lower("name").contains(name.lower()))
    if tags:
        models = models.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if status is not None:
        models = models.filter(F.col("status") == status)
    return models.orderBy(F.desc("updated_at"), "model_id")


def model_summary(models: DataFrame) -> DataFrame:
    """Totals by problem type, broken and healthy models, training times."""
    return models.agg(
        F.count("*").alias("total_models"),
        F.count_if(F.col("problem_type") == "classification").alias("classification_models"),
        F.count_if(F.col("problem_type") == "regression").alias("regression_models"),
        F.count_if("broken").alias("broken_models"),
        F.count_if(~F.col("broken")).alias("healthy_models"),
        F.coalesce(F.avg("training_time"), F.lit(0.0)).alias("average_training_time"),
        F.coalesce(F.sum("training_time"), F.lit(0.0)).alias("total_training_time"),
    )


def algorithm_distribution(models: DataFrame) -> DataFrame:
    return models.groupBy("algorithm").agg(F.count("*").alias("models"))


def leaderboard_score() -> Column:
    """Cross-validation score, else F1 for classifiers and R2 for regressors."""
    by_type = F.when(F.col("problem_type") == "classification", F.coalesce("f1_score", F.lit(0.0))).otherwise(
        F.coalesce("r2_score", F.lit(float("-inf")))
    )
    return F.coalesce("cv_score", by_type)


def model_leaderboard(models: DataFrame, top: int | None = None) -> DataFrame:
    """Models ranked inside their problem type.

    With `top` only that many rows per type travel; a full ranking numbers all rows through
    range partitions because a problem type can hold half the table.
    """
    scored = models.withColumn("score", leaderboard_score())
    if top is not None:
        w = W.partitionBy("problem_type").orderBy(F.desc("score"), "model_id")
        return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
    from .ranking import global_index

    indexed = global_index(scored, [F.col("problem_type").asc(), F.col("score").desc(), F.col("model_id").asc()], "__i")
    first = indexed.groupBy("problem_type").agg(F.min("__i").alias("__first"))
    joined = indexed.join(F.broadcast(first), "problem_type")
    return joined.withColumn("position", (F.col("__i") - F.col("__first") + 1).cast("int")).drop("__i", "__first")


def latest_version(models: DataFrame) -> DataFrame:
    """`(name, version)` with the numerically largest version."""
    return models.groupBy("name").agg(F.max_by("version", F.struct(version_order(F.col("version")), F.col("version"))).alias("version"))


def version_history(models: DataFrame, name: str | None = None) -> DataFrame:
    """Active versions, newest first."""
    active = models.filter(F.col("is_active"))
    if name is not None:
        active = active.filter(F.col("name") == name)
    return active.orderBy("name", F.desc("created_at"), F.desc("model_id"))


FIELDS = ("version", "features", "target_column", "algorithm", "problem_type")


def breaking_changes(models: DataFrame, cut: Column) -> DataFrame:
    """Each version against the one before it of the same name.

    `cut` splits the history of a name into ranges (by day, month or sequence).
    """
    pairs = previous(models, ["name"], ["created_at", "model_id"], FIELDS, cut)
    pairs = pairs.filter(F.col("prev_version").isNotNull())
    removed, added = F.array_except("prev_features", "features"), F.array_except("features", "prev_features")
    out = pairs.withColumns(
        {
            "removed_features": F.array_join(F.array_sort(removed), ","),
            "added_features": F.array_join(F.array_sort(added), ","),
            "target_changed": ~F.col("target_column").eqNullSafe(F.col("prev_target_column")),
            "algorithm_changed": ~F.col("algorithm").eqNullSafe(F.col("prev_algorithm")),
            "type_changed": ~F.col("problem_type").eqNullSafe(F.col("prev_problem_type")),
        }
    )
    breaking = (
        (F.col("removed_features") != "")
        | (F.col("added_features") != "")
        | F.col("target_changed")
        | F.col("algorithm_changed")
        | F.col("type_changed")
    )
    return out.withColumn("breaking", breaking)


def version_advice(models: DataFrame, cut: Column) -> DataFrame:
    """Compatibility with the version before, and the version number the change calls for."""
    changes = breaking_changes(models, cut)
    return changes.select(
        "name",
        "model_id",
        "prev_version",
        "version",
        version_compatible(F.col("prev_version"), F.col("version")).alias("compatible"),
        next_version(F.col("prev_version"), F.col("breaking")).alias("suggested_version"),
    )


def model_info(models: DataFrame, model_id) -> DataFrame:
    """One model; the filter reaches the scan."""
    return models.filter(F.col("model_id") == F.lit(model_id))


def model_config_export(models: DataFrame) -> DataFrame:
    """`(model_id, config, performance, reproducibility_hash)` as JSON text."""
    config = F.struct("problem_type", "algorithm", F.col("features").alias("feature_columns"), "target_column")
    performance = F.struct("cv_score", "f1_score", "r2_score")
    return models.select(
        "model_id",
        F.to_json(config).alias("config"),
        F.to_json(performance).alias("performance"),
        F.substring(F.sha2(F.to_json(config), 256), 1, 16).alias("reproducibility_hash"),
    )


def quality_gate(metrics: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """`(model_id, gate, metric, threshold, actual, passed, required)` for each gate that applies.

    `metrics` is long, `(model_id, metric, value)`; `gates` is `(gate, metric, comparison,
    threshold, required)` and small by nature.
    """
    if gates is None:
        gates = metrics.sparkSession.createDataFrame(
            [("minimum_accuracy", "accuracy", "greater_equal", 0.6, True)],
            "gate string, metric string, comparison string, threshold double, required boolean",
        )
    a, b = F.col("value"), F.col("threshold")
    passed = (
        F.when(F.col("comparison") == "greater_than", a > b)
        .when(F.col("comparison") == "less_than", a < b)
        .when(F.col("comparison") == "equal", a == b)
        .when(F.col("comparison") == "greater_equal", a >= b)
        .when(F.col("comparison") == "less_equal", a <= b)
    )
    joined = metrics.join(F.broadcast(gates), "metric")
    return joined.select("model_id", "gate", "metric", "comparison", "threshold", a.alias("actual"), passed.alias("passed"), "required")


def gate_verdict(checked: DataFrame) -> DataFrame:
    """`(model_id, passed_gates, failed_gates, passed)`: only required gates can fail a model."""
    return checked.groupBy("model_id").agg(
        F.count_if("passed").alias("passed_gates"),
        F.count_if(~F.col("passed")).alias("failed_gates"),
        F.bool_and(F.col("passed") | ~F.col("required")).alias("passed"),
    )


def invalid_transitions(log: DataFrame, cut: Column) -> DataFrame:
    """Status changes of a run that the state rules do not allow."""
    pairs = previous(log, ["run_id"], ["seq"], ["status"], cut).filter(F.col("prev_status").isNotNull())
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        if after:
            allowed = allowed | ((q("prev_status") == before) & q("status").isin(*after))
    return pairs.filter(~allowed)


# Which status may follow which.
TRANSITIONS = {
    "pending": ("running", "cancelled"),
    "running": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": ("running",),
    "cancelled": (),
}


def replay_state_log(log: DataFrame) -> DataFrame:
    """`(run_id, status, changes)`: the last entry of each run wins."""
    return log.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("changes"))
