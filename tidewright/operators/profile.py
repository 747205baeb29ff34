"""Profiling, validation and dataset-level reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import TableError, as_timestamp, datetime_columns, numeric_columns, q, require, require_numeric, string_columns
from .clean import duplicate_count
from .report import long_report
from .values import cardinality as column_cardinality
from .values import distinct_counts

# Fixed values of the identifier rule.
ID_NAMES = ("id", "uuid", "guid", "key")
MAX_PLOT_CATEGORIES = 50
LARGE_ROWS = 100_000


def _filled(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])


def missing_ratio(df: DataFrame) -> DataFrame:
    """`(column, missing_ratio)`."""
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col("rows") > 0, 1 - F.col(f"n{i}") / F.col("rows")).alias("missing_ratio"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _filled(df).select(F.inline(F.array(*items)))


def cleanliness_report(df: DataFrame) -> DataFrame:
    """`(column, metric, value)`; table-wide metrics carry the column name `*`."""
    texts = string_columns(df)
    filled = _filled(df)
    cells = {("*", "rows"): F.col("rows"), ("*", "columns"): F.lit(len(df.columns))}
    worst = F.lit(0.0)
    for i, c in enumerate(df.columns):
        ratio = F.when(F.col("rows") > 0, 1 - F.col(f"n{i}") / F.col("rows")).otherwise(F.lit(0.0))
        cells[(c, "missing_ratio")] = ratio
        worst = F.greatest(worst, ratio)
    cells[("*", "warn_missing")] = (worst > 0.5).cast("int")
    report = long_report(filled, cells)
    dup = long_report(
        duplicate_count(df),
        {
            ("*", "duplicate_rows"): F.col("duplicate_rows"),
            ("*", "warn_duplicates"): (F.col("duplicate_rows") > F.col("row_count") * 0.1).cast("int"),
        },
    )
    report = report.unionByName(dup)
    if texts:
        unique = column_cardinality(df, texts).select(
            "column", F.lit("cardinality").alias("metric"), F.col("distinct_values").cast("double").alias("value")
        )
        report = report.unionByName(unique)
    return report


def semantic_types(df: DataFrame, order: Sequence[str] | None = None, parse_rows: int = 100) -> DataFrame:
    """`(column, semantic_type)` by the ordered name, value and type rules.

    With `order` the date rule looks at the first `parse_rows` values in that order,
    otherwise at all of them.
    """
    texts, numbers, dates = string_columns(df), numeric_columns(df), datetime_columns(df)
    rows = df.count()
    unique = distinct_counts(df, texts) if texts else {}
    named = [c for c in texts if "date" in c.lower() or "time" in c.lower()]
    parsed = {}
    for c in named:
        seen = df.filter(q(c).isNotNull())
        if order:
            seen = seen.orderBy(*order).limit(parse_rows)
        r = seen.agg(F.count("*").alias("n"), F.count(as_timestamp(df, c)).alias("p")).first()
        parsed[c] = r["n"] == r["p"]
    out = []
    for c in df.columns:
        if c.lower() in ID_NAMES or (c in texts and unique[c] == rows):
            kind = "identifier"
        elif "date" in c.lower() or "time" in c.lower():
            kind = "datetime" if c not in texts or parsed[c] else "text"
        elif c in texts and unique[c] < rows * 0.5:
            kind = "categorical"
        elif c in numbers:
            kind = "numeric"
        else:
            kind = "text"
        out.append((c, kind))
    return df.sparkSession.createDataFrame(out, "column string, semantic_type string")


def high_cardinality(df: DataFrame) -> DataFrame:
    """String columns with more than min(1000, 0.8 x non-null) distinct values."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, distinct_values long, non_null long")
    limit = F.least(F.lit(1000.0), F.col("non_null") * 0.8)
    return column_cardinality(df, texts).filter((F.col("non_null") > 0) & (F.col("distinct_values") > limit))


def validate_dataset(
    df: DataFrame,
    max_rows: int = 1_000_000,
    max_columns: int = 1_000,
    missing_threshold: float = 0.8,
    raise_on_error: bool = False,
) -> DataFrame:
    """Issue rows `(level, code, column, value)`; no error rows means a valid table."""
    row = _filled(df).first()
    rows = row["rows"]
    missing = {c: 1 - row[f"n{i}"] / rows for i, c in enumerate(df.columns)} if rows else {}
    issues = []
    if rows > max_rows:
        issues.append(("error", "too_many_rows", "*", float(rows)))
    if len(df.columns) > max_columns:
        issues.append(("error", "too_many_columns", "*", float(len(df.columns))))
    if missing and max(missing.values()) > missing_threshold:
        issues.append(("error", "missing_threshold", "*", max(missing.values())))
    issues += [("error", "all_null", c, 1.0) for c, m in missing.items() if m == 1.0]
    issues += [
        ("warning", "high_cardinality", r["column"], float(r["distinct_values"]))
        for r in high_cardinality(df).collect()
    ]
    errors = [i for i in issues if i[0] == "error"]
    if raise_on_error and errors:
        raise TableError(f"validation failed: {errors}")
    return df.sparkSession.createDataFrame(issues, "level string, code string, column string, value double")


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """String columns where some but not all values read as numbers."""
    texts = string_columns(df)
    one = df.agg(
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(q(c).try_cast("double")).alias(f"p{i}") for i, c in enumerate(texts)],
    )
    items = [
        F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("numeric_values"), F.col(f"n{i}").alias("non_null"))
        for i, c in enumerate(texts)
    ]
    return one.select(F.inline(F.array(*items))).filter(
        (F.col("numeric_values") > 0) & (F.col("numeric_values") < F.col("non_null"))
    )


def duplicate_rate_check(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """`(duplicate_rate, threshold, exceeded)`."""
    rate = F.when(F.col("row_count") > 0, F.col("duplicate_rows") / F.col("row_count")).otherwise(F.lit(0.0))
    return duplicate_count(df).select(
        rate.alias("duplicate_rate"), F.lit(threshold).alias("threshold"), (rate > threshold).alias("exceeded")
    )


def audit_summary(actions: DataFrame) -> DataFrame:
    """Per step: number of actions, affected rows and the sorted list of columns touched."""
    return actions.groupBy("step").agg(
        F.count("*").alias("actions"),
        F.coalesce(F.sum("affected_rows"), F.lit(0)).alias("affected_rows"),
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"),
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """`(column, kind, rows, null_count)` with kind numeric, categorical, datetime or other."""
    kinds = {c: "numeric" for c in numeric_columns(df)}
    kinds |= {c: "categorical" for c in string_columns(df)}
    kinds |= {c: "datetime" for c in datetime_columns(df)}
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds.get(c, "other")).alias("kind"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _filled(df).select(F.inline(F.array(*items)))


def plot_recommendations(df: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ten charts that suit the table's columns, best first."""
    numbers, texts, dates = numeric_columns(df), string_columns(df), datetime_columns(df)
    unique = distinct_counts(df, texts[:3]) if texts else {}
    few = [c for c in texts[:3] if unique[c] <= MAX_PLOT_CATEGORIES]
    charts = [("histogram", c, None) for c in numbers[:5]]
    charts += [("histogram", c, None) for c in few]
    if len(numbers) >= 2:
        charts.append(("correlation_heatmap", ",".join(numbers), None))
    charts += [("scatter_plot", a, b) for i, a in enumerate(numbers[:3]) for b in numbers[i + 1 : 4]]
    charts += [("box_plot", a, c) for a in numbers[:2] for c in texts[:2] if c in few]
    charts += [("time_series", t, a) for t in dates[:2] for a in numbers[:2]]
    ranked = [(i + 1, *chart) for i, chart in enumerate(charts[:limit])]
    return df.sparkSession.createDataFrame(ranked, "position int, chart string, first_column string, second_column string")


def size_recommendations(df: DataFrame, size_mb: float | None = None) -> DataFrame:
    """`(recommendation, column, value)` for large tables and near-unique string columns."""
    texts = string_columns(df)
    rows = df.count()
    out = []
    if rows > LARGE_ROWS:
        out.append(("large_table", "*", float(rows)))
    if size_mb is not None and size_mb > 500:
        out.append(("large_size_mb", "*", float(size_mb)))
    for c, n in (distinct_counts(df, texts) if texts and rows else {}).items():
        if n / rows > 0.5:
            out.append(("high_cardinality", c, n / rows))
    return df.sparkSession.createDataFrame(out, "recommendation string, column string, value double")


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content hash: row count, xor and sum of 52-bit row hashes.

    The xor alone would cancel equal rows, the sum alone is easy to balance out.
    """
    columns = require(df, columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(q(c).cast("string"), F.lit("\\N")) for c in columns])
    hashed = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return df.select(hashed.alias("h")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(feature, mean, std)` kept beside a model for later drift checks."""
    features = require_numeric(df, features)
    one = df.agg(
        *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(q(c)).alias(f"s{i}") for i, c in enumerate(features)],
    )
    items = [
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(features)
    ]
    return one.select(F.inline(F.array(*items)))


def drift_check(stats: DataFrame, current: DataFrame) -> DataFrame:
    """`(feature, train_mean, train_std, current_mean, drifted)`: beyond two deviations."""
    features = [r["feature"] for r in stats.select("feature").collect()]
    usable = [c for c in features if c in numeric_columns(current)]
    now = feature_stats(current, usable).select("feature", F.col("mean").alias("current_mean"))
    return stats.join(F.broadcast(now), "feature").select(
        "feature",
        F.col("mean").alias("train_mean"),
        F.col("std").alias("train_std"),
        "current_mean",
        (F.abs(F.col("current_mean") - F.col("mean")) > 2 * F.coalesce(F.col("std"), F.lit(1.0))).alias("drifted"),
    )


def class_balance(df: DataFrame, features: Sequence[str], target: str, min_rows: int = 10) -> DataFrame:
    """One row on whether a classification table can be trained on, and why not."""
    require(df, [*features, target])
    complete = F.lit(True)
    for c in [*features, target]:
        complete = complete & q(c).isNotNull()
    per_class = df.groupBy(q(target).alias("__t")).agg(
        F.count("*").alias("n"), F.count_if(complete).alias("k")
    )
    one = per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("complete_rows"),
        F.count_if(F.col("k") > 0).alias("classes"),
        F.min(F.when(F.col("k") > 0, F.col("k"))).alias("smallest"),
        F.max(F.when(F.col("k") > 0, F.col("k"))).alias("largest"),
    )
    status = (
        F.when(F.col("total_rows") < min_rows, "too_few_rows")
        .when(F.col("complete_rows") < min_rows, "too_few_complete_rows")
        .when(F.col("classes") < 2, "single_class")
        .when(F.col("smallest") < 2, "class_too_small")
        .when(F.col("largest") / F.col("smallest") > 10, "imbalanced")
        .otherwise("ok")
    )
    return one.withColumn("imbalance_ratio", F.col("largest") / F.col("smallest")).withColumn("status", status)
