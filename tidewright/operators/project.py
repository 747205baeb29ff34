"""Projection, column checks, renames and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import (
    TableError,
    as_list,
    as_timestamp,
    datetime_columns,
    numeric_columns,
    q,
    require,
    string_columns,
)
from .values import distinct_counts

MAX_NUMERIC_CATEGORIES = 50  # numeric columns with more values are not categorical


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature columns in the given order."""
    return df.select(*[q(c) for c in require(df, features)])


def validate_columns(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row per column: `(column, expected, valid, reason)`.

    `expected` maps a column to numeric, categorical, datetime or any.
    """
    spark = df.sparkSession
    present = [c for c in expected if c in df.columns]
    numbers, dates = numeric_columns(df), datetime_columns(df)
    aggs = [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(present)]
    aggs += [
        F.count(as_timestamp(df, c)).alias(f"t{i}")
        for i, c in enumerate(present)
        if expected[c] == "datetime" and c not in dates and c not in numbers
    ]
    found = df.agg(*aggs).first().asDict() if aggs else {}
    to_count = [c for c in present if expected[c] == "categorical" and c in numbers]
    unique = distinct_counts(df, to_count) if to_count else {}
    rows = []
    for c, kind in expected.items():
        if kind not in ("numeric", "categorical", "datetime", "any"):
            raise TableError(f"unknown expected type {kind!r}")
        reason = "ok"
        if c not in present:
            reason = "missing"
        elif not found[f"n{present.index(c)}"]:
            reason = "all_null"
        elif kind == "numeric" and c not in numbers:
            reason = "not_numeric"
        elif kind == "categorical" and c in numbers and unique[c] > MAX_NUMERIC_CATEGORIES:
            reason = "too_many_values"
        elif kind == "datetime" and c not in dates:
            if c in numbers or not found[f"t{present.index(c)}"]:
                reason = "not_datetime"
        rows.append((c, kind, reason == "ok", reason))
    return spark.createDataFrame(rows, "column string, expected string, valid boolean, reason string")


def validate_datetime_col(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """`(column, parsed, valid)`: valid when at least one value is a timestamp."""
    columns = require(df, columns)
    one = df.agg(*[F.count(as_timestamp(df, c)).alias(f"p{i}") for i, c in enumerate(columns)])
    items = [
        F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("parsed"), (F.col(f"p{i}") > 0).alias("valid"))
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*items)))


def validate_text_col(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """`(column, avg_length, valid)`: string columns whose mean length exceeds two."""
    columns = require(df, columns)
    texts = string_columns(df)
    one = df.agg(*[F.avg(F.length(q(c).cast("string"))).alias(f"a{i}") for i, c in enumerate(columns)])
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"a{i}").alias("avg_length"),
            (F.lit(c in texts) & (F.coalesce(F.col(f"a{i}"), F.lit(0.0)) > 2)).alias("valid"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*items)))


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Lower case, spaces to underscores; a collision is an error."""
    renamed = [c.lower().replace(" ", "_") for c in df.columns]
    if len(set(renamed)) < len(renamed):
        raise TableError(f"names collide after normalizing: {sorted(renamed)}")
    return df.toDF(*renamed)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold nothing but NULL."""
    filled = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[q(c) for i, c in enumerate(df.columns) if filled[i]])


def drop_missing(df: DataFrame, subset: str | Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=require(df, subset) if subset else df.columns)


def complete_case_mask(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return df.na.drop(subset=require(df, [*features, target]))


def zero_variance_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(feature, variance, zero_variance)`."""
    features = require(df, features)
    one = df.agg(*[F.var_samp(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"v{i}").alias("variance"),
            F.coalesce(F.col(f"v{i}") == 0, F.lit(False)).alias("zero_variance"),
        )
        for i, c in enumerate(features)
    ]
    return one.select(F.inline(F.array(*items)))


def non_numeric_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    usable = numeric_columns(df, booleans=True)
    return [c for c in require(df, features) if c not in usable]


def preview(df: DataFrame, order: str | Sequence[str], rows: int = 50) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*[q(c) for c in as_list(order)]).limit(rows)


def check_limits(
    df: DataFrame, max_rows: int = 1_000_000, max_columns: int = 1_000
) -> DataFrame:
    """`(check_name, actual, allowed, within)` for the row and column limits."""
    rows = df.agg(F.count("*").alias("n"))
    items = [
        F.struct(F.lit("rows").alias("check_name"), F.col("n").alias("actual"), F.lit(max_rows).cast("long").alias("allowed"), (F.col("n") <= max_rows).alias("within")),
        F.struct(F.lit("columns").alias("check_name"), F.lit(len(df.columns)).cast("long").alias("actual"), F.lit(max_columns).cast("long").alias("allowed"), F.lit(len(df.columns) <= max_columns).alias("within")),
    ]
    return rows.select(F.inline(F.array(*items)))
