"""Counts of distinct values per column, for many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import q, require


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long `(column, value, n)` over the non-null values, as strings.

    Rows are combined before the shuffle, so a value that fills a third of the table
    travels as one row per task.
    """
    columns = require(df, columns)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def cardinality(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """`(column, distinct_values, non_null)`; columns without values are listed with 0."""
    columns = require(df, columns)
    if approx:
        one = df.agg(
            *[F.approx_count_distinct(q(c), 0.01).alias(f"d{i}") for i, c in enumerate(columns)],
            *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        )
        items = [
            F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values"), F.col(f"n{i}").alias("non_null"))
            for i, c in enumerate(columns)
        ]
        return one.select(F.inline(F.array(*items)))
    found = value_counts(df, columns).groupBy("column").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("non_null")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left").na.fill(0)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values per column on the driver (one number each)."""
    return {r["column"]: r["distinct_values"] for r in cardinality(df, columns).collect()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest one on ties."""
    best = value_counts(df, columns).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )
    return {r["column"]: r["value"] for r in best.collect()}
