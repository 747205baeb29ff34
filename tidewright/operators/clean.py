"""Duplicates, missing values and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..schema import (
    TableError,
    as_list,
    numeric_columns,
    q,
    require,
    require_numeric,
    string_columns,
)
from .quantiles import quantiles
from .values import modes


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Equal rows once; NULLs compare equal."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """`(row_count, distinct_rows, duplicate_rows)`."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def fit_impute(
    df: DataFrame,
    strategy: str,
    columns: str | Sequence[str] | None = None,
    value: Any = None,
    approx: bool = False,
) -> dict[str, Any]:
    """Fill value per column: mean, median, mode or constant."""
    if strategy == "constant":
        if value is None:
            raise TableError("constant imputation needs a value")
        return {c: value for c in require(df, columns or df.columns)}
    if strategy == "mode":
        return modes(df, require(df, columns or string_columns(df)))
    columns = require_numeric(df, columns or numeric_columns(df))
    if not columns:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}
    if strategy == "median":
        found = quantiles(df, columns, [0.5], approx=approx)
        return {c: v[0] for c, v in found.items() if v[0] is not None}
    raise TableError(f"unknown imputation strategy {strategy!r}")


def apply_impute(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    """Fill NULLs with fitted values; works on batches and on streams."""
    filled = {}
    for c, v in fills.items():
        if c not in df.columns:
            continue
        text = c in string_columns(df)
        if text:
            v = str(v)
        elif isinstance(v, str) and c in numeric_columns(df):
            v = float(v)
        filled[c] = F.coalesce(q(c), F.lit(v))
    return df.withColumns(filled) if filled else df


def impute(df: DataFrame, strategy: str, columns=None, value: Any = None, approx: bool = False) -> DataFrame:
    return apply_impute(df, fit_impute(df, strategy, columns, value, approx))


def fillna_zero(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=as_list(columns) or numeric_columns(df))


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], k: float = 1.5, approx: bool = False
) -> dict[str, tuple[float, float, bool]]:
    """`(low, high, any value outside)` per column with at least one value."""
    found = quantiles(df, columns, [0.0, 0.25, 0.75, 1.0], approx=approx)
    bounds = {}
    for c, (least, q1, q3, most) in found.items():
        if least is None:
            continue
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        bounds[c] = (low, high, least < low or most > high)
    return bounds


def outlier_iqr(
    df: DataFrame,
    action: str = "remove",
    columns: str | Sequence[str] | None = None,
    k: float = 1.5,
    approx: bool = False,
) -> DataFrame:
    """Interquartile-range outliers: remove rows, cap values or flag them.

    Columns are taken in order, and each one sees the rows the earlier ones left. A column
    with an outlier loses its NULL rows too when rows are removed.
    """
    columns = require_numeric(df, columns or numeric_columns(df))
    if action == "remove":
        for c in columns:
            for low, high, outside in iqr_bounds(df, [c], k, approx).values():
                if outside:
                    df = df.filter(q(c).between(low, high))
        return df
    bounds = iqr_bounds(df, columns, k, approx) if columns else {}
    if action == "cap":
        return df.withColumns(
            {
                c: F.when(q(c) < low, F.lit(low)).when(q(c) > high, F.lit(high)).otherwise(q(c))
                for c, (low, high, _) in bounds.items()
            }
        )
    if action == "flag":
        return df.withColumns(
            {
                f"{c}_is_outlier": F.coalesce((q(c) < low) | (q(c) > high), F.lit(False))
                for c, (low, high, _) in bounds.items()
            }
        )
    raise TableError(f"unknown outlier action {action!r}")


def outlier_zscore(
    df: DataFrame, columns: str | Sequence[str] | None = None, k: float = 3.0, action: str = "flag"
) -> DataFrame:
    """Values further than `k` sample deviations from the mean."""
    columns = require_numeric(df, columns or numeric_columns(df))
    aggs = [f(q(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    flags = {}
    for i, c in enumerate(columns):
        mean, sd = row[f"m{i}"], row[f"s{i}"]
        far = F.abs((q(c) - F.lit(mean)) / F.lit(sd)) > k if sd else F.lit(False)
        flags[c] = F.coalesce(far, F.lit(False))
    if action == "flag":
        return df.withColumns({f"{c}_is_outlier": f for c, f in flags.items()})
    if action == "remove":
        keep = F.lit(True)
        for f in flags.values():
            keep = keep & ~f
        return df.filter(keep)
    raise TableError(f"unknown outlier action {action!r}")


def compare_cleaning_strategies(df: DataFrame, max_loss: float = 5.0) -> DataFrame:
    """`(strategy, rows_retained, data_loss_pct, columns_affected, recommended)`."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & q(c).isNotNull()
    numbers = len(numeric_columns(df))
    one = df.agg(F.count("*").alias("n"), F.count_if(complete).alias("k"))
    loss = F.when(F.col("n") > 0, (1 - F.col("k") / F.col("n")) * 100).otherwise(F.lit(0.0))
    best = F.when(F.col("loss") < max_loss, "drop_rows").otherwise("median_impute")

    def row(name: str, kept, lost, touched: int):
        return F.struct(
            F.lit(name).alias("strategy"),
            kept.alias("rows_retained"),
            lost.alias("data_loss_pct"),
            F.lit(touched).cast("long").alias("columns_affected"),
            (best == name).alias("recommended"),
        )

    return one.withColumn("loss", loss).select(
        F.inline(
            F.array(
                row("drop_rows", F.col("k"), F.col("loss"), 0),
                row("mean_impute", F.col("n"), F.lit(0.0), numbers),
                row("median_impute", F.col("n"), F.lit(0.0), numbers),
            )
        )
    )
