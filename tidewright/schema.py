"""Column classes and schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


class TableError(ValueError):
    """A table does not satisfy what an operator needs."""


def as_list(columns: str | Iterable[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def require(df: DataFrame, columns: str | Iterable[str]) -> list[str]:
    wanted = as_list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise TableError(f"columns not found: {missing}; available: {df.columns}")
    return wanted


def require_numeric(df: DataFrame, columns: str | Iterable[str]) -> list[str]:
    wanted = require(df, columns)
    bad = [c for c in wanted if c not in numeric_columns(df)]
    if bad:
        raise TableError(f"columns are not numeric: {bad}")
    return wanted


def nulls_for_nan(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One notion of missing: NaN becomes NULL, in all float columns or in the given ones."""
    floats = float_columns(df) if columns is None else require(df, columns)
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(q(c)), q(c)) for c in floats})


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column as TIMESTAMP; strings that do not parse become NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return q(name)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return q(name).cast("timestamp")
    return F.try_to_timestamp(q(name).cast("string"))
