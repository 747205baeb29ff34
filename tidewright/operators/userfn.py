"""User functions over tables, groups and batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import TableError, as_list, q, require

TRIAL_ROWS = 5


def apply_user_function(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Run a DataFrame function after a trial on a few rows; also report the columns it changed."""
    if not callable(fn):
        raise TableError("a user function must be callable")
    trial = fn(df.limit(TRIAL_ROWS))
    if not isinstance(trial, DataFrame):
        raise TableError(f"a user function must return a DataFrame, got {type(trial).__name__}")
    trial.collect()
    out = fn(df)
    changes = {
        "added": [c for c in out.columns if c not in df.columns],
        "dropped": [c for c in df.columns if c not in out.columns],
    }
    return out, changes


def apply_pandas_function(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Run a row-local pandas function over Arrow batches."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def grouped_user_function(
    df: DataFrame, keys: str | Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, max_group_rows: int = 1_000_000
) -> DataFrame:
    """Run a pandas function per group. A group has to fit a task, so larger ones are refused."""
    keys = require(df, as_list(keys))
    largest = df.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_group_rows:
        raise TableError(f"a group holds {largest} rows, more than {max_group_rows}; use finer keys")
    return df.groupBy(*[q(k) for k in keys]).applyInPandas(fn, schema)
