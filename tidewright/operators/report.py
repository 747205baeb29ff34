"""Long-format reports: one row per column and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def long_report(one_row: DataFrame, cells: dict[tuple[str, str], Column], names=("column", "metric")) -> DataFrame:
    """Turn the single row of an aggregate into `(column, metric, value)` rows."""
    items = [
        F.struct(
            F.lit(c).alias(names[0]), F.lit(m).alias(names[1]), v.cast("double").alias("value")
        )
        for (c, m), v in cells.items()
    ]
    return one_row.select(F.inline(F.array(*items)))
