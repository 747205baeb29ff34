"""Date and time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TableError, as_timestamp, require

PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "weekday": F.weekday,
}
DELTA_UNITS = {"hours": 3600.0, "minutes": 60.0, "seconds": 1.0}


def parse_datetime(df: DataFrame, column: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a column; text is tried as ISO first and then in the given formats."""
    base = as_timestamp(df, column)
    if not formats:
        return base
    tried = [F.try_to_timestamp(F.col(column).cast("string"), F.lit(f)) for f in formats]
    return F.coalesce(base, *tried)


def date_components(
    df: DataFrame, column: str, parts: Sequence[str] = tuple(PARTS), check: bool = True, formats: Sequence[str] = ()
) -> DataFrame:
    """Add `{column}_{part}` columns; weekday counts from Monday = 0."""
    require(df, column)
    unknown = [p for p in parts if p not in PARTS]
    if unknown:
        raise TableError(f"unknown date components {unknown}; known: {sorted(PARTS)}")
    stamp = parse_datetime(df, column, formats)
    if check and df.select(stamp.alias("t")).filter(F.col("t").isNotNull()).isEmpty():
        raise TableError(f"{column} holds no timestamps")
    return df.withColumns({f"{column}_{p}": PARTS[p](stamp) for p in parts})


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def time_deltas(
    df: DataFrame, column: str, reference: str | Column = "today", units: Sequence[str] = ("days", "hours", "minutes")
) -> DataFrame:
    """Add `{column}_delta_{unit}`: reference minus column; days are whole and floor down."""
    require(df, column)
    if isinstance(reference, Column):
        ref = reference
    elif reference == "today":
        ref = F.current_timestamp()
    else:
        require(df, reference)
        ref = as_timestamp(df, reference)
    gap = seconds_between(ref, as_timestamp(df, column))
    added = {}
    for unit in units:
        if unit == "days":
            added[f"{column}_delta_days"] = F.floor(gap / 86400)
        elif unit in DELTA_UNITS:
            added[f"{column}_delta_{unit}"] = gap / F.lit(DELTA_UNITS[unit])
        else:
            raise TableError(f"unknown time unit {unit!r}")
    return df.withColumns(added)


def time_range(df: DataFrame, column: str) -> DataFrame:
    """`(start, end, duration_days)`."""
    stamp = as_timestamp(df, column)
    one = df.agg(F.min(stamp).alias("start"), F.max(stamp).alias("end"))
    return one.withColumn("duration_days", F.floor(seconds_between(F.col("end"), F.col("start")) / 86400))
