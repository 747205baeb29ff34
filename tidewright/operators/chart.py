"""The data behind standard charts, computed over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import escape_html, skew_label, trend_label
from ..schema import TableError, as_list, as_timestamp, float_columns, q, require, require_numeric, string_columns
from .dates import seconds_between
from .quantiles import exact_quantiles, quantiles
from .values import distinct_counts, value_counts

MAX_CATEGORIES = 50
MIN_BINS, MAX_BINS = 2, 200
KDE_POINTS, KDE_BINS = 200, 512


def auto_bins(n: int, low: float, high: float, iqr: float) -> int:
    """The larger of the Sturges and the Freedman-Diaconis bin count."""
    if n == 0 or high == low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1)
    width = 2 * iqr / n ** (1 / 3)
    return max(1, math.ceil((high - low) / (min(width, sturges) if width else sturges)))


def _binned(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """`(bin, n)` of the values inside equal-width bins, the last one closed on the right."""
    width = (high - low) / bins or 1.0
    spot = F.least(F.floor((q(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return df.filter(q(column).isNotNull()).groupBy(spot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_bins(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """`(bin, lower, upper, n)` including empty bins."""
    require_numeric(df, column)
    if bins is not None and not MIN_BINS <= bins <= MAX_BINS:
        raise TableError(f"bins must lie in {MIN_BINS}..{MAX_BINS}")
    row = df.agg(F.count(q(column)).alias("n"), F.min(q(column)).alias("lo"), F.max(q(column)).alias("hi")).first()
    if not row["n"]:
        raise TableError(f"{column} holds no values")
    low, high = float(row["lo"]), float(row["hi"])
    if bins is None:
        q1, q3 = quantiles(df, column, [0.25, 0.75])[column]
        bins = auto_bins(row["n"], low, high, q3 - q1)
    width = (high - low) / bins or 1.0
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = _binned(df, column, bins, low, high)
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_kde(df: DataFrame, column: str, points: int = KDE_POINTS, bins: int = KDE_BINS) -> DataFrame:
    """`(point, x, density)`: Gaussian kernel over binned values, Scott bandwidth."""
    require_numeric(df, column)
    row = df.agg(
        F.count(q(column)).alias("n"), F.min(q(column)).alias("lo"), F.max(q(column)).alias("hi"), F.stddev_samp(q(column)).alias("sd")
    ).first()
    n, sd = row["n"], row["sd"]
    if not n or not sd:
        raise TableError(f"{column} has no spread to estimate a density from")
    low, high = float(row["lo"]), float(row["hi"])
    width, step, band = (high - low) / bins, (high - low) / (points - 1), sd * n ** (-0.2)
    middle = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    # Every bin meets a fixed number of grid points, whatever the table's size.
    spread = _binned(df, column, bins, low, high).select(
        middle.alias("m"), "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    x = F.lit(low) + F.col("point") * F.lit(step)
    z = (x - F.col("m")) / F.lit(band)
    kernel = F.col("n") * F.exp(-z * z / 2)
    scale = 1 / (n * band * math.sqrt(2 * math.pi))
    return spread.groupBy("point").agg((F.sum(kernel) * F.lit(scale)).alias("density")).select("point", x.alias("x"), "density")


def category_counts(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """`(category, n)`; more than `max_categories` values cannot be charted and are refused."""
    require(df, column)
    counts = value_counts(df, [column]).select(F.col("value").alias("category"), "n")
    found = counts.limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise TableError(f"{column} has more than {max_categories} categories")
    return df.sparkSession.createDataFrame([tuple(r) for r in found], counts.schema)


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, dtype, null_count, unique_values, total_values)`."""
    columns = require(df, columns or df.columns)
    row = df.agg(F.count("*").alias("rows"), *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    unique = distinct_counts(df, columns)
    rows = [
        (c, df.schema[c].dataType.simpleString(), row["rows"] - row[f"n{i}"], unique[c], row["rows"])
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, null_count long, unique_values long, total_values long")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Complete `(x, y[, color])` rows."""
    require_numeric(df, [x, y])
    chosen = df.select(q(x).alias("x"), q(y).alias("y"), *([q(color).alias("color")] if color else []))
    return chosen.na.drop(subset=["x", "y"])


def scatter_summary(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Number of points, ranges and correlation, overall or per color."""
    points = scatter_points(df, x, y, color)
    grouped = points.groupBy("color") if color else points.groupBy()
    return grouped.agg(
        F.count("*").alias("points"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.corr("x", "y").alias("corr"),
    )


def box_stats(df: DataFrame, category: str, value: str, k: float = 1.5) -> DataFrame:
    """Per category: quartiles, whiskers (furthest values inside the fences) and outliers."""
    require_numeric(df, value)
    require(df, category)
    data = df.select(q(category).cast("string").alias("category"), q(value).cast("double").alias("v")).na.drop()
    if data.select("category").distinct().limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise TableError(f"{category} has more than {MAX_CATEGORIES} categories")
    found = exact_quantiles(data, "v", [0.25, 0.5, 0.75], by="category")
    rows = [
        (g, *v["v"], v["v"][0] - k * (v["v"][2] - v["v"][0]), v["v"][2] + k * (v["v"][2] - v["v"][0]))
        for g, v in found.items()
    ]
    fences = df.sparkSession.createDataFrame(rows, "category string, q1 double, median double, q3 double, lo double, hi double")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return (
        data.join(F.broadcast(fences), "category")
        .groupBy("category", "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def distribution_summary(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Location, spread, bias-corrected skew with its label, and interquartile outliers."""
    columns = require_numeric(df, as_list(columns))
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        q1, _, q3 = found[c]
        iqr = (q3 or 0.0) - (q1 or 0.0)
        out = (q(c) < F.lit((q1 or 0.0) - 1.5 * iqr)) | (q(c) > F.lit((q3 or 0.0) + 1.5 * iqr))
        n = F.count(q(c))
        skew = F.when(n > 2, F.skewness(q(c)) * F.sqrt(n * (n - 1)) / (n - 2))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                n.alias("n"),
                F.avg(q(c)).alias("mean"),
                F.lit(found[c][1]).cast("double").alias("median"),
                F.stddev_samp(q(c)).alias("std"),
                F.min(q(c)).cast("double").alias("minimum"),
                F.max(q(c)).cast("double").alias("maximum"),
                skew.alias("skew"),
                skew_label(skew).alias("shape"),
                F.count_if(out).alias("outliers"),
            ).alias(f"s{i}")
        )
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def time_series(df: DataFrame, ts: str, value: str, group: str | None = None) -> DataFrame:
    """Complete rows in time order, ready to draw: `([group,] ts, value)`."""
    require_numeric(df, value)
    chosen = df.select(*([q(group).alias("series")] if group else []), as_timestamp(df, ts).alias("ts"), q(value).alias("value"))
    order = (["series"] if group else []) + ["ts", "value"]
    return chosen.na.drop(subset=["ts", "value"]).orderBy(*order)


def time_series_rollup(df: DataFrame, ts: str, value: str, every: str = "1 day", group: str | None = None) -> DataFrame:
    """Count, mean and range per time bucket, so a line of any length can be drawn."""
    points = time_series(df, ts, value, group)
    keys = [F.window("ts", every).alias("w")] + ([F.col("series")] if group else [])
    rolled = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
    return rolled.withColumn("bucket", F.col("w.start")).drop("w")


def time_series_trend(df: DataFrame, ts: str, value: str, group: str | None = None, tie: str | None = None) -> DataFrame:
    """First and last value, percentage change and its label."""
    require_numeric(df, value)
    stamp = as_timestamp(df, ts)
    order = F.struct(stamp, q(tie)) if tie else F.struct(stamp, q(value))
    rows = df.filter(stamp.isNotNull() & q(value).isNotNull())
    grouped = rows.groupBy(q(group).alias("series")) if group else rows.groupBy()
    one = grouped.agg(
        F.min_by(q(value), order).alias("first_value"),
        F.max_by(q(value), order).alias("last_value"),
        F.count("*").alias("n"),
        F.min(stamp).alias("__a"),
        F.max(stamp).alias("__b"),
    )
    change = F.when(
        F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100
    ).otherwise(F.lit(0.0))
    days = F.floor(seconds_between(F.col("__b"), F.col("__a")) / 86400)
    return one.select(
        *(["series"] if group else []), "n", "first_value", "last_value",
        change.alias("change_percent"), trend_label(change).alias("trend"), days.alias("duration_days"),
    )


def data_table(df: DataFrame, key: str, max_rows: int = 100, seed: int = 42) -> DataFrame:
    """A small sample as display text: three decimals, escaped, gaps as N/A."""
    from .sampling import sample_random

    shown = sample_random(df, key, max_rows, seed)
    floats, texts = float_columns(df), string_columns(df)
    cells = []
    for c in df.columns:
        if c in floats:
            cell = F.replace(F.format_number(q(c), 3), F.lit(","), F.lit(""))
        elif c in texts:
            cell = escape_html(q(c))
        else:
            cell = q(c).cast("string")
        cells.append(F.coalesce(cell, F.lit("N/A")).alias(c))
    return shown.select(*cells)
