"""Numeric scalers and date features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dates, scale
from ..sources import table
from .inputs import GAPS, orders_with_gaps, rounded, stamp
from .registry import query


def _prices(spark, sf):
    return orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice")


def _scaled(spark, sf, method, feature_range=(0.0, 1.0)):
    return rounded(scale.scale_numeric(_prices(spark, sf), "o_totalprice", method, feature_range), "o_totalprice")


RANGE = "m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o)"


@query("scale_minmax", f"WITH {GAPS}, {RANGE} SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice FROM o, m")
def minmax_query(spark, sf):
    return _scaled(spark, sf, "minmax")


@query(
    "scale_standard",
    f"""WITH {GAPS}, m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM o)
    SELECT o_orderkey, round((o_totalprice - mu) / sd, 6) AS o_totalprice FROM o, m""",
)
def standard_query(spark, sf):
    return _scaled(spark, sf, "zscore")


@query(
    "scale_robust",
    f"""WITH {GAPS}, m AS (SELECT median(o_totalprice) AS mid, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM o)
    SELECT o_orderkey, round((o_totalprice - mid) / iqr, 6) AS o_totalprice FROM o, m""",
)
def robust_query(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scale_log", f"WITH {GAPS} SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS o_totalprice FROM o")
def log_query(spark, sf):
    return _scaled(spark, sf, "log")


@query("scale_custom", f"WITH {GAPS}, {RANGE} SELECT o_orderkey, round(-1 + (o_totalprice - lo) / (hi - lo) * 2, 6) AS o_totalprice FROM o, m")
def custom_range_query(spark, sf):
    return _scaled(spark, sf, "custom", (-1.0, 1.0))


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "scale_all_numeric",
    "WITH m AS (SELECT "
    + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in LINES)
    + " FROM lineitem) SELECT l_shipdate::VARCHAR AS l_shipdate, "
    + ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 6) AS {c}" for c in LINES)
    + " FROM lineitem, m",
)
def scale_all_query(spark, sf):
    df = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"), *LINES)
    return rounded(scale.scale_numeric(df), *LINES)


@query(
    "scale_multi_column",
    "WITH m AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINES[:2])
    + " FROM lineitem) SELECT l_orderkey, "
    + ", ".join(f"round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}" for c in LINES[:2])
    + " FROM lineitem, m",
)
def scale_multi_query(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", *LINES[:2])
    return rounded(scale.scale_numeric(df, LINES[:2], "minmax"), *LINES[:2])


@query(
    "date_components",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day,
    CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(second(ts) AS INTEGER) AS ts_second,
    CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday FROM events""",
)
def components_query(spark, sf):
    return dates.date_components(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query(
    "time_deltas",
    """WITH j AS (SELECT l_orderkey, l_partkey, l_quantity, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_partkey, l_quantity, CAST(floor(us / 86400e6) AS BIGINT) AS o_orderdate_delta_days, round(us / 3600e6, 6) AS o_orderdate_delta_hours,
    round(us / 60e6, 6) AS o_orderdate_delta_minutes FROM j""",
)
def deltas_query(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    joined = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = dates.time_deltas(joined, "o_orderdate", "l_shipdate").drop("o_orderkey", "o_orderdate", "l_shipdate")
    return rounded(df, "o_orderdate_delta_hours", "o_orderdate_delta_minutes")


@query(
    "time_range",
    """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end",
    CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) AS duration_days FROM events""",
)
def range_query(spark, sf):
    df = dates.time_range(table(spark, sf, "events"), "ts")
    return df.withColumns({"start": stamp("start"), "end": stamp("end")})


@query(
    "parse_datetime",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def parse_query(spark, sf):
    k = F.col("o_orderkey") % 4
    messy = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .otherwise(F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string")))
    )
    df = table(spark, sf, "orders").select("o_orderkey", messy.alias("day"))
    return df.withColumn("day", F.date_format(dates.parse_datetime(df, "day", ["dd.MM.yyyy"]), "yyyy-MM-dd"))
