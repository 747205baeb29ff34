"""Shared inputs of the registered queries, with the SQL that builds the same rows.

The tables hold no missing values, so the gaps that cleaning needs are masked in by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import table

GAPS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def orders_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose price and priority are missing for some keys."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    priority = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").withColumns({"o_totalprice": price, "o_orderpriority": priority})


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def stamp(column: str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS")
