"""Duplicates, imputation, outliers and cleaning comparisons."""

from __future__ import annotations

from ..operators import clean
from ..sources import table
from .inputs import GAPS, orders_with_gaps, rounded
from .registry import query

WEAK = "SELECT o_custkey, o_orderstatus, o_orderpriority FROM o"


def weak_orders(spark, sf):
    return orders_with_gaps(spark, sf).select("o_custkey", "o_orderstatus", "o_orderpriority")


@query("drop_duplicates", f"WITH {GAPS} SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM o")
def drop_duplicates_query(spark, sf):
    return clean.drop_duplicates(weak_orders(spark, sf))


@query(
    "duplicate_count",
    f"""WITH {GAPS}, d AS (SELECT DISTINCT * FROM ({WEAK}))
    SELECT (SELECT count(*) FROM o) AS row_count, (SELECT count(*) FROM d) AS distinct_rows,
    (SELECT count(*) FROM o) - (SELECT count(*) FROM d) AS duplicate_rows""",
)
def duplicate_count_query(spark, sf):
    return clean.duplicate_count(weak_orders(spark, sf))


def _fill(spark, sf, strategy, column, value=None):
    df = clean.impute(orders_with_gaps(spark, sf), strategy, column, value)
    df = df.select("o_orderkey", column)
    return rounded(df, column) if column == "o_totalprice" else df


@query(
    "impute_mean",
    f"WITH {GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM o)), 6) AS o_totalprice FROM o",
)
def impute_mean_query(spark, sf):
    return _fill(spark, sf, "mean", "o_totalprice")


@query(
    "impute_median",
    f"WITH {GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM o)), 6) AS o_totalprice FROM o",
)
def impute_median_query(spark, sf):
    return _fill(spark, sf, "median", "o_totalprice")


@query(
    "impute_mode",
    f"""WITH {GAPS}, m AS (SELECT o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM o""",
)
def impute_mode_query(spark, sf):
    return _fill(spark, sf, "mode", "o_orderpriority")


@query("impute_constant", f"WITH {GAPS} SELECT o_orderkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM o")
def impute_constant_query(spark, sf):
    return _fill(spark, sf, "constant", "o_orderpriority", "unknown")


@query("fillna_zero", f"WITH {GAPS} SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM o")
def fillna_zero_query(spark, sf):
    return clean.fillna_zero(orders_with_gaps(spark, sf), "o_totalprice").select("o_orderkey", "o_totalprice")


# Few prices lie outside the usual fences, so the queries use narrower ones.
NARROW = 0.2


def _bounds(source: str, column: str, k: float) -> str:
    return f"""SELECT quantile_cont({column}, 0.25) - {k} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS lo,
      quantile_cont({column}, 0.75) + {k} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS hi FROM {source}"""


@query(
    "outlier_iqr_remove",
    f"""WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM (WITH {GAPS} SELECT * FROM o)),
    b AS ({_bounds('a', 'o_totalprice', NARROW)}),
    a2 AS (SELECT a.* FROM a, b WHERE o_totalprice BETWEEN lo AND hi
      OR NOT EXISTS (SELECT 1 FROM a, b WHERE o_totalprice < lo OR o_totalprice > hi)),
    c AS ({_bounds('a2', 'o_custkey', NARROW)})
    SELECT a2.* FROM a2, c WHERE o_custkey BETWEEN lo AND hi
      OR NOT EXISTS (SELECT 1 FROM a2, c WHERE o_custkey < lo OR o_custkey > hi)""",
)
def outlier_remove_query(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    return clean.outlier_iqr(df, "remove", ["o_totalprice", "o_custkey"], NARROW)


@query(
    "outlier_iqr_cap",
    f"""WITH {GAPS}, b AS ({_bounds('o', 'o_totalprice', NARROW)})
    SELECT o_orderkey, round(CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi ELSE o_totalprice END, 6) AS o_totalprice FROM o, b""",
)
def outlier_cap_query(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice")
    return rounded(clean.outlier_iqr(df, "cap", "o_totalprice", NARROW), "o_totalprice")


@query(
    "outlier_iqr_flag",
    f"""WITH b AS ({_bounds('lineitem', 'l_extendedprice', 0.3)})
    SELECT l_orderkey, l_linenumber, l_extendedprice, (l_extendedprice < lo OR l_extendedprice > hi) AS l_extendedprice_is_outlier FROM lineitem, b""",
)
def outlier_flag_query(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.outlier_iqr(df, "flag", "l_extendedprice", 0.3)


@query(
    "outlier_zscore",
    f"""WITH {GAPS}, m AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM o)
    SELECT o_orderkey, o_totalprice, coalesce(abs((o_totalprice - mu) / sd) > 1.5, false) AS o_totalprice_is_outlier FROM o, m""",
)
def outlier_zscore_query(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice")
    return clean.outlier_zscore(df, "o_totalprice", 1.5)


@query(
    "compare_cleaning_strategies",
    f"""WITH {GAPS}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL) AS k FROM o),
    l AS (SELECT n, k, (1 - k / n) * 100 AS loss FROM n)
    SELECT 'drop_rows' AS strategy, k AS rows_retained, round(loss, 6) AS data_loss_pct, CAST(0 AS BIGINT) AS columns_affected, loss < 5 AS recommended FROM l
    UNION ALL SELECT 'mean_impute', n, 0.0, 3, false FROM l
    UNION ALL SELECT 'median_impute', n, 0.0, 3, loss >= 5 FROM l""",
)
def compare_query(spark, sf):
    return rounded(clean.compare_cleaning_strategies(orders_with_gaps(spark, sf)), "data_loss_pct")
