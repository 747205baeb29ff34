"""Profiling, validation and dataset-level reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..operators.values import cardinality
from ..sources import table
from .inputs import GAPS, orders_with_gaps, rounded
from .registry import query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_KINDS = ["numeric", "numeric", "categorical", "numeric", "datetime", "categorical"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _missing(c: str) -> str:
    return f"round(1 - count({c}) / count(*), 6)"


@query(
    "cleanliness_report",
    f"WITH {GAPS}, d AS (SELECT DISTINCT * FROM o) "
    + _union(
        [
            """SELECT '*' AS "column", 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM o""",
            "SELECT '*', 'columns', 6.0",
            "SELECT '*', 'warn_missing', 0.0",
            "SELECT '*', 'duplicate_rows', CAST((SELECT count(*) FROM o) - (SELECT count(*) FROM d) AS DOUBLE)",
            "SELECT '*', 'warn_duplicates', CAST((SELECT count(*) FROM o) - (SELECT count(*) FROM d) > 0.1 * (SELECT count(*) FROM o) AS INTEGER)",
        ]
        + [f"SELECT '{c}', 'missing_ratio', {_missing(c)} FROM o" for c in ORDER_COLUMNS]
        + [f"SELECT '{c}', 'cardinality', count(DISTINCT {c}) FROM o" for c in ("o_orderstatus", "o_orderpriority")]
    ),
)
def cleanliness_query(spark, sf):
    return rounded(profile.cleanliness_report(orders_with_gaps(spark, sf)), "value")


@query(
    "missing_ratio",
    f"WITH {GAPS} " + _union([f"""SELECT '{c}' AS "column", {_missing(c)} AS missing_ratio FROM o""" for c in ORDER_COLUMNS]),
)
def missing_query(spark, sf):
    return rounded(profile.missing_ratio(orders_with_gaps(spark, sf)), "missing_ratio")


@query(
    "cardinality",
    f"WITH {GAPS} "
    + _union(
        [
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count({c}) AS non_null FROM o"""
            for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
        ]
    ),
)
def cardinality_query(spark, sf):
    return cardinality(orders_with_gaps(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "semantic_types",
    """WITH n AS (SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segs FROM customer)
    SELECT 'id' AS "column", 'identifier' AS semantic_type FROM n
    UNION ALL SELECT 'c_name', CASE WHEN names = n THEN 'identifier' WHEN names < n * 0.5 THEN 'categorical' ELSE 'text' END FROM n
    UNION ALL SELECT 'c_acctbal', 'numeric' FROM n
    UNION ALL SELECT 'c_mktsegment', CASE WHEN segs = n THEN 'identifier' WHEN segs < n * 0.5 THEN 'categorical' ELSE 'text' END FROM n
    UNION ALL SELECT 'join_date', 'datetime' FROM n
    UNION ALL SELECT 'time_zone', 'text' FROM n""",
)
def semantic_query(spark, sf):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), "c_name", "c_acctbal", "c_mktsegment", day.alias("join_date"), F.lit("utc").alias("time_zone")
    )
    return profile.semantic_types(df, order=["id"])


@query(
    "validate_dataset",
    """WITH n AS (SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segs,
      count(*) FILTER (WHERE c_custkey % 10 = 0) AS phones FROM customer),
    i AS (SELECT 'error' AS level, 'too_many_rows' AS code, '*' AS "column", CAST(n AS DOUBLE) AS value, n > 1000 AS hit FROM n
    UNION ALL SELECT 'error', 'missing_threshold', '*', 1.0, true FROM n
    UNION ALL SELECT 'error', 'all_null', 'nothing', 1.0, true FROM n
    UNION ALL SELECT 'warning', 'high_cardinality', 'c_name', names, names > least(1000, 0.8 * n) FROM n
    UNION ALL SELECT 'warning', 'high_cardinality', 'c_mktsegment', segs, segs > least(1000, 0.8 * n) FROM n)
    SELECT level, code, "column", value FROM i WHERE hit""",
)
def validate_query(spark, sf):
    df = table(spark, sf, "customer").withColumn("nothing", F.when(F.col("c_custkey") < 0, F.col("c_acctbal")))
    return profile.validate_dataset(df, max_rows=1000)


@query(
    "high_cardinality",
    _union(
        [
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count({c}) AS non_null FROM documents HAVING count(DISTINCT {c}) > least(1000, 0.8 * count({c}))"""
            for c in ("text", "lang", "source")
        ]
    ),
)
def high_cardinality_query(spark, sf):
    return profile.high_cardinality(table(spark, sf, "documents"))


MIXED = "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END"


@query(
    "mixed_type_columns",
    f"""WITH p AS (SELECT {MIXED} AS mixed, p_name, CAST(p_size AS VARCHAR) AS size_text FROM part)
    SELECT * FROM ("""
    + _union(
        [
            f"""SELECT '{c}' AS "column", count(try_cast({c} AS DOUBLE)) AS numeric_values, count({c}) AS non_null FROM p"""
            for c in ("mixed", "p_name", "size_text")
        ]
    )
    + ") WHERE numeric_values > 0 AND numeric_values < non_null",
)
def mixed_query(spark, sf):
    df = table(spark, sf, "part").select(
        F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("mixed"),
        "p_name",
        F.col("p_size").cast("string").alias("size_text"),
    )
    return profile.mixed_type_columns(df)


@query(
    "duplicate_rate_check",
    """WITH p AS (SELECT p_brand, p_type, p_size FROM part), d AS (SELECT DISTINCT * FROM p),
    r AS (SELECT 1 - (SELECT count(*) FROM d) / (SELECT count(*) FROM p) AS rate)
    SELECT round(rate, 6) AS duplicate_rate, 0.1 AS threshold, rate > 0.1 AS exceeded FROM r""",
)
def duplicate_rate_query(spark, sf):
    return rounded(profile.duplicate_rate_check(table(spark, sf, "part").select("p_brand", "p_type", "p_size")), "duplicate_rate")


@query(
    "audit_summary",
    """SELECT event_type AS step, count(*) AS actions, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS affected_rows,
    string_agg(DISTINCT 'col_' || (user_id % 12), ',' ORDER BY 'col_' || (user_id % 12)) AS columns FROM events GROUP BY 1""",
)
def audit_query(spark, sf):
    actions = table(spark, sf, "events").select(
        F.col("event_type").alias("step"),
        F.floor("value").alias("affected_rows"),
        F.concat(F.lit("col_"), (F.col("user_id") % 12).cast("string")).alias("column"),
    )
    return profile.audit_summary(actions)


@query(
    "dataset_info",
    f"WITH {GAPS} "
    + _union(
        [
            f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS rows, count(*) - count({c}) AS null_count FROM o"""
            for c, k in zip(ORDER_COLUMNS, ORDER_KINDS)
        ]
    ),
)
def info_query(spark, sf):
    return profile.dataset_info(orders_with_gaps(spark, sf))


@query(
    "plot_recommendations",
    """WITH n AS (SELECT count(DISTINCT event_type) AS types FROM events)
    SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position, chart, first_column, second_column FROM (
    SELECT 1 AS p, 'histogram' AS chart, 'event_id' AS first_column, CAST(NULL AS VARCHAR) AS second_column
    UNION ALL SELECT 2, 'histogram', 'user_id', NULL UNION ALL SELECT 3, 'histogram', 'value', NULL
    UNION ALL SELECT 4, 'histogram', 'event_type', NULL FROM n WHERE types <= 50
    UNION ALL SELECT 5, 'correlation_heatmap', 'event_id,user_id,value', NULL
    UNION ALL SELECT 6, 'scatter_plot', 'event_id', 'user_id' UNION ALL SELECT 7, 'scatter_plot', 'event_id', 'value'
    UNION ALL SELECT 8, 'scatter_plot', 'user_id', 'value'
    UNION ALL SELECT 9, 'box_plot', 'event_id', 'event_type' FROM n WHERE types <= 50
    UNION ALL SELECT 10, 'box_plot', 'user_id', 'event_type' FROM n WHERE types <= 50
    UNION ALL SELECT 11, 'time_series', 'ts', 'event_id' UNION ALL SELECT 12, 'time_series', 'ts', 'user_id')
    QUALIFY row_number() OVER (ORDER BY p) <= 10""",
)
def recommendations_query(spark, sf):
    return profile.plot_recommendations(table(spark, sf, "events").drop("props"))


@query(
    "size_recommendations",
    """WITH n AS (SELECT count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents)
    SELECT recommendation, "column", round(value, 6) AS value FROM (
    SELECT 'large_table' AS recommendation, '*' AS "column", CAST(n AS DOUBLE) AS value, n > 100000 AS hit FROM n
    UNION ALL SELECT 'high_cardinality', 'text', texts / n, texts / n > 0.5 FROM n
    UNION ALL SELECT 'high_cardinality', 'lang', langs / n, langs / n > 0.5 FROM n
    UNION ALL SELECT 'high_cardinality', 'source', sources / n, sources / n > 0.5 FROM n) WHERE hit""",
)
def size_query(spark, sf):
    return rounded(profile.size_recommendations(table(spark, sf, "documents")), "value")


@query(
    "dataset_fingerprint",
    """WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment)), 1, 13))::BIGINT AS h FROM customer)
    SELECT count(*) AS row_count, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM h""",
)
def fingerprint_query(spark, sf):
    return profile.dataset_fingerprint(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "feature_stats",
    _union([f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in LINE_FEATURES]),
)
def feature_stats_query(spark, sf):
    return rounded(profile.feature_stats(table(spark, sf, "lineitem"), LINE_FEATURES), "mean", "std")


@query(
    "drift_check",
    """WITH a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'),
    b AS (SELECT l_quantity, l_extendedprice * 4 AS l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01') """
    + _union(
        [
            f"""SELECT '{c}' AS feature, round(m, 6) AS train_mean, round(s, 6) AS train_std, round(c, 6) AS current_mean, abs(c - m) > 2 * s AS drifted
            FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM a), (SELECT avg({c}) AS c FROM b)"""
            for c in LINE_FEATURES[:2]
        ]
    ),
)
def drift_query(spark, sf):
    lines = table(spark, sf, "lineitem")
    before = lines.filter(F.col("l_shipdate") < "1998-06-01")
    after = lines.filter(F.col("l_shipdate") >= "1998-06-01").withColumn("l_extendedprice", F.col("l_extendedprice") * 4)
    stats = profile.feature_stats(before, LINE_FEATURES[:2])
    return rounded(profile.drift_check(stats, after), "train_mean", "train_std", "current_mean")


@query(
    "class_balance",
    f"""WITH {GAPS}, c AS (SELECT o_orderstatus, count(*) AS n, count(o_totalprice) AS k FROM o GROUP BY 1),
    s AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(k) AS BIGINT) AS complete_rows, count(*) FILTER (WHERE k > 0) AS classes,
      min(k) FILTER (WHERE k > 0) AS smallest, max(k) AS largest FROM c)
    SELECT total_rows, complete_rows, classes, smallest, largest, round(largest / smallest, 6) AS imbalance_ratio,
    CASE WHEN total_rows < 10 THEN 'too_few_rows' WHEN complete_rows < 10 THEN 'too_few_complete_rows' WHEN classes < 2 THEN 'single_class'
      WHEN smallest < 2 THEN 'class_too_small' WHEN largest / smallest > 10 THEN 'imbalanced' ELSE 'ok' END AS status FROM s""",
)
def balance_query(spark, sf):
    return rounded(profile.class_balance(orders_with_gaps(spark, sf), ["o_totalprice"], "o_orderstatus"), "imbalance_ratio")
