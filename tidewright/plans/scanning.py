"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project
from ..session import scratch_path
from ..sources import (
    append_dataset,
    scan_auto,
    scan_csv,
    scan_json,
    scan_parquet,
    sink_csv,
    sink_json,
    sink_parquet,
    table,
)
from .inputs import GAPS, orders_with_gaps, rounded
from .registry import query

PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("scan_csv", PART)
def scan_csv_query(spark, sf):
    path = sink_csv(table(spark, sf, "part"), scratch_path(spark, "csv"))
    return scan_csv(spark, path, PART_SCHEMA)


@query("sink_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_csv_query(spark, sf):
    path = sink_csv(table(spark, sf, "documents"), scratch_path(spark, "csv"))
    return scan_csv(spark, path, DOC_SCHEMA, multiline=True)


@query("sink_csv_one_line", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_csv_one_line_query(spark, sf):
    path = sink_csv(table(spark, sf, "documents"), scratch_path(spark, "csv"), one_line=True)
    return scan_csv(spark, path, DOC_SCHEMA, one_line=True)


@query("scan_auto", PART)
def scan_auto_query(spark, sf):
    path = sink_parquet(table(spark, sf, "part").select(*PART_COLUMNS), scratch_path(spark, "auto") + ".parquet")
    return scan_auto(spark, path)


@query("scan_json_records", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_json_records_query(spark, sf):
    """Each file is one array of records, as other tools write them."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    packed = rows.groupBy((F.col("s_suppkey") % 100).alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    path = scratch_path(spark, "records")
    # One file for each group of at most a hundredth of the suppliers.
    packed.write.partitionBy("file").text(path)
    found = scan_json(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return found.select(*rows.columns)


@query("scan_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_json_query(spark, sf):
    path = sink_json(table(spark, sf, "customer"), scratch_path(spark, "json"))
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return scan_json(spark, path, schema, lines=True)


@query("sink_json", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sink_json_query(spark, sf):
    path = sink_json(table(spark, sf, "supplier"), scratch_path(spark, "json"))
    return scan_json(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", lines=True)


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_parquet_query(spark, sf):
    return table(spark, sf, "orders").drop("o_orderdate")


@query("sink_parquet", "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def sink_parquet_query(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    return scan_parquet(spark, sink_parquet(df, scratch_path(spark, "parquet")))


@query(
    "append_dataset",
    """SELECT c_custkey AS party_key, c_name AS party_name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def append_query(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"), F.col("c_acctbal").alias("balance")
    )
    # The columns come in another order: the append goes by name.
    second = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("party_name"), F.col("s_suppkey").alias("party_key")
    )
    return append_dataset(first, second)


@query(
    "check_limits",
    """SELECT 'rows' AS check_name, count(*) AS actual, CAST(1000000 AS BIGINT) AS allowed, count(*) <= 1000000 AS within FROM lineitem
    UNION ALL SELECT 'columns', 11, 1000, true""",
)
def limits_query(spark, sf):
    return project.check_limits(table(spark, sf, "lineitem"))


@query("preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def preview_query(spark, sf):
    return project.preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 50)


@query("select_features", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def select_query(spark, sf):
    return project.select_features(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "validate_columns",
    f"""WITH {GAPS}, n AS (SELECT count(o_totalprice) AS price, count(DISTINCT o_custkey) AS custs,
        count(DISTINCT o_orderpriority) AS prios, count(o_orderdate) AS dates,
        count(try_cast(o_orderstatus AS TIMESTAMP)) AS status_dates FROM o)
    SELECT 'o_totalprice' AS "column", 'numeric' AS expected, price > 0 AS valid, CASE WHEN price > 0 THEN 'ok' ELSE 'all_null' END AS reason FROM n
    UNION ALL SELECT 'o_orderpriority', 'categorical', true, 'ok' FROM n
    UNION ALL SELECT 'o_custkey', 'categorical', custs <= 50, CASE WHEN custs <= 50 THEN 'ok' ELSE 'too_many_values' END FROM n
    UNION ALL SELECT 'o_orderdate', 'datetime', dates > 0, CASE WHEN dates > 0 THEN 'ok' ELSE 'all_null' END FROM n
    UNION ALL SELECT 'o_orderstatus', 'datetime', status_dates > 0, CASE WHEN status_dates > 0 THEN 'ok' ELSE 'not_datetime' END FROM n
    UNION ALL SELECT 'o_comment', 'any', false, 'missing' FROM n""",
)
def validate_columns_query(spark, sf):
    return project.validate_columns(
        orders_with_gaps(spark, sf),
        {
            "o_totalprice": "numeric",
            "o_orderpriority": "categorical",
            "o_custkey": "categorical",
            "o_orderdate": "datetime",
            "o_orderstatus": "datetime",
            "o_comment": "any",
        },
    )


@query(
    "validate_datetime_col",
    """SELECT 'o_orderdate' AS "column", count(o_orderdate) AS parsed, count(o_orderdate) > 0 AS valid FROM orders
    UNION ALL SELECT 'o_orderstatus', count(try_cast(o_orderstatus AS TIMESTAMP)), count(try_cast(o_orderstatus AS TIMESTAMP)) > 0 FROM orders""",
)
def validate_datetime_query(spark, sf):
    return project.validate_datetime_col(table(spark, sf, "orders"), ["o_orderdate", "o_orderstatus"])


@query(
    "validate_text_col",
    """SELECT 'text' AS "column", round(avg(length(text)), 6) AS avg_length, avg(length(text)) > 2 AS valid FROM documents
    UNION ALL SELECT 'lang', round(avg(length(lang)), 6), avg(length(lang)) > 2 FROM documents""",
)
def validate_text_query(spark, sf):
    return rounded(project.validate_text_col(table(spark, sf, "documents"), ["text", "lang"]), "avg_length")


@query(
    "normalize_column_names",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS status FROM orders",
)
def normalize_query(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total Price"), F.col("o_orderstatus").alias("STATUS")
    )
    return project.normalize_column_names(df)


@query("drop_empty_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_empty_query(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    never = F.when(F.length("c_mktsegment") < 0, F.col("c_mktsegment"))
    return project.drop_empty_columns(df.withColumn("nothing", never))


@query(
    "drop_missing",
    f"WITH {GAPS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM o WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def drop_missing_query(spark, sf):
    return project.drop_missing(orders_with_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority"))


@query(
    "complete_case_mask",
    f"WITH {GAPS} SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM o WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL",
)
def complete_case_query(spark, sf):
    df = project.complete_case_mask(orders_with_gaps(spark, sf), ["o_totalprice", "o_custkey"], "o_orderstatus")
    return df.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query(
    "zero_variance_features",
    """SELECT 'l_quantity' AS feature, round(var_samp(l_quantity), 4) AS variance, var_samp(l_quantity) = 0 AS zero_variance FROM lineitem
    UNION ALL SELECT 'l_discount', round(var_samp(l_discount), 4), var_samp(l_discount) = 0 FROM lineitem
    UNION ALL SELECT 'sign', round(var_samp(sign(l_quantity)), 4), var_samp(sign(l_quantity)) = 0 FROM lineitem""",
)
def zero_variance_query(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("sign", F.signum("l_quantity"))
    return rounded(project.zero_variance_features(df, ["l_quantity", "l_discount", "sign"]), "variance", places=4)


LINE_FEATURES = ["l_quantity", "l_returnflag", "l_shipdate", "l_linestatus", "l_tax"]


@query(
    "non_numeric_features",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS categories FROM lineitem" for c in ("l_returnflag", "l_shipdate", "l_linestatus")),
)
def non_numeric_query(spark, sf):
    """Features that have to be encoded first, with the number of their categories."""
    df = table(spark, sf, "lineitem")
    found = project.non_numeric_features(df, LINE_FEATURES)
    one = df.agg(*[F.count_distinct(c).alias(c) for c in found])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("categories")) for c in found])))
