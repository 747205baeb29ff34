"""Categorical encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode
from ..sources import table
from .inputs import GAPS, orders_with_gaps, rounded
from .registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flags(token: str | None, kind: str) -> str:
    names = sorted(PRIORITIES + ([token] if token else []))
    source = f"coalesce(o_orderpriority, '{token}')" if token else "coalesce(o_orderpriority, '')"
    return ", ".join(f"""CAST({source} = '{v}' AS {kind}) AS "o_orderpriority_{v}" """ for v in names)


def _orders(spark, sf):
    return orders_with_gaps(spark, sf).select("o_orderkey", "o_orderpriority")


@query("encode_onehot", f"WITH {GAPS} SELECT o_orderkey, {_flags('missing', 'DOUBLE')} FROM o")
def onehot_query(spark, sf):
    return encode.encode_onehot(_orders(spark, sf), "o_orderpriority")


@query("encode_onehot_na", f"WITH {GAPS} SELECT o_orderkey, {_flags('__NA__', 'INTEGER')} FROM o")
def onehot_na_query(spark, sf):
    return encode.encode_onehot(_orders(spark, sf), "o_orderpriority", encode.NA, "int")


@query("encode_onehot_capped", f"WITH {GAPS} SELECT o_orderkey, o_custkey, {_flags(None, 'INTEGER')} FROM o")
def onehot_capped_query(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority")
    df = encode.encode_onehot_capped(df, "o_orderpriority", 10)
    return encode.encode_onehot_capped(df, "o_custkey", 10)


LABELS = "l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {e} AS v FROM o WHERE {e} IS NOT NULL))"


@query(
    "encode_label",
    f"WITH {GAPS}, {LABELS.format(e='o_orderpriority')} SELECT o_orderkey, l.code AS o_orderpriority FROM o LEFT JOIN l ON o_orderpriority = v",
)
def label_query(spark, sf):
    return encode.encode_label(_orders(spark, sf), "o_orderpriority")


NA_KEY = "coalesce(o_orderpriority, '__NA__')"


@query(
    "encode_label_na",
    f"WITH {GAPS}, {LABELS.format(e=NA_KEY)} SELECT o_orderkey, l.code AS o_orderpriority FROM o LEFT JOIN l ON {NA_KEY} = v",
)
def label_na_query(spark, sf):
    return encode.encode_label(_orders(spark, sf), "o_orderpriority", encode.NA)



def _fitted_on_early_brands(spark, sf, null_token=None):
    """Brands of small parts are fitted, all parts are encoded: some brands may be new."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("kind"), "p_size")
    return encode.fit_categories(parts.filter("p_size <= 5"), "kind", null_token), parts.drop("p_size")


EARLY = """p AS (SELECT p_partkey, p_brand || '/' || p_type AS kind, p_size FROM part),
  l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT kind AS v FROM p WHERE p_size <= 5))"""


@query("encode_ordinal_unknown", f"WITH {EARLY} SELECT p_partkey, coalesce(code, -1) AS kind FROM p LEFT JOIN l ON kind = v")
def ordinal_query(spark, sf):
    cats, parts = _fitted_on_early_brands(spark, sf)
    return encode.apply_label(parts, cats, unknown=-1)


@query("apply_label_unseen", f"WITH {EARLY} SELECT p_partkey, coalesce(code, 0) AS kind FROM p LEFT JOIN l ON kind = v")
def unseen_query(spark, sf):
    cats, parts = _fitted_on_early_brands(spark, sf, encode.NA)
    return encode.apply_label_unseen(parts, cats)


COUNTS = "c AS (SELECT o_orderpriority AS v, count(*) AS n FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1)"


@query(
    "encode_frequency",
    f"WITH {GAPS}, {COUNTS} SELECT o_orderkey, round(n / (SELECT sum(n) FROM c), 6) AS o_orderpriority FROM o LEFT JOIN c ON o_orderpriority = v",
)
def frequency_query(spark, sf):
    return rounded(encode.encode_frequency(_orders(spark, sf), "o_orderpriority"), "o_orderpriority")


@query("encode_count", f"WITH {GAPS}, {COUNTS} SELECT o_orderkey, n AS o_orderpriority FROM o LEFT JOIN c ON o_orderpriority = v")
def count_query(spark, sf):
    return encode.encode_count(_orders(spark, sf), "o_orderpriority")


@query("encode_target_count", f"WITH {GAPS}, {COUNTS} SELECT o_orderkey, coalesce(n, 0) AS o_orderpriority FROM o LEFT JOIN c ON o_orderpriority = v")
def target_count_query(spark, sf):
    return encode.encode_target_count(_orders(spark, sf), "o_orderpriority")


@query(
    "encode_target_mean",
    f"""WITH {GAPS}, c AS (SELECT o_orderpriority AS v, avg(o_totalprice) AS m FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, round(m, 4) AS o_orderpriority FROM o LEFT JOIN c ON o_orderpriority = v""",
)
def target_mean_query(spark, sf):
    df = orders_with_gaps(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(encode.encode_target_mean(df, "o_orderpriority", "o_totalprice").drop("o_totalprice"), "o_orderpriority", places=4)


@query(
    "encode_custom",
    f"WITH {GAPS} SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 5 WHEN '5-LOW' THEN 1 END AS o_orderpriority FROM o",
)
def custom_query(spark, sf):
    return encode.encode_custom(_orders(spark, sf), "o_orderpriority", {"1-URGENT": 10, "2-HIGH": 5, "5-LOW": 1})


@query(
    "encoder_artifact_id",
    """SELECT 'c_mktsegment' AS "column", substr(sha256('c_mktsegment|categorical|label|' || string_agg(v, ',' ORDER BY v)), 1, 16) AS artifact_id
    FROM (SELECT DISTINCT c_mktsegment AS v FROM customer ORDER BY v LIMIT 100)
    UNION ALL SELECT 'c_name', substr(sha256('c_name|categorical|label|' || string_agg(v, ',' ORDER BY v)), 1, 16)
    FROM (SELECT DISTINCT c_name AS v FROM customer ORDER BY v LIMIT 100)""",
)
def artifact_query(spark, sf):
    return encode.encoder_artifact_id(table(spark, sf, "customer"), ["c_mktsegment", "c_name"], "label")
