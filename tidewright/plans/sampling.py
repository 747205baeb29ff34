"""Samples, splits, folds and class weights."""

from __future__ import annotations

from ..functions.hashing import row_hash_sql
from ..operators import sampling
from ..sources import table
from .inputs import rounded
from .registry import query

H_ORDER = row_hash_sql("o_orderkey")
H_DOC = row_hash_sql("doc_id")


@query("sample_random", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H_ORDER}, o_orderkey LIMIT 1000")
def random_query(spark, sf):
    return sampling.sample_random(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query(
    "sample_stratified",
    f"""WITH g AS (SELECT o_orderpriority AS g, count(*) AS c FROM orders GROUP BY 1), q AS (SELECT g, greatest(1, c * 1000 // (SELECT count(*) FROM orders)) AS take FROM g),
    r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H_ORDER}, o_orderkey) AS r FROM orders)
    SELECT o_orderkey, o_orderpriority FROM r JOIN q ON o_orderpriority = g WHERE r <= take""",
)
def stratified_query(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_stratified(df, "o_orderpriority", "o_orderkey", 1000)


@query(
    "sample_systematic",
    """WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT event_id, value FROM r WHERE i % greatest(1, n // 1000) = 0""",
)
def systematic_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "ts")
    return sampling.sample_systematic(df, ["ts", "event_id"], 1000).drop("ts")


@query("train_test_split", f"SELECT o_orderkey, {H_ORDER} % 1000000 < 200000 AS is_test FROM orders")
def split_query(spark, sf):
    return sampling.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


RANKED = f"r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {H_DOC}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)"


@query("train_test_split_stratified", f"WITH {RANKED} SELECT doc_id, toxic, r < floor(n * 0.2 + 0.5) AS is_test FROM r")
def split_stratified_query(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", "toxic")
    return sampling.train_test_split_stratified(df, "toxic", "doc_id")


@query("undersample", f"WITH {RANKED} SELECT doc_id, toxic FROM r WHERE r < (SELECT min(n) FROM r)")
def undersample_query(spark, sf):
    return sampling.undersample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("class_weight", "SELECT toxic AS class, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY 1")
def weight_query(spark, sf):
    return rounded(sampling.class_weights(table(spark, sf, "labels"), "toxic"), "weight")


@query("kfold", f"SELECT o_orderkey, CAST({H_ORDER} % 5 AS INTEGER) AS fold FROM orders")
def kfold_query(spark, sf):
    return sampling.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("stratified_kfold", f"WITH {RANKED} SELECT doc_id, toxic, CAST(r % 5 AS INTEGER) AS fold FROM r")
def stratified_kfold_query(spark, sf):
    return sampling.stratified_kfold(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id")
