"""Step lists, user functions and streams as registered queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import userfn
from ..operators.logs import Limits
from ..session import scratch_path
from ..sources import table
from ..streaming import jobs, timers
from . import flow
from .activity import ADMISSION
from .inputs import GAPS, orders_with_gaps, rounded, stamp
from .registry import query

PREPARED = f"""WITH {GAPS}, md AS (SELECT median(o_totalprice) AS fill FROM o),
    mo AS (SELECT o_orderpriority AS fill FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, md.fill) AS o_totalprice, coalesce(o_orderpriority, mo.fill) AS o_orderpriority FROM o, md, mo),
    l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM f)),
    s AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM f)
    SELECT o_orderkey, o_custkey, o_orderstatus, round((o_totalprice - mu) / sd, 6) AS o_totalprice, l.code AS o_orderpriority FROM f JOIN l ON o_orderpriority = v, s"""


@query("preprocess_pipeline", PREPARED)
def preprocess_query(spark, sf):
    df = orders_with_gaps(spark, sf).drop("o_orderdate")
    config = flow.Preparation(label_columns=["o_orderpriority"], scale_columns=["o_totalprice"])
    return rounded(flow.preprocess(df, config).table, "o_totalprice")


STEPS = [
    {"action": "extract_date_components", "params": {"column": "o_orderdate", "components": ["year", "month", "weekday"]}},
    {"action": "scale_numeric", "params": {"column": "o_totalprice", "method": "minmax"}},
    {"action": "no_such_step", "params": {}},
    {"action": "encode_categorical", "params": {"column": "o_orderstatus", "method": "label"}},
    {"function": "apply_frequency_encoding", "args": {"column": "o_orderpriority"}},
]


@query(
    "apply_transformations",
    """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
    l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)),
    p AS (SELECT o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1)
    SELECT o_orderkey, o_custkey, code AS o_orderstatus, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice, round(c / n, 6) AS o_orderpriority,
    CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday
    FROM orders JOIN l ON o_orderstatus = l.v JOIN p ON o_orderpriority = p.v, m""",
)
def transformations_query(spark, sf):
    df, _ = flow.apply_transformations(table(spark, sf, "orders"), STEPS)
    return rounded(df.drop("o_orderdate"), "o_totalprice", "o_orderpriority")


# Every seventh date is no date; a step that reads it is told how many it could not.
@query(
    "run_transformations",
    """SELECT 0 AS position, 'extract_date_components' AS action, 'error' AS status, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS failed_rows FROM orders
    UNION ALL SELECT 1, 'extract_time_deltas', 'error', count(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders
    UNION ALL SELECT 2, 'scale_numeric', 'success', NULL UNION ALL SELECT 3, 'no_such_step', 'error', NULL UNION ALL SELECT 4, 'encode_categorical', 'success', NULL""",
)
def run_transformations_query(spark, sf):
    shown = F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", shown.alias("shown"), F.lit("2030-01-01").alias("until"))
    steps = [
        {"action": "extract_date_components", "params": {"column": "shown", "components": ["year"]}},
        {"action": "extract_time_deltas", "params": {"date_col": "shown", "reference_col": "until"}},
        *STEPS[1:4],
    ]
    return flow.run_transformations(orders, steps)[1].drop("error")


@query(
    "pipeline_preview",
    """WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100), m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o)
    SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year FROM o, m""",
)
def preview_query(spark, sf):
    df, _ = flow.pipeline_preview(table(spark, sf, "orders"), STEPS[:2], ["o_orderkey"])
    return rounded(df.select("o_orderkey", "o_totalprice", "o_orderdate_year"), "o_totalprice")


@query("pipeline_export_import", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year FROM orders")
def export_query(spark, sf):
    steps = flow.import_steps(flow.export_steps(STEPS[:1]))
    df, _ = flow.apply_transformations(table(spark, sf, "orders"), steps)
    return df.select("o_orderkey", "o_orderdate_year")


@query(
    "pipeline_validate",
    """WITH s AS (SELECT user_id AS pipeline_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_id FROM events),
    d AS (SELECT pipeline_id, position, unnest([position - 1, event_id % 70]) AS dependency FROM s),
    n AS (SELECT user_id AS pipeline_id, count(*) AS steps FROM events GROUP BY 1),
    p AS (SELECT d.pipeline_id, position, dependency, CASE WHEN dependency >= steps THEN 'missing_step' WHEN dependency >= position THEN 'later_step' END AS problem FROM d JOIN n ON d.pipeline_id = n.pipeline_id)
    SELECT * FROM p WHERE problem IS NOT NULL""",
)
def validate_query(spark, sf):
    from pyspark.sql import Window as W

    position = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    steps = table(spark, sf, "events").select(F.col("user_id").alias("pipeline_id"), position.alias("position"), "event_id")
    steps = steps.select("pipeline_id", "position", F.array(F.col("position") - 1, F.col("event_id") % 70).alias("depends_on"))
    return flow.pipeline_validate(steps)


@query(
    "run_step_pipeline",
    """WITH f AS (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal FROM customer), m AS (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM f),
    l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM f))
    SELECT c_custkey, code AS c_mktsegment, round((c_acctbal - mu) / sd, 6) AS c_acctbal FROM f JOIN l ON c_mktsegment = v, m""",
)
def run_query(spark, sf):
    steps = [
        flow.Step("preprocess", lambda df: flow.preprocess(df, flow.Preparation(numeric_fill=None, text_fill=None)).table),
        flow.Step("encode", lambda df: flow.ACTIONS["encode_categorical"](df, "c_mktsegment", "label")),
        flow.Step("scale", lambda df: flow.ACTIONS["scale_numeric"](df, "c_acctbal")),
    ]
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    folder = scratch_path(spark, "run")
    flow.run_step_pipeline(df, steps[:2], folder)
    # The second run resumes after the two steps that are written.
    out, _ = flow.run_step_pipeline(df, steps, folder)
    return rounded(out, "c_acctbal")


@query(
    "apply_user_function",
    """SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem""",
)
def user_query(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")

    def revenue(t):
        price = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
        return t.withColumn("revenue", price).drop("l_extendedprice", "l_discount")

    return userfn.apply_user_function(df, revenue)[0]


@query("apply_pandas_function", "SELECT event_id, round(value * 2 + 1, 6) AS doubled FROM events")
def pandas_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")

    def double(batch):
        return batch.assign(doubled=(batch["value"] * 2 + 1).round(6))[["event_id", "doubled"]]

    return userfn.apply_pandas_function(df, double, "event_id long, doubled double")


@query(
    "grouped_user_function",
    """SELECT event_id, user_id, round(value - max(value) OVER (PARTITION BY user_id), 6) AS below_best FROM events""",
)
def grouped_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")

    def center(rows):
        return rows.assign(below_best=(rows["value"] - rows["value"].max()).round(6))[["event_id", "user_id", "below_best"]]

    return userfn.grouped_user_function(df, "user_id", center, "event_id long, user_id long, below_best double")


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.file_stream(spark, os.path.join(sf, "events*.parquet"), schema)


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_update, count(*) AS updates FROM s GROUP BY user_id, session"""


@query("stream_sessions", SESSIONS)
def sessions_query(spark, sf):
    stream = event_stream(spark, sf).select("user_id", "ts")
    out = jobs.run_closed(stream, "ts", lambda e: jobs.sessions(e, "user_id", "ts"))
    return out.withColumns({"created_at": stamp("created_at"), "last_update": stamp("last_update")})


@query("stream_timed_sessions", SESSIONS)
def timed_sessions_query(spark, sf):
    """The same with the state and the timers of each user in hand."""
    timers.timed(spark)
    stream = event_stream(spark, sf).select("user_id", "ts")
    out = jobs.run_closed(stream, "ts", lambda e: timers.timed_sessions(e, "user_id", "ts", 3600))
    return out.withColumns({"created_at": stamp("created_at"), "last_update": stamp("last_update")})


@query(
    "stream_incremental_stats",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1""",
)
def stats_query(spark, sf):
    out = jobs.run_closed(event_stream(spark, sf), "ts", lambda e: jobs.incremental_stats(e, "ts", "value"))
    out = out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")).drop("data_hash")
    return rounded(out, "total", places=4)


@query("stream_append_dataset", "SELECT event_id, user_id, event_type, value FROM events")
def append_query(spark, sf):
    return jobs.run_append(event_stream(spark, sf).select("event_id", "user_id", "event_type", "value"))


@query("stream_admit_requests", ADMISSION)
def admit_query(spark, sf):
    limits = Limits(per_minute=1, per_hour=2, per_day=3)
    stream = event_stream(spark, sf).select("event_id", "user_id", "ts", "value")
    return jobs.run_append(jobs.admit_stream(stream, "user_id", "ts", "value", limits)).drop("ts")


@query("stream_drop_replays")
def replays_query(spark, sf):
    stream = event_stream(spark, sf).select("event_id", "user_id", "event_type", "ts")
    nonce = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return jobs.run_append(jobs.drop_replays(stream, nonce, "ts", "1 day"))


@query("stream_replay_keys", "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL")
def replay_keys_query(spark, sf):
    """Which copy of a key comes first depends on arrival; that every key comes through does not."""
    return replays_query(spark, sf).select("user_id", "event_type").distinct()


@query(
    "stream_brute_force",
    """SELECT user_id, strftime(date_trunc('minute', ts) - to_minutes(i), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS failures
    FROM events, (SELECT unnest(range(15)) AS i) WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 1""",
)
def brute_query(spark, sf):
    failures = event_stream(spark, sf).filter("event_type = 'error'").select("user_id", "ts")
    timers.timed(spark)
    out = jobs.run_closed(failures, "ts", lambda e: timers.timed_brute_force(e, "user_id", "ts", 1))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "failures")
