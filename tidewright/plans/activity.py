"""Access, request and run logs, read from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from ..sources import table
from .inputs import rounded, stamp
from .registry import query

ACCESS = """log AS (SELECT event_id, 'k' || (CAST(json_extract(props, '$.k') AS BIGINT) % 12) AS cache_key, ts AS access_time, user_id,
  value AS computation_cost, event_type IN ('view', 'click') AS hit FROM events)"""


def access_log(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long") % 12
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("k"), k.cast("string")).alias("cache_key"),
        F.col("ts").alias("access_time"),
        "user_id",
        F.col("value").alias("computation_cost"),
        F.col("event_type").isin("view", "click").alias("hit"),
    )


@query(
    "cache_hit_rate",
    f"""WITH {ACCESS} SELECT count(DISTINCT cache_key) AS total_entries, count(*) FILTER (WHERE hit) AS total_hits,
    count(*) FILTER (WHERE NOT hit) AS total_misses, round(count(*) FILTER (WHERE hit) / count(*), 3) AS hit_rate FROM log""",
)
def hit_rate_query(spark, sf):
    return logs.cache_hit_rate(access_log(spark, sf))


@query(
    "cache_top_entries",
    f"""WITH {ACCESS} SELECT cache_key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
    round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM log GROUP BY 1 ORDER BY hits DESC, cache_key LIMIT 5""",
)
def top_entries_query(spark, sf):
    return rounded(logs.cache_top_entries(access_log(spark, sf)), "hit_rate")


NOW = "TIMESTAMP '2024-01-25 12:30:00'"


@query(
    "predict_cache_needs",
    f"""WITH {ACCESS}, r AS (SELECT * FROM log WHERE hour(access_time) = 12
      AND floor((epoch_us({NOW}) - epoch_us(access_time)) / 86400e6) BETWEEN 0 AND 7 ORDER BY access_time DESC, cache_key DESC LIMIT 100),
    s AS (SELECT cache_key, count(*) AS misses, avg(computation_cost) AS avg_cost FROM r WHERE NOT hit GROUP BY 1 HAVING count(*) >= 2)
    SELECT cache_key, misses, round(avg_cost, 6) AS avg_cost, round(least(misses / 10, 1.0) * least(avg_cost / 100, 1.0), 6) AS confidence
    FROM s ORDER BY least(misses / 10, 1.0) * least(avg_cost / 100, 1.0) DESC, cache_key LIMIT 20""",
)
def predict_query(spark, sf):
    now = F.lit("2024-01-25 12:30:00").cast("timestamp")
    return rounded(logs.predict_cache_needs(access_log(spark, sf), now), "avg_cost", "confidence")


@query(
    "user_frequent_misses",
    f"""WITH {ACCESS}, busy AS (SELECT user_id FROM log GROUP BY 1 HAVING count(*) >= 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY access_time DESC, cache_key DESC) AS r FROM log),
    c AS (SELECT user_id, cache_key, count(*) AS misses FROM r WHERE r <= 50 AND NOT hit AND computation_cost > 10 GROUP BY 1, 2 HAVING count(*) >= 2),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY misses DESC, cache_key) AS INTEGER) AS position FROM c)
    SELECT t.user_id, cache_key, misses, position FROM t JOIN busy ON t.user_id = busy.user_id WHERE position <= 10""",
)
def frequent_query(spark, sf):
    return logs.user_frequent_misses(access_log(spark, sf))


def _range(seconds: int) -> str:
    return f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECOND PRECEDING AND CURRENT ROW)"


@query(
    "rate_limit_counts",
    f"""WITH c AS (SELECT event_id, user_id, {_range(60)} AS minute_requests, {_range(3600)} AS hour_requests, {_range(86400)} AS day_requests FROM events)
    SELECT *, greatest(30 - minute_requests, 0) AS minute_remaining, greatest(300 - hour_requests, 0) AS hour_remaining,
    greatest(1000 - day_requests, 0) AS day_remaining FROM c""",
)
def rate_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return logs.rate_limit_counts(df, "user_id", "ts").drop("ts")


@query(
    "cost_budget",
    """WITH c AS (SELECT event_id, user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) AS spent FROM events)
    SELECT event_id, user_id, value, round(spent, 4) AS spent, round(greatest(100 - spent, 0), 4) AS remaining, spent > 100 AS exceeded FROM c""",
)
def budget_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(logs.cost_budget(df, "user_id", "ts", "value", 7200).drop("ts"), "spent", "remaining", places=4)


def _within(seconds: int) -> str:
    return f"list_filter(kept, lambda x: e.t - x.t <= {seconds * 1_000_000})"


# One step per request of a user: the list of admitted requests decides on the next one.
ADMISSION = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(t BIGINT, c DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS value, 'start' AS reason
      FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, n, CASE WHEN reason = 'ok' THEN list_append(kept, {{'t': t, 'c': value}}) ELSE kept END, event_id, value, reason FROM (
        SELECT e.*, s.kept, CASE WHEN len({_within(60)}) >= 1 OR len({_within(3600)}) >= 2 OR len({_within(86400)}) >= 3 THEN 'time_limit_exceeded'
          WHEN coalesce(list_sum(list_transform({_within(60)}, lambda x: x.c)), 0) + e.value > 100 THEN 'cost_limit_exceeded' ELSE 'ok' END AS reason
        FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT event_id, user_id, value, reason = 'ok' AS allowed, reason FROM s WHERE event_id IS NOT NULL"""


@query("admit_requests", ADMISSION)
def admit_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    limits = logs.Limits(per_minute=1, per_hour=2, per_day=3, cost_per_minute=100.0)
    return logs.admit_requests(df, "user_id", "ts", "value", limits, ["event_id"]).drop("ts")


@query(
    "brute_force_alert",
    """WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent_failures
    FROM events WHERE event_type = 'error') SELECT * FROM c WHERE recent_failures > 2""",
)
def brute_query(spark, sf):
    failures = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return logs.brute_force_alert(failures, "user_id", "ts", 86400, 2).drop("ts")


@query(
    "replay_dedup",
    """WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || event_type AS nonce, epoch_us(ts) AS t FROM events),
    a AS (SELECT nonce, min(t) AS t FROM e GROUP BY 1
      UNION ALL SELECT a.nonce, (SELECT min(e.t) FROM e WHERE e.nonce = a.nonce AND e.t > a.t + 172800000000) FROM a
      WHERE EXISTS (SELECT 1 FROM e WHERE e.nonce = a.nonce AND e.t > a.t + 172800000000))
    SELECT e.event_id, e.nonce, a.t IS NOT NULL AS accepted FROM e LEFT JOIN a ON e.nonce = a.nonce AND e.t = a.t""",
)
def replay_query(spark, sf):
    nonce = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    df = table(spark, sf, "events").select("event_id", nonce.alias("nonce"), "ts")
    return logs.replay_dedup(df, "nonce", "ts", 2 * 86400, ["event_id"]).drop("ts")


@query(
    "resource_anomaly",
    """WITH b AS (SELECT user_id, avg(value) AS base FROM events GROUP BY 1)
    SELECT event_id, e.user_id, value, round(base, 4) AS base_value, value / greatest(base, 1) > 3 OR value > 200 AS anomalous FROM events e JOIN b ON e.user_id = b.user_id""",
)
def anomaly_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    base = df.groupBy("user_id").agg(F.avg("value").alias("value"))
    return rounded(logs.resource_anomaly(df, base, "user_id", ["value"], 3.0, {"value": 200.0}), "base_value", places=4)


RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS pipeline_type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE
  CASE o_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' ELSE 'pending' END END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 100 END AS actual_duration FROM orders)"""


def run_log(spark, sf):
    other = F.when(F.col("o_custkey") % 3 == 0, "failed").when(F.col("o_custkey") % 3 == 1, "cancelled").otherwise("pending")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise(other)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("pipeline_type"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 100).alias("actual_duration"),
    )


@query(
    "run_metrics",
    f"""WITH {RUNS}, f AS (SELECT * FROM runs WHERE pipeline_type = '2-HIGH' AND created_at >= TIMESTAMP '1996-01-01')
    SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS successful_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs,
    count(*) FILTER (WHERE status = 'cancelled') AS cancelled_runs, round(avg(actual_duration), 4) AS avg_duration_seconds,
    count(*) FILTER (WHERE created_at >= TIMESTAMP '2000-01-31' - INTERVAL 30 DAY) AS recent_runs,
    round(count(*) FILTER (WHERE status = 'completed') / count(*) * 100, 6) AS success_rate,
    round(count(*) FILTER (WHERE status = 'failed') / count(*) * 100, 6) AS failure_rate FROM f""",
)
def run_metrics_query(spark, sf):
    now = F.lit("2000-01-31").cast("timestamp")
    df = logs.run_metrics(run_log(spark, sf), now, pipeline_type="2-HIGH", start="1996-01-01")
    return rounded(rounded(df, "success_rate", "failure_rate"), "avg_duration_seconds", places=4)


@query(
    "error_types",
    "SELECT event_type AS error_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1",
)
def error_types_query(spark, sf):
    failed = F.col("event_type").isin("error", "click")
    message = F.when(failed, F.concat(F.col("event_type"), F.lit(": "), F.col("props"))).otherwise(F.lit(""))
    return logs.error_types(table(spark, sf, "events").select(message.alias("error_message")))


@query(
    "request_metrics",
    """SELECT count(*) AS total_requests, count(*) FILTER (WHERE event_type <> 'error') AS successful_requests,
    count(*) FILTER (WHERE event_type = 'error') AS failed_requests, round(avg(value), 6) AS avg_seconds, round(sum(value), 2) AS total_seconds,
    round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate FROM events""",
)
def request_metrics_query(spark, sf):
    log = table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    return rounded(rounded(logs.request_metrics(log), "avg_seconds", "success_rate"), "total_seconds", places=2)


@query("active_runs", f"WITH {RUNS} SELECT run_id, pipeline_type, status FROM runs WHERE status IN ('pending', 'running')")
def active_query(spark, sf):
    return logs.active_runs(run_log(spark, sf)).select("run_id", "pipeline_type", "status")


@query("retention_purge", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events WHERE ts >= TIMESTAMP '2024-02-14 00:00:00' - INTERVAL 30 DAY")
def purge_query(spark, sf):
    now = F.lit("2024-02-14").cast("timestamp")
    return logs.retention_purge(table(spark, sf, "events").select("event_id", "ts"), "ts", now).withColumn("ts", stamp("ts"))
