"""Analytics over access, request and run logs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..schema import q
from .lookup import lookup_join
from .sequences import MICROS, Walk, in_sequence, micros, running_latest, trailing_sums, walk_in_ranges


@dataclass(frozen=True)
class Limits:
    """Request limits per trailing minute, hour and day, and the cost budget per minute."""

    per_minute: int = 30
    per_hour: int = 300
    per_day: int = 1000
    cost_per_minute: float = 100.0


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def cache_hit_rate(log: DataFrame) -> DataFrame:
    """`(total_entries, total_hits, total_misses, hit_rate)` of a log with `cache_key` and `hit`."""
    keys = log.groupBy("cache_key").agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m"))
    one = keys.agg(F.count("*").alias("total_entries"), F.sum("h").alias("total_hits"), F.sum("m").alias("total_misses"))
    return one.withColumn("hit_rate", F.round(_ratio(F.col("total_hits"), F.col("total_hits") + F.col("total_misses")), 3))


def cache_top_entries(log: DataFrame, limit: int = 5) -> DataFrame:
    """The keys with most hits."""
    keys = log.groupBy("cache_key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    top = keys.orderBy(F.desc("hits"), "cache_key").limit(limit)
    return top.withColumn("hit_rate", _ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def predict_cache_needs(log: DataFrame, now: Column, last: int = 100, limit: int = 20) -> DataFrame:
    """Keys likely missed soon: the latest accesses at this hour of day within the last week."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("access_time")) / (86400 * MICROS))
    recent = (
        log.filter((F.hour("access_time") == F.hour(now)) & age.between(0, 7))
        .orderBy(F.desc("access_time"), F.desc("cache_key"))
        .limit(last)
    )
    scored = (
        recent.filter(~F.col("hit"))
        .groupBy("cache_key")
        .agg(F.count("*").alias("misses"), F.avg("computation_cost").alias("avg_cost"))
        .filter(F.col("misses") >= 2)
    )
    confidence = F.least(F.col("misses") / 10, F.lit(1.0)) * F.least(F.col("avg_cost") / 100, F.lit(1.0))
    return scored.withColumn("confidence", confidence).orderBy(F.desc("confidence"), "cache_key").limit(limit)


def user_frequent_misses(
    log: DataFrame, min_accesses: int = 5, last: int = 50, min_cost: float = 10.0, limit: int = 10
) -> DataFrame:
    """Per user the expensive keys missed at least twice among the latest accesses.

    Spark keeps only the first rows per user and task before the shuffle, so a busy user
    does not fill one.
    """
    busy = log.groupBy("user_id").agg(F.count("*").alias("accesses")).filter(F.col("accesses") >= min_accesses)
    latest = W.partitionBy("user_id").orderBy(F.desc("access_time"), F.desc("cache_key"))
    recent = log.withColumn("__r", F.row_number().over(latest)).filter(F.col("__r") <= last)
    missed = recent.filter(~F.col("hit") & (F.col("computation_cost") > min_cost))
    counts = missed.groupBy("user_id", "cache_key").agg(F.count("*").alias("misses")).filter(F.col("misses") >= 2)
    best = W.partitionBy("user_id").orderBy(F.desc("misses"), "cache_key")
    ranked = counts.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)
    return ranked.join(busy.select("user_id"), "user_id", "left_semi")


def rate_limit_counts(log: DataFrame, key: str, ts: str, limits: Limits = Limits()) -> DataFrame:
    """Requests of the trailing minute, hour and day, this one included, and what is left."""
    counted = trailing_sums(log, key, ts, {"minute_requests": (60, None), "hour_requests": (3600, None), "day_requests": (86400, None)})
    left = {"minute": limits.per_minute, "hour": limits.per_hour, "day": limits.per_day}
    return counted.withColumns(
        {f"{k}_remaining": F.greatest(F.lit(v) - F.col(f"{k}_requests"), F.lit(0)) for k, v in left.items()}
    )


def cost_budget(log: DataFrame, key: str, ts: str, cost: str, seconds: float = 60, limits: Limits = Limits()) -> DataFrame:
    """Cost spent in the trailing span, what is left of the budget and whether it is exceeded."""
    spent = trailing_sums(log, key, ts, {"spent": (seconds, q(cost))})
    return spent.withColumns(
        {
            "remaining": F.greatest(F.lit(limits.cost_per_minute) - F.col("spent"), F.lit(0.0)),
            "exceeded": F.col("spent") > limits.cost_per_minute,
        }
    )


class Admission(Walk):
    """Limits of one key; keeps only admitted requests of the last day, so its size is bounded."""

    def __init__(self, limits: Limits, state: str | None = None, ts: str = "", cost: str = ""):
        self.limits, self.ts, self.cost = limits, ts, cost
        self.admitted: list[tuple[int, float]] = [tuple(a) for a in json.loads(state)] if state else []

    def _forget(self, at: int) -> None:
        if self.admitted and at - self.admitted[0][0] > 86400 * MICROS:
            self.admitted = [(t, c) for t, c in self.admitted if at - t <= 86400 * MICROS]

    def admit(self, at: int, cost: float) -> tuple[bool, str]:
        self._forget(at)
        minute = hour = 0
        spent = 0.0
        for t, c in reversed(self.admitted):
            if at - t > 3600 * MICROS:
                break
            hour += 1
            if at - t <= 60 * MICROS:
                minute += 1
                spent += c
        if minute >= self.limits.per_minute or hour >= self.limits.per_hour or len(self.admitted) >= self.limits.per_day:
            return False, "time_limit_exceeded"
        if spent + cost > self.limits.cost_per_minute:
            return False, "cost_limit_exceeded"
        self.admitted.append((at, cost))
        return True, "ok"

    def rows(self, rows: pd.DataFrame) -> dict[str, list]:
        verdicts = [self.admit(at, float(c)) for at, c in zip(micros(rows[self.ts]), rows[self.cost].tolist())]
        return {"allowed": [v for v, _ in verdicts], "reason": [r for _, r in verdicts]}

    def state(self) -> str:
        return json.dumps(self.admitted)


def admit_requests(
    log: DataFrame, key: str, ts: str, cost: str, limits: Limits = Limits(), order: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add `allowed` and `reason`; refused requests do not count against the limits.

    Every decision depends on the ones before. A key of any size is walked in ranges at the same time; ranges that
    began with other admitted requests than assumed are walked again.
    """
    made = [T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType())]
    return walk_in_ranges(log, key, [ts, *order], lambda state: Admission(limits, state, ts, cost), made, ranges)


def brute_force_alert(log: DataFrame, key: str, ts: str, seconds: float = 900, more_than: int = 10) -> DataFrame:
    """Failures whose key had more than the allowed number in the trailing span."""
    counted = trailing_sums(log, key, ts, {"recent_failures": (seconds, None)}, include_edge=False)
    return counted.filter(F.col("recent_failures") > more_than)


def replay_dedup(log: DataFrame, key: str, ts: str, seconds: float = 300, order: Sequence[str] = ()) -> DataFrame:
    """Add `accepted`: false when the key was accepted less than the window before.

    A key is first cut where its requests pause for longer than the window: what follows such
    a pause does not depend on what came before, so the pieces are walked independently.
    """
    span = int(seconds * MICROS)
    day = F.floor(F.unix_micros(q(ts)) / (86400 * MICROS))
    counted = trailing_sums(log, key, ts, {"__near": (seconds, None)})
    begin = F.when(F.col("__near") == 1, F.unix_micros(q(ts)))
    pieces = running_latest(counted, key, [ts, *order], begin, day, "__piece").drop("__near")
    schema = T.StructType([*log.schema.fields, T.StructField("accepted", T.BooleanType())])

    def make_step():
        state: dict = {"key": None, "last": None}

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for k, piece, at in zip(rows[key].tolist(), rows["__piece"].tolist(), micros(rows[ts])):
                fresh = state["key"] != (k, piece) or at - state["last"] > span
                if fresh:
                    state.update(key=(k, piece), last=at)
                out.append(fresh)
            return rows.drop(columns="__piece").assign(accepted=out)

        return step

    return in_sequence(pieces, [key, "__piece"], [ts, *order], make_step, schema)


def resource_anomaly(
    usage: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str], ratio: float = 3.0, fixed: dict[str, float] | None = None
) -> DataFrame:
    """Add `anomalous`: above `ratio` times the key's baseline, or above a fixed limit.

    `baseline` holds one row per key with the same metric columns.
    """
    renamed = baseline.select(q(key).alias("value"), *[q(m).alias(f"base_{m}") for m in metrics])
    joined = lookup_join(usage, renamed, key, [f"base_{m}" for m in metrics])
    hit = F.lit(False)
    for m in metrics:
        base = F.greatest(F.coalesce(q(f"base_{m}"), q(m)), F.lit(1.0))
        hit = hit | (q(m) / base > ratio)
    for m, limit in (fixed or {}).items():
        hit = hit | (q(m) > limit)
    return joined.withColumn("anomalous", F.coalesce(hit, F.lit(False)))


def run_metrics(
    runs: DataFrame, now: Column, pipeline_type: str | None = None, environment: str | None = None,
    start: str | None = None, end: str | None = None, recent_days: int = 30,
) -> DataFrame:
    """One row of totals, rates and mean duration over a filtered run log."""
    if pipeline_type is not None:
        runs = runs.filter(F.col("pipeline_type") == pipeline_type)
    if environment is not None:
        runs = runs.filter(F.col("environment") == environment)
    if start is not None:
        runs = runs.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        runs = runs.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    one = runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "completed").alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_runs"),
        # A run without a duration, or with zero, does not take part in the mean.
        F.coalesce(F.avg(F.when(F.col("actual_duration") != 0, F.col("actual_duration"))), F.lit(0.0)).alias("avg_duration_seconds"),
        F.count_if(F.col("created_at") >= now - F.make_dt_interval(F.lit(recent_days))).alias("recent_runs"),
    )
    return one.withColumns(
        {
            "success_rate": _ratio(F.col("successful_runs"), F.col("total_runs")) * 100,
            "failure_rate": _ratio(F.col("failed_runs"), F.col("total_runs")) * 100,
        }
    )


def error_types(runs: DataFrame) -> DataFrame:
    """`(error_type, n)`: the part of the message before its first colon."""
    kind = F.trim(F.substring_index("error_message", ":", 1))
    return runs.filter(F.length("error_message") > 0).groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


def request_metrics(log: DataFrame) -> DataFrame:
    """`(total, successful, failed, success_rate, avg_time, total_time, avg_size)`."""
    one = log.agg(
        F.count("*").alias("total_requests"),
        F.count_if("ok").alias("successful_requests"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
    )
    return one.withColumn("success_rate", _ratio(F.col("successful_requests"), F.col("total_requests")))


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin("pending", "running"))


def retention_purge(df: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Rows younger than the retention period; the filter reaches the scan."""
    return df.filter(q(ts) >= now - F.make_dt_interval(F.lit(days)))
