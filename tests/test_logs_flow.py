import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tidewright.operators import encode, lineage, logs, registry, scale, userfn
from tidewright.plans import flow
from tidewright.schema import TableError
from tidewright.session import scratch_path
from tidewright.sources import append_dataset, scan_auto, scan_excel, scan_records, sink_csv, sink_excel, sink_parquet
from tidewright.streaming import jobs, timers


def log_rows(seed, users=3, n=400):
    rng = random.Random(seed)
    return sorted({(rng.randint(0, 20_000), f"u{rng.randint(0, users - 1)}", round(rng.uniform(0, 40), 2)) for _ in range(n)})


def as_log(spark, rows):
    return spark.createDataFrame(rows, "t long, user string, cost double").withColumn("ts", F.timestamp_seconds("t"))


def admitted(rows, limits):
    """The rule read row by row."""
    out, kept = {}, {}
    for t, user, cost in rows:
        past = kept.setdefault(user, [])
        near = [c for s, c in past if t - s <= 60]
        counts = (len(near), sum(t - s <= 3600 for s, _ in past), sum(t - s <= 86400 for s, _ in past))
        ok = counts[0] < limits.per_minute and counts[1] < limits.per_hour and counts[2] < limits.per_day
        ok = ok and sum(near) + cost <= limits.cost_per_minute
        if ok:
            past.append((t, cost))
        out[(t, user, cost)] = ok
    return out


def test_admission(spark):
    rows, limits = log_rows(1), logs.Limits(2, 12, 40, 50.0)
    got = logs.admit_requests(as_log(spark, rows), "user", "ts", "cost", limits, ["cost"]).collect()
    assert {(r["t"], r["user"], r["cost"]): r["allowed"] for r in got} == admitted(rows, limits)


def test_admission_stream_equals_batch(spark):
    rows, limits = log_rows(2), logs.Limits(2, 12, 40, 50.0)
    folder = scratch_path(spark, "in")
    ordered = sorted(rows)
    for i in range(0, len(ordered), 150):
        as_log(spark, ordered[i : i + 150]).coalesce(1).write.mode("append").parquet(folder)
    schema = as_log(spark, rows).schema
    stream = jobs.file_stream(spark, folder, schema, files_per_batch=1)
    got = jobs.run_append(jobs.admit_stream(stream, "user", "ts", "cost", limits)).collect()
    assert {(r["t"], r["user"], r["cost"]): r["allowed"] for r in got} == admitted(rows, limits)


def test_replays(spark):
    rows = log_rows(3)
    got = logs.replay_dedup(as_log(spark, rows), "user", "ts", 90, ["cost"]).collect()
    last, want = {}, {}
    for t, user, cost in rows:
        fresh = user not in last or t - last[user] > 90
        if fresh:
            last[user] = t
        want[(t, user, cost)] = fresh
    assert {(r["t"], r["user"], r["cost"]): r["accepted"] for r in got} == want


def test_sessions_stream_equals_batch(spark):
    rows = log_rows(4, users=2, n=120)
    folder = sink_parquet(as_log(spark, rows), scratch_path(spark, "in"))
    schema = as_log(spark, rows).schema

    def plain(df):
        return sorted(tuple(r) for r in df.select("user", "created_at", "last_update", "updates").collect())

    batch = plain(jobs.sessions(as_log(spark, rows), "user", "ts", "2 minutes"))
    assert plain(jobs.run_complete(jobs.sessions(jobs.file_stream(spark, folder, schema), "user", "ts", "2 minutes"))) == batch
    closed = plain(jobs.run_append(jobs.sessions(jobs.file_stream(spark, folder, schema), "user", "ts", "2 minutes", "1 minute")))
    assert closed and set(closed) <= set(batch)


def test_timed_streams_equal_batch_and_drop_late_rows(spark):
    timers.timed(spark)
    rows = log_rows(6, users=3, n=200)
    folder = scratch_path(spark, "in")
    ordered = sorted(rows)
    for i in range(0, len(ordered), 70):  # rows come out of order inside a file
        part = ordered[i : i + 70]
        random.Random(i).shuffle(part)
        as_log(spark, part).coalesce(1).write.mode("append").parquet(folder)
    late = [(5, "u0", 1.0), (6, "u9", 1.0)]
    as_log(spark, late).coalesce(1).write.mode("append").parquet(folder)
    schema = as_log(spark, rows).schema
    stream = jobs.file_stream(spark, folder, schema, files_per_batch=1)

    found = jobs.run_closed(stream, "ts", lambda e: timers.timed_sessions(e, "user", "ts", 120, "10 minutes"))
    names = ["user", "created_at", "last_update", "updates"]
    batch = jobs.sessions(as_log(spark, rows), "user", "ts", "2 minutes")
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))

    alerts = jobs.run_closed(stream, "ts", lambda e: timers.timed_brute_force(e, "user", "ts", 2, 15, "10 minutes"))
    windows = jobs.brute_force_windows(as_log(spark, rows), "user", "ts", 2)
    got = sorted(map(tuple, alerts.select("user", "start", "failures").collect()))
    assert got and got == sorted(map(tuple, windows.select("user", "w.start", "failures").collect()))

    totals = jobs.run_closed(stream, "ts", lambda e: jobs.incremental_stats(e, "ts", "cost", "1 hour", "10 minutes"))
    plain = jobs.incremental_stats(as_log(spark, rows), "ts", "cost", "1 hour")
    assert sorted(map(tuple, totals.select("bucket", "rows").collect())) == sorted(map(tuple, plain.select("bucket", "rows").collect()))


def test_open_state_is_bounded():
    """What a key keeps of a long log: sessions that may still grow, minutes of windows that are open."""

    class Handle:
        def __init__(self):
            self.timers, self.value = set(), None

        def getValueState(self, *_):
            return self

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)
        listTimers = lambda self: sorted(self.timers)
        deleteTimer = lambda self, t: self.timers.discard(t)
        registerTimer = lambda self, t: self.timers.add(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    key = T.StructField("user", T.StringType())
    for step in (timers.OpenSessions("ts", 120_000_000, key), timers.MinuteRing("ts", 15, 0, key)):
        handle, made, most = Handle(), 0, 0
        step.init(handle)
        for i in range(300):
            at = pd.Timestamp(i * 300, unit="s")
            list(step.handleInputRows(("u",), iter([pd.DataFrame({"ts": [at]})]), None))
            for timer in sorted(t for t in handle.timers if t <= (i * 300 - 600) * 1000):
                handle.timers.discard(timer)
                made += sum(len(out) for out in step.handleExpiredTimer(("u",), Now((i * 300 - 600) * 1000), Now(timer)))
            most = max(most, len(handle.value[0]))
        assert made > 250 and most <= 8


def test_a_key_holds_one_timer_for_all_its_sessions():
    calls = []

    class Handle:
        value, due = None, set()
        getValueState = lambda self, *_: self
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: calls.append("update") or setattr(self, "value", value)
        clear = lambda self: calls.append("clear") or setattr(self, "value", None)
        listTimers = lambda self: sorted(self.due)
        deleteTimer = lambda self, t: self.due.discard(t)
        registerTimer = lambda self, t: calls.append("timer") or self.due.add(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    step, handle = timers.OpenSessions("ts", 60_000_000, T.StructField("user", T.StringType())), Handle()
    step.init(handle)
    times = pd.to_datetime([i * 600 for i in range(200)], unit="s")
    list(step.handleInputRows(("u",), iter([pd.DataFrame({"ts": times})]), None))
    assert len(handle.due) == 1
    half = (100 * 600 - 1) * 1000
    first = handle.due.pop()
    assert sum(len(out) for out in step.handleExpiredTimer(("u",), Now(half), Now(first))) == 100
    last = handle.due.pop()
    assert last > half and not handle.due
    assert sum(len(out) for out in step.handleExpiredTimer(("u",), Now(10**9), Now(last))) == 100
    assert handle.value is None and len(calls) < 8


def test_lineage(spark):
    nodes = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 1]), (4, [3, 99])], "transformation_id int, dependencies array<int>")
    roots = spark.createDataFrame([(4,)], "root int")
    chain = lineage.lineage_chain(nodes, roots)
    assert sorted((r["transformation_id"], r["level"]) for r in chain.collect()) == [(1, 2), (2, 2), (3, 1), (4, 0)]
    edges = spark.createDataFrame([(1, 2), (2, 3)], "parent_id int, child_id int")
    candidates = spark.createDataFrame([(3, 1), (1, 3), (5, 5)], "parent_id int, child_id int")
    got = {(r["parent_id"], r["child_id"]): r["creates_cycle"] for r in lineage.lineage_cycle_check(edges, candidates).collect()}
    assert got == {(3, 1): True, (1, 3): False, (5, 5): True}


def test_transitions(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "pending"), ("b", 1, "failed"), ("b", 2, "running")], "run_id string, seq long, status string")
    bad = registry.invalid_transitions(log, F.floor(F.col("seq") / 2)).collect()
    assert [(r["run_id"], r["seq"]) for r in bad] == [("a", 3)]


def test_gates(spark):
    metrics = spark.createDataFrame([(1, "accuracy", 0.6), (2, "accuracy", 0.59)], "model_id int, metric string, value double")
    verdict = {r["model_id"]: r["passed"] for r in registry.gate_verdict(registry.quality_gate(metrics)).collect()}
    assert verdict == {1: True, 2: False}


def test_steps(spark, people):
    steps = [
        {"action": "impute", "params": {"strategy": "median", "columns": "value"}},
        {"action": "scale_numeric", "params": {"column": "name"}},
        {"action": "scale_numeric", "params": {"column": "value", "method": "minmax"}},
    ]
    out, status = flow.apply_transformations(people, steps)
    assert [r["status"] for r in status.orderBy("position").collect()] == ["success", "error", "success"]
    assert out.agg(F.min("value"), F.max("value")).first()[:] == (0.0, 1.0)
    _, stopped = flow.apply_transformations(people, steps, continue_on_error=False)
    assert stopped.count() == 2
    assert flow.import_steps(flow.export_steps(steps)) == steps
    spoiled = json.loads(flow.export_steps(steps))
    spoiled["steps"].pop()
    with pytest.raises(TableError):
        flow.import_steps(json.dumps(spoiled))


def test_steps_that_fail_at_run_time(spark):
    rows = [(i, "2024-01-0%d" % (i % 9 + 1) if i % 4 else "no date", float(i), "ab"[i % 2]) for i in range(40)] + [(99, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, day string, x double, kind string")

    @F.udf("int")
    def burst(x):
        return 1 // 0 if x == 7 else 1

    steps = [
        {"action": "extract_date_components", "params": {"column": "day", "components": ["day"]}},
        {"action": "scale_numeric", "params": {"column": "x", "method": "minmax"}},
        {"action": "apply_user_function", "params": {"fn": lambda d: d.withColumn("one", burst(F.col("id")))}},
        {"action": "encode_categorical", "params": {"column": "kind", "method": "label"}},
        {"action": "apply_frequency_encoding", "params": {"column": "kind"}},
    ]
    out, status = flow.run_transformations(df, steps)
    got = [(r["position"], r["status"], r["failed_rows"]) for r in status.orderBy("position").collect()]
    assert got == [(0, "error", 10), (1, "success", None), (2, "error", None), (3, "success", None), (4, "success", None)]
    assert "one" not in out.columns and not [c for c in out.columns if c.startswith("__")]
    made = {r["id"]: r for r in out.collect()}
    assert made[4]["day_day"] is None and made[5]["day_day"] == 6 and made[99]["day_day"] is None
    assert made[0]["x"] == 0.0 and made[39]["x"] == 1.0 and made[3]["kind"] == 0.5 and made[99]["kind"] is None
    _, stopped = flow.run_transformations(df, steps, continue_on_error=False)
    assert [(r["position"], r["status"]) for r in stopped.orderBy("position").collect()] == [(0, "error"), (1, "success"), (2, "error")]


def test_joined_fits_equal_single_ones(spark):
    df = spark.createDataFrame([(i, float(i % 5), i % 3, "xyz"[i % 3] if i % 4 else None, i % 2 == 0) for i in range(50)], "id int, v double, n int, s string, b boolean")
    joined = encode.fit_all_categories(df, ["n", "s", "b"])
    for c in ("n", "s", "b"):
        assert sorted(map(tuple, joined[c].frame.collect())) == sorted(map(tuple, encode.fit_categories(df, c).frame.collect()))
    both = scale.fit_scalers(df, {"minmax": ["v"], "standard": ["n", "v"]})
    assert both["minmax"]["v"].columns == scale.fit_scaler(df, "v", "minmax").columns
    assert both["standard"]["n"].columns == scale.fit_scaler(df, "n").columns


def test_preprocess(spark, people):
    done = flow.preprocess(people, flow.Preparation(label_columns=["category"], scale_columns=["value"]))
    assert done.table.count() == 5
    assert done.table.filter("name is null or value is null").count() == 0
    audit = {(r["action"], r["column"]): r["affected_rows"] for r in done.audit.collect()}
    assert audit["impute_median", "value"] == 1 and audit["impute_mode", "name"] == 1


def test_resume(spark, people):
    calls = []

    def step(name, fail=False):
        def run(df):
            calls.append(name)
            if fail:
                raise ValueError("no")
            return df.withColumn(name, F.lit(1))

        return flow.Step(name, run)

    folder = scratch_path(spark, "run")
    _, first = flow.run_step_pipeline(people, [step("a"), step("b", True), step("c")], folder)
    assert [r["status"] for r in first.collect()] == ["completed", "failed"]
    out, second = flow.run_step_pipeline(people, [step("a"), step("b"), step("c")], folder)
    assert [r["status"] for r in second.collect()] == ["resumed", "completed", "completed"]
    assert calls == ["a", "b", "b", "c"] and {"a", "b", "c"} <= set(out.columns)


def test_user_functions(spark, people):
    out, changes = userfn.apply_user_function(people, lambda d: d.drop("name").withColumn("twice", F.col("value") * 2))
    assert changes == {"added": ["twice"], "dropped": ["name"]} and out.count() == 6
    with pytest.raises(TableError):
        userfn.apply_user_function(people, lambda d: 3)
    with pytest.raises(TableError):
        userfn.grouped_user_function(people, "category", lambda p: p, people.schema, max_group_rows=2)


def test_sources(spark, people):
    path = sink_csv(people.coalesce(1), scratch_path(spark, "csv") + ".csv")
    again = scan_auto(spark, path)
    assert again.count() == 6 and dict(again.dtypes)["value"] == "double"
    with pytest.raises(TableError):
        scan_auto(spark, "/tmp/data.bin")
    assert scan_records(spark, {"a": [1, 2], "b": ["x", None]}).count() == 2
    assert scan_records(spark, [{"a": 1.0}, {"a": float("nan")}], "a double").filter("a is null").count() == 1
    with pytest.raises(TableError):
        append_dataset(people, people.drop("name"))


def test_excel_needs_its_library(spark, people):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(TableError):
            scan_excel(spark, "/tmp/none.xlsx", "a int")
        with pytest.raises(TableError):
            sink_excel(people, "/tmp/none.xlsx")
    else:
        path = scratch_path(spark, "book").removeprefix("file:") + ".xlsx"
        sink_excel(people.select("id", "value"), path)
        assert scan_excel(spark, path, "id long, value double").count() == 6
