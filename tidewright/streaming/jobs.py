"""Streams over arriving files: sessions, incremental statistics, appends and replay checks.

Every job runs what is there and stops (`availableNow`), so the same code serves a scheduled
catch-up; give a trigger to keep it running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import Admission, Limits
from ..operators.reduce import Scatter, StoredScatter
from ..operators.sequences import micros
from ..schema import q
from ..session import scratch_path

WATERMARK = "1 hour"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive; `path` may be a folder or a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_complete(df: DataFrame, path: str | None = None) -> DataFrame:
    """Run an aggregate and return its final result; each batch replaces the table before."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "stream-out")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    job = (
        df.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.parquet(path)


def run_append(df: DataFrame, path: str | None = None, state: str | None = None) -> DataFrame:
    """Append results to a parquet table once; the sink records which batches it holds."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "stream-out")
    job = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", state or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.parquet(path)


def run_closed(events: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], far: str = "2200-01-01") -> DataFrame:
    """Run a job in append output to its end, with what was still open when the rows ended.

    After the rows one mark with a far time and no other value comes in by a folder of its own, so the watermark passes all there is.
    The second run takes up the checkpoint of the first.
    """
    spark = events.sparkSession
    folder, path, state = (scratch_path(spark, n) for n in ("stream-marks", "stream-out", "stream-state"))
    empty = spark.createDataFrame([], events.schema)
    empty.write.parquet(folder)
    job = build(events.unionByName(spark.readStream.schema(events.schema).parquet(folder)))
    run_append(job, path, state)
    mark = spark.range(1).select(*[(F.lit(far) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    mark.write.mode("append").parquet(folder)
    return run_append(job, path, state)


def scatter_stream(rows: DataFrame, columns: list[str], folder: str, state: str | None = None) -> Scatter:
    """Take every micro-batch into the scatter stored in `folder`, from which components follow at any time."""
    spark = rows.sparkSession
    stored = StoredScatter(spark, folder)
    job = (
        rows.writeStream.foreachBatch(lambda batch, number: stored.take(batch, columns, number) and None)
        .option("checkpointLocation", state or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return stored.last()[1]


def sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Sessions that end after a pause: `(key, created_at, last_update, updates)`.

    Works on batches and on streams (complete, or append with sessions still open withheld).
    """
    grouped = events.withWatermark(ts, watermark).groupBy(q(key), F.session_window(q(ts), gap).alias("w"))
    return grouped.agg(
        F.min(ts).alias("created_at"), F.max(ts).alias("last_update"), F.count("*").alias("updates")
    ).drop("w")


def incremental_stats(events: DataFrame, ts: str, value: str, every: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Rows, sum and an order-free hash per time bucket, kept up to date as rows arrive."""
    line = F.concat_ws("|", *[q(c).cast("string") for c in events.columns])
    hashed = F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("decimal(20,0)")
    grouped = events.withWatermark(ts, watermark).groupBy(F.window(q(ts), every).alias("w"))
    rolled = grouped.agg(F.count("*").alias("rows"), F.sum(value).alias("total"), F.sum(hashed).cast("string").alias("data_hash"))
    return rolled.select(F.col("w.start").alias("bucket"), "rows", "total", "data_hash")


def drop_replays(events: DataFrame, key: Column, ts: str, window: str = "5 minutes") -> DataFrame:
    """First use of each key within the window."""
    return events.withColumn("__nonce", key).withWatermark(ts, window).dropDuplicatesWithinWatermark(["__nonce"]).drop("__nonce")


def brute_force_windows(events: DataFrame, key: str, ts: str, more_than: int = 10, watermark: str = WATERMARK) -> DataFrame:
    """Keys with more failures than allowed in a quarter hour, checked every minute."""
    grouped = events.withWatermark(ts, watermark).groupBy(q(key), F.window(q(ts), "15 minutes", "1 minute").alias("w"))
    return grouped.agg(F.count("*").alias("failures")).filter(F.col("failures") > more_than)


STATE_SCHEMA = "times array<long>, costs array<double>"


def admit_stream(events: DataFrame, key: str, ts: str, cost: str, limits: Limits = Limits()) -> DataFrame:
    """Admission with refused requests not counted; the state is the admitted requests of a day."""
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType())])

    def decide(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Admission(limits)
        if state.exists:
            times, costs = state.get
            gate.admitted = list(zip(times, costs))
        # A micro-batch brings a key's new rows in no order.
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        verdicts = [gate.admit(at, float(c)) for at, c in zip(micros(rows[ts]), rows[cost].tolist())]
        state.update(([t for t, _ in gate.admitted], [c for _, c in gate.admitted]))
        yield rows.assign(allowed=[v for v, _ in verdicts], reason=[r for _, r in verdicts])

    return events.groupBy(q(key)).applyInPandasWithState(decide, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
