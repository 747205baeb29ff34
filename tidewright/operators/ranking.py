"""Global order without a one-task window: value-range buckets and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import durable

BUCKET_ROWS = 500_000


def value_buckets(counts: DataFrame, value: str, rows: int, bucket_rows: int) -> DataFrame:
    """Add `bucket`: value ranges that hold about the same number of rows each.

    The rows must be distinct values, so no single value can overfill a bucket.
    """
    wanted = max(1, -(-rows // bucket_rows))
    marks: list[float] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = counts.agg(
            F.percentile_approx(F.col(value).cast("double"), shares, max(10_000, 10 * wanted)).alias("m")
        ).first()
        marks = sorted(set(found["m"]))
    if not marks:
        return counts.withColumn("bucket", F.lit(0))
    splits = [float("-inf"), *marks, float("inf")]
    doubled = counts.withColumn("__v", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="__v", outputCol="__b").transform(doubled)
    return cut.withColumn("bucket", F.col("__b").cast("int")).drop("__v", "__b")


def running_totals(
    counts: DataFrame, value: str, sums: Sequence[str], bucket_rows: int = BUCKET_ROWS, rows: int | None = None
) -> DataFrame:
    """For each distinct value, the totals over all strictly smaller values (`before_<sum>`)."""
    rows = counts.count() if rows is None else rows
    cut = value_buckets(counts, value, rows, bucket_rows)
    in_bucket = W.partitionBy("bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumns(
        {f"before_{s}": F.coalesce(F.sum(s).over(in_bucket), F.lit(0)) for s in sums}
    )
    if rows <= bucket_rows:
        return inner.drop("bucket")
    # One row for every `bucket_rows` values from here on: small in one window and to broadcast.
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in sums])
    shift = totals.select(
        "bucket", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"shift_{s}") for s in sums]
    )
    joined = inner.join(F.broadcast(shift), "bucket")
    return joined.withColumns(
        {f"before_{s}": F.col(f"before_{s}") + F.col(f"shift_{s}") for s in sums}
    ).drop("bucket", *[f"shift_{s}" for s in sums])


# Fixed value: Spark's increasing ids hold the partition above these bits and the row below.
ROW_BITS = 33


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in the total order given by `order`.

    Range partitioning splits on the full order key, so one repeated leading value does not
    fill a partition as long as the key ends in an id. Rows are sorted and numbered inside
    their range in the same stage; what remains is adding the sizes of the ranges before. The
    ranges are sampled anew on each run, hence the cut before the numbers are used twice.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(placed.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__pid", F.shiftright("__id", ROW_BITS))
    sizes = placed.groupBy("__pid").agg(F.count("*").alias("__n"))
    # One row per partition.
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "__pid")
        .withColumn(name, F.col("__start") + inner)
        .drop("__pid", "__id", "__start")
    )


def global_running(df: DataFrame, order: str, column: str, name: str = "before") -> DataFrame:
    """Add the total of a whole-number column over all rows before, for distinct values of any type in `order`."""
    placed = global_index(df, [order], "__at")
    cut = F.expr(f"__at div {BUCKET_ROWS}")
    inner = placed.withColumn("__b", cut).withColumn("__in", F.coalesce(F.sum(column).over(W.partitionBy("__b").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # One row for every `BUCKET_ROWS` rows.
    sums = placed.groupBy(cut.alias("__b")).agg(F.sum(column).alias("__s"))
    shift = sums.select("__b", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return inner.join(F.broadcast(shift), "__b").withColumn(name, F.col("__in") + F.col("__shift")).drop("__at", "__b", "__in", "__shift")
