"""Left join with a table of distinct keys, safe for large tables and hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import q
from ..session import durable

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 10_000  # at most this many keys can hold 1/HOT_SHARE of all rows each
SALTS = 64


def measure(mapping: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a mapping, the bytes as its rows take written as JSON."""
    row = F.octet_length(F.to_json(F.struct(*[q(c) for c in mapping.columns])))
    found = mapping.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return found[0], found[1]


def lookup_join(
    df: DataFrame,
    mapping: DataFrame,
    key: str,
    values: Sequence[str],
    map_key: str = "value",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: tuple[int, int] | None = None,
) -> DataFrame:
    """Add `values` of `mapping` (one row per `map_key`) to `df`; unmatched and NULL keys get NULL.

    A mapping is broadcast when its rows and bytes, both measured, are within the limits. Otherwise
    the keys of `df` are counted with map-side combination; the few hot ones are broadcast with their
    values, matched or not, so their rows are settled without a shuffle by key. All other rows are joined,
    with settled rows spread over salts so they do not meet in one task. `measured` is what `measure`
    gave for a mapping that is used several times.
    """
    right = mapping.select(q(map_key).alias("__k"), *[q(v) for v in values])
    size, width = measured or measure(right)
    if size <= broadcast_rows and width <= broadcast_bytes:
        return df.join(F.broadcast(right), q(key) == F.col("__k"), "left").drop("__k")
    held = durable(df.filter(q(key).isNotNull()).groupBy(q(key).alias("__lk")).agg(F.count("*").alias("__w")))
    total = held.agg(F.sum("__w")).first()[0] or 0
    often = held.filter(F.col("__w") >= max(total / HOT_SHARE, 2)).select("__lk")
    # At most HOT_SHARE rows.
    matched = right.join(F.broadcast(often), F.col("__lk") == F.col("__k")).drop("__lk")
    hot = often.join(F.broadcast(matched), F.col("__lk") == F.col("__k"), "left").select(
        F.col("__lk").alias("__hk"), *[q(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__hot")
    )
    # Always 0, but no literal: the optimizer would take a literal out of the join's keys, and the salts with it.
    zero = F.pmod(F.xxhash64("__k"), F.lit(1)).cast("int")
    cold = right.select(F.col("__k").alias("__ck"), *[q(v).alias(f"__c_{v}") for v in values], zero.alias("__cs"))
    marked = df.join(F.broadcast(hot), q(key) == F.col("__hk"), "left").drop("__hk")
    settled = F.coalesce(F.col("__hot"), F.lit(False)) | q(key).isNull()
    spread = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    marked = marked.withColumn("__salt", F.when(settled, spread).otherwise(0))
    joined = marked.join(cold, (q(key) == F.col("__ck")) & (F.col("__salt") == F.col("__cs")), "left")
    return joined.select(
        *[q(c) for c in df.columns if c not in values],
        *[F.coalesce(q(f"__h_{v}"), q(f"__c_{v}")).alias(v) for v in values],
    )
