"""Hash keys that any engine can recompute, for splits that never depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = 1 << 52


def row_hash(*keys: Column, seed: int = 42) -> Column:
    """A 52-bit number from md5 over the seed and the keys, exact in a double."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def row_hash_sql(*keys: str, seed: int = 42) -> str:
    """The same number as a SQL expression."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT"
