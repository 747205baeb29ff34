"""Samples, splits and folds that depend on row keys only, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.hashing import SPAN, row_hash
from ..schema import as_list, q, require
from ..session import durable
from .lookup import lookup_join
from .ranking import BUCKET_ROWS, global_index, global_running

FOLD_SCALE = 1_000_000


def _hash(df: DataFrame, key: str | Sequence[str], seed: int) -> Column:
    return row_hash(*[q(k) for k in require(df, key)], seed=seed)


def sample_random(df: DataFrame, key: str | Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly `n` rows (all when there are fewer), the ones with the smallest key hash.

    Only rows below a threshold that keeps slightly more than `n` are sorted, in ranges: no task takes all.
    """
    hashed = df.withColumn("__h", _hash(df, key, seed))
    rows = df.count()
    if rows <= n:
        return df
    share = (n + 10 * math.sqrt(n) + 100) / rows
    while share < 1:
        kept = hashed.filter(F.col("__h") < int(share * SPAN))
        if kept.count() >= n:
            hashed = kept
            break
        share *= 2
    placed = global_index(hashed, ["__h", *as_list(key)], "__at")
    return placed.filter(F.col("__at") < n).select(*[q(c) for c in df.columns])


def _group(by: str) -> Column:
    """The group of a row as text; a missing one is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), q(by).cast("string")), F.lit("-"))


def _group_sizes(df: DataFrame, by: str) -> DataFrame:
    """`(__g, value, n)` of each group, written once: groups may be many."""
    return durable(df.groupBy(q(by).alias("value")).agg(F.count("*").alias("n")).withColumn("__g", _group("value")))


def _keep_smallest(df: DataFrame, by: str, key, seed: int, groups: DataFrame) -> DataFrame:
    """Per group the `take` rows with the smallest hash, exactly, without sorting a whole group.

    `groups` holds `(__g, n, take)`. A hash threshold leaves a few more rows than wanted; only those are ranked. It
    is checked and widened where it kept too few.
    """
    hashed = df.withColumn("__h", _hash(df, key, seed)).withColumn("__by", _group(by))
    widen = 1.0
    while True:
        near_share = F.lit(widen) * (F.col("take") + 10 * F.sqrt("take") + 100) / F.greatest("n", F.lit(1))
        cut = F.when(near_share >= 1, F.lit(SPAN)).otherwise(F.floor(near_share * SPAN)).cast("long")
        cuts = groups.filter("take > 0").select("__g", "n", F.col("take").alias("__q"), cut.alias("__cut"))
        near = lookup_join(hashed, cuts, "__by", ["__q", "__cut"], map_key="__g").filter(F.col("__h") < F.col("__cut"))
        kept = near.groupBy("__by").agg(F.count("*").alias("kept"))
        short = cuts.join(kept, F.col("__g") == F.col("__by"), "left")
        short = short.filter((F.coalesce("kept", F.lit(0)) < F.least("__q", "n")) & (F.col("__cut") < SPAN))
        if short.isEmpty():
            break
        widen *= 2
    ranked = _class_rank(near, by, key, seed, F.col("__cut"))
    return ranked.filter(F.col("__rank") < F.col("__q")).select(*[q(c) for c in df.columns])


def sample_stratified(df: DataFrame, by: str, key: str | Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Per stratum max(1, floor(share x n)) rows, and at most `n` in all.

    Strata come in sorted order, so the overall limit cuts the last ones.
    """
    sizes = _group_sizes(df, by)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= n:
        return df
    share = F.least(F.greatest(F.lit(1), F.expr(f"(n * {n}) div {total}")), F.col("n"))
    wanted = sizes.filter("value is not null").withColumn("share", share)
    earlier = global_running(wanted, "value", "share")
    return _keep_smallest(df, by, key, seed, earlier.withColumn("take", F.greatest(F.lit(0), F.least(F.col("share"), F.lit(n) - F.col("before")))))


def undersample(df: DataFrame, by: str, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest one."""
    sizes = _group_sizes(df, by).filter("value is not null")
    least = sizes.agg(F.min("n")).first()[0] or 0
    return _keep_smallest(df, by, key, seed, sizes.withColumn("take", F.lit(least)))


def sample_systematic(df: DataFrame, order: Sequence[str], target: int = 10_000) -> DataFrame:
    """Every k-th row in the given order, with k = rows // target."""
    rows = df.count()
    step = max(1, rows // target)
    if step == 1:
        return df
    indexed = global_index(df, [q(c) for c in order])
    return indexed.filter(F.col("row_index") % step == 0).drop("row_index")


def _test_share(df: DataFrame, test_size: float) -> float:
    rows = df.count()
    if rows and rows * test_size < 2:
        return max(2 / rows, 0.1)
    return test_size


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `is_test` from the key hash; a row keeps its side however the table grows."""
    share = _test_share(df, test_size)
    bucket = F.pmod(_hash(df, key, seed), F.lit(FOLD_SCALE))
    return df.withColumn("is_test", bucket < int(round(FOLD_SCALE * share)))


def _class_rank(df: DataFrame, by: str, key, seed: int, top: Column | None = None) -> DataFrame:
    """Add `__rank`, the zero-based hash order inside a class; hashes lie below `top`.

    Classes are spread over hash ranges and ranked range by range, so a class that holds most
    rows is never sorted by one task.
    """
    largest = df.groupBy(q(by)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    parts = max(1, -(-largest // BUCKET_ROWS))
    hashed = df.withColumn("__h", _hash(df, key, seed))
    placed = hashed.withColumn("__p", F.floor(F.col("__h") / (F.lit(SPAN) if top is None else top) * F.lit(parts)).cast("int"))
    order = ["__h", *[q(k) for k in as_list(key)]]
    inner = F.row_number().over(W.partitionBy(q(by), "__p").orderBy(*order)) - 1
    ranked = placed.withColumn("__inner", inner)
    if parts == 1:
        return ranked.withColumn("__rank", F.col("__inner")).drop("__h", "__p", "__inner")
    per_part = placed.groupBy(q(by).alias("__rby"), F.col("__p").alias("__pp")).agg(F.count("*").alias("__n"))
    earlier = W.partitionBy("__rby").orderBy("__pp").rowsBetween(W.unboundedPreceding, -1)
    shift = per_part.withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    joined = ranked.join(shift, q(by).eqNullSafe(F.col("__rby")) & (F.col("__p") == F.col("__pp")))
    return joined.withColumn("__rank", F.col("__inner") + F.col("__shift")).drop("__h", "__p", "__inner", "__rby", "__pp", "__shift")


def train_test_split_stratified(
    df: DataFrame, by: str, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test` with the same share in every class; plain split when a class is too small."""
    share = _test_share(df, test_size)
    sizes = _group_sizes(df, by)
    least, rows, groups = sizes.agg(F.min("n"), F.sum("n"), F.count("*")).first()
    if (least or 0) < 2 or rows * share < groups:
        return train_test_split(df, key, test_size, seed)
    quota = sizes.select("__g", F.floor(F.col("n") * F.lit(share) + 0.5).cast("long").alias("__take"))
    ranked = lookup_join(_class_rank(df, by, key, seed).withColumn("__by", _group(by)), quota, "__by", ["__take"], map_key="__g")
    return ranked.withColumn("is_test", F.col("__rank") < F.col("__take")).select(*[q(c) for c in df.columns], "is_test")


def kfold(df: DataFrame, key: str | Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` (0-based) from the key hash."""
    return df.withColumn("fold", F.pmod(_hash(df, key, seed), F.lit(folds)).cast("int"))


def stratified_kfold(df: DataFrame, by: str, key: str | Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` so that class sizes differ by at most one row between folds."""
    ranked = _class_rank(df, by, key, seed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(folds)).cast("int")).drop("__rank")


def class_weights(df: DataFrame, by: str) -> DataFrame:
    """`(class, n, weight)` with weight = rows / (classes x class rows)."""
    sizes = _group_sizes(df, by).filter("value is not null")
    total, groups = sizes.agg(F.sum("n"), F.count("*")).first()
    return sizes.select(F.col("value").alias("class"), "n", (F.lit(float(total or 0)) / (F.lit(groups) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, by: str, column: str = "weight") -> DataFrame:
    """Add the balanced class weight as a column for `weightCol`."""
    weights = class_weights(df, by).select(_group("class").alias("__g"), F.col("weight").alias(column))
    return lookup_join(df.withColumn("__by", _group(by)), weights, "__by", [column], map_key="__g").drop("__by")
