"""Order-dependent work inside keys, cut into time or sequence ranges so no key fills a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..schema import q
from ..session import durable

MICROS = 1_000_000


def trailing(
    df: DataFrame,
    key: str,
    ts: str,
    measures: dict[str, tuple[float, Column]],
    include_edge: bool = True,
    range_seconds: float = 3600,
) -> DataFrame:
    """Add aggregates over the trailing seconds of each row's key: `{name: (seconds, aggregate)}`.

    A key is cut into time ranges at least as long as the longest span. A row also visits the
    next range when it can still count there, and only rows in their own range are returned.
    """
    longest = max(s for s, _ in measures.values())
    span, width = int(longest * MICROS), int(max(longest, range_seconds) * MICROS)
    at = F.unix_micros(q(ts))
    placed = df.withColumn("__us", at).withColumn("__range", F.floor(F.col("__us") / width))
    visits = F.when(
        (F.col("__range") + 1) * width - F.col("__us") <= span, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("__visit", F.explode(visits)).withColumn("__range", F.col("__range") + F.col("__visit"))
    edge = 0 if include_edge else 1
    out = {}
    for name, (seconds, aggregate) in measures.items():
        w = W.partitionBy(q(key), "__range").orderBy("__us").rangeBetween(-int(seconds * MICROS) + edge, 0)
        out[name] = aggregate.over(w)
    return placed.withColumns(out).filter(F.col("__visit") == 0).drop("__us", "__range", "__visit")


def trailing_sums(
    df: DataFrame, key: str, ts: str, measures: dict[str, tuple[float, Column | None]], include_edge: bool = True
) -> DataFrame:
    """Add sums over the trailing seconds of each row's key: `{name: (seconds, value)}`, without a value the number of rows.

    Every sum is the difference of two running totals of the key: the one at the row, later rows of the same time included, and the one
    where its span begins. Both places are marks in one order of keys and times, which is cut into ranges of equal size wherever a key
    begins or ends; a range passes on nothing but the total of its last key. Sums of fractions are rounded to nine places. Rows without a time get
    no sums; missing values count as nothing.
    """
    values = {name: (F.lit(1).cast("long") if v is None else F.coalesce(v.cast("double"), F.lit(0.0))) for name, (_, v) in measures.items()}
    spans = sorted({int(s * MICROS) for s, _ in measures.values()})
    rows = durable(df.withColumn("__rid", F.monotonically_increasing_id()))
    names = [f"__v{i}" for i in range(len(measures))]
    us = F.unix_micros(q(ts))
    # Sides of a moment: before its rows, the rows, behind them.
    marks = [
        F.struct(us.alias("us"), F.lit(1).alias("side"), F.lit(-1).alias("slot"), *[v.cast("double").alias(n) for n, v in zip(names, values.values())])
    ]
    none = [F.lit(0.0).alias(n) for n in names]
    marks.append(F.struct(us.alias("us"), F.lit(2).alias("side"), F.lit(0).alias("slot"), *none))
    for i, span in enumerate(spans):
        marks.append(F.struct((us - span).alias("us"), F.lit(0 if include_edge else 2).alias("side"), F.lit(i + 1).alias("slot"), *none))
    laid = rows.filter(q(ts).isNotNull()).select(q(key).alias("key"), "__rid", F.inline(F.array(*marks)))
    full = keyed_totals(laid, ["us", "side", "__rid", "slot"], names, ["__rid", "slot"])
    wide = full.groupBy("__rid").agg(
        *[
            F.max(F.when(F.col("slot") == slot, F.col(n))).alias(f"{n}_{slot}")
            for n, (seconds, _) in zip(names, measures.values())
            for slot in (0, spans.index(int(seconds * MICROS)) + 1)
        ]
    )
    out = []
    for n, (name, (seconds, v)) in zip(names, measures.items()):
        gap = F.col(f"{n}_0") - F.col(f"{n}_{spans.index(int(seconds * MICROS)) + 1}")
        out.append((F.round(gap).cast("long") if v is None else F.round(gap, 9)).alias(name))
    return rows.join(wide, "__rid", "left").select(*[q(c) for c in df.columns], *out)


def keyed_totals(laid: DataFrame, order: Sequence[str], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Running totals of the columns `names` over the rows of each `key` in the given order, the row itself included.

    Rows with a negative `slot` count but are not returned; `(key, *keep, *names)` of the others are. Keys and order are cut into ranges of
    equal size, so a key with all rows is many tasks; the order has to tell rows apart.
    """
    sorted_ = laid.select(*dict.fromkeys(["key", "slot", *order, *names, *keep])).repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    found = durable(_range_totals(sorted_, names, keep))
    carried = _carried(found.filter("slot < 0").select("range", "slot", "key", *names).collect(), names)
    fields = "range int, " + ", ".join(f"c{i} double" for i in range(len(names)))
    # One row per range.
    carry = laid.sparkSession.createDataFrame(carried or [(-1, *[0.0] * len(names))], fields)
    full = found.filter("slot >= 0").join(F.broadcast(carry), "range", "left")
    missing = F.when(F.col("head"), F.lit(1.0)).otherwise(F.lit(0.0))
    return full.select("key", *keep, *[(F.col(n) + missing * F.coalesce(F.col(f"c{i}"), F.lit(0.0))).alias(n) for i, n in enumerate(names)])


def _range_totals(laid: DataFrame, names: Sequence[str], keep: Sequence[str] = ("__rid", "slot")) -> DataFrame:
    """Running totals per key inside each partition, for the marks that ask for one (`slot` of 0 or more).

    `head` tells rows of the first key of the partition. Two more rows give the totals of its first key (slot -1) and its last (-2).
    """
    kept = [c for c in keep if c != "slot"]
    schema = T.StructType(
        [
            T.StructField("range", T.IntegerType()), T.StructField("key", laid.schema["key"].dataType), T.StructField("slot", T.IntegerType()), T.StructField("head", T.BooleanType()),
            *[T.StructField(c, laid.schema[c].dataType) for c in kept], *[T.StructField(n, T.DoubleType()) for n in names],
        ]
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        first = last = None  # ([key], totals): a key may itself be missing
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            kind = keys.type
            slots = batch.column("slot").to_numpy()
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
            lengths = np.diff(np.r_[starts, len(codes)])
            values = np.column_stack([batch.column(n).to_numpy() for n in names])
            sums = np.concatenate([np.cumsum(values[s : s + n], axis=0) for s, n in zip(starts, lengths)])
            opening = [keys[0].as_py()]
            if last is not None and last[0] == opening:
                sums[: lengths[0]] += last[1]
            head = np.zeros(len(codes), dtype=bool)
            if first is None or first[0] == opening:
                head[: lengths[0]] = True
                first = (opening, sums[lengths[0] - 1].copy())
            last = ([keys[len(codes) - 1].as_py()], sums[-1].copy())
            ask = np.flatnonzero(slots >= 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ask), place, dtype=np.int32)), keys.take(pa.array(ask)), pa.array(slots[ask].astype(np.int32)), pa.array(head[ask]),
                    *[batch.column(c).take(pa.array(ask)) for c in kept], *[pa.array(sums[ask, i]) for i in range(len(names))],
                ],
                names=schema.names,
            )
        if first is not None:
            ends = [(-1, first), (-2, last)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([place] * 2, pa.int32()), pa.array([k[0] for _, (k, _) in ends], kind), pa.array([s for s, _ in ends], pa.int32()), pa.array([False] * 2),
                    *[pa.nulls(2, batch.column(c).type) for c in kept], *[pa.array([float(t[i]) for _, (_, t) in ends]) for i in range(len(names))],
                ],
                names=schema.names,
            )

    return laid.mapInArrow(total, schema)


def _carried(ends: list, names: Sequence[str]) -> list[tuple]:
    """`(range, totals)` that the ranges before hand on to the first key of a range; two rows per range come in."""
    first = {r["range"]: r for r in ends if r["slot"] == -1}
    last = {r["range"]: r for r in ends if r["slot"] == -2}
    out, open_key, held = [], None, [0.0] * len(names)
    for place in sorted(first):
        before = held if open_key == [first[place]["key"]] else [0.0] * len(names)
        out.append((place, *before))
        single = first[place]["key"] == last[place]["key"]
        ends_with = [float(last[place][n]) for n in names]
        held = [a + b for a, b in zip(before, ends_with)] if single else ends_with
        open_key = [last[place]["key"]]
    return out


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], cut: Column, prefix: str = "prev_"
) -> DataFrame:
    """Add the fields of the row before, per key; `cut` splits a key's order into ranges.

    Inside a range this is a lag; the first row takes the last row of the nearest earlier
    range, found in a table of one row per key and range.
    """
    placed = df.withColumn("__cut", cut)
    inside = W.partitionBy(*keys, "__cut").orderBy(*order)
    fields_struct = F.struct(*[q(f) for f in fields])
    lagged = placed.withColumn("__lag", F.lag(fields_struct).over(inside))
    last = placed.groupBy(*keys, "__cut").agg(F.max_by(fields_struct, F.struct(*[q(o) for o in order])).alias("__last"))
    carried = last.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy("__cut"))).drop("__last")
    joined = lagged.join(carried, [*keys, "__cut"], "left")
    before = F.coalesce("__lag", "__carry")
    return joined.select(
        *[q(c) for c in df.columns], *[before.getField(f).alias(f"{prefix}{f}") for f in fields]
    )


def running_latest(df: DataFrame, key: str, order: Sequence[str], value: Column, cut: Column, name: str) -> DataFrame:
    """Add the largest non-null `value` seen so far in the key (for values that grow)."""
    placed = df.withColumn("__cut", cut).withColumn("__val", value)
    inside = W.partitionBy(q(key), "__cut").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = placed.withColumn("__in", F.max("__val").over(inside))
    per_range = placed.groupBy(q(key).alias("__k"), F.col("__cut").alias("__c")).agg(F.max("__val").alias("__m"))
    earlier = W.partitionBy("__k").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    carried = per_range.withColumn("__carry", F.max("__m").over(earlier)).drop("__m")
    joined = inner.join(carried, (q(key) == F.col("__k")) & (F.col("__cut") == F.col("__c")), "left")
    return joined.select(*[q(c) for c in df.columns], F.coalesce("__in", "__carry").alias(name))


def in_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make_step: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run a stateful step over each key's rows in order, batch by batch.

    Keys arrive one after the other, their rows sorted and in Arrow batches, so memory holds
    one batch and whatever the step keeps; a key is never gathered whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make_step()
        for batch in batches:
            if len(batch):
                yield step(batch)

    placed = df.repartition(*[q(k) for k in keys]).sortWithinPartitions(*[q(k) for k in keys], *order)
    return placed.mapInPandas(run, schema)


class Walk:
    """A step over the rows of a key in order. `state` is what the rows before leave; it is text, so that states can be compared."""

    def __init__(self, state: str | None = None):
        """Begin a key, or go on from what an earlier part of it left."""

    def rows(self, rows: pd.DataFrame) -> dict[str, list]:
        """New columns of the next rows."""
        raise NotImplementedError

    def state(self) -> str:
        raise NotImplementedError


def walk_in_ranges(
    df: DataFrame, key: str, order: Sequence[str], make: Callable[[str | None], Walk], columns: list[T.StructField], ranges: int | None = None
) -> DataFrame:
    """Add columns that depend on all rows before in the key, with a key of any size spread over tasks.

    Keys and their order are cut into ranges. Every range is first walked as if its first key began there. Then the state that
    the range before left is compared with the one assumed, and only the first key of ranges where the two differ is walked again;
    that is repeated while the state at the end of such a key changes. What a walk keeps has to be bounded, since one state per range is
    compared on the driver. Ties in the order are broken once, when the ranges are written.
    """
    placed = df.repartitionByRange(*([ranges] if ranges else []), q(key), *order).sortWithinPartitions(q(key), *order)
    placed = durable(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()))
    ends = T.StructType([*placed.schema.fields, *columns, T.StructField("__head", T.BooleanType())])
    ends = ends.add(T.StructField("__left", T.StringType())).add(T.StructField("__first", df.schema[key].dataType))

    def walked(rows: DataFrame, entries: dict[int, str]) -> DataFrame:
        """The rows with their new columns; the last row of a range tells the state it leaves and the first key of the range."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at: tuple | None = None  # range and key
            head, first, step, held = True, None, None, None

            def closed(out: pd.DataFrame) -> pd.DataFrame:
                left, begins = [None] * len(out), [None] * len(out)
                left[-1], begins[-1] = step.state(), first
                return out.assign(__left=left, __first=pd.Series(begins, index=out.index, dtype=object))

            for batch in batches:
                keys, places = batch[key].tolist(), batch["__range"].tolist()
                begin = 0
                while begin < len(batch):
                    k, place = keys[begin], places[begin]
                    end = begin + 1
                    while end < len(batch) and places[end] == place and _same(keys[end], k):
                        end += 1
                    if at is None or at[0] != place:
                        if held is not None:
                            yield closed(held)
                        held, head, first = None, True, k
                        step = make(entries.get(place))
                    elif not _same(at[1], k):
                        head, step = False, make(None)
                    at = (place, k)
                    if held is not None:
                        yield held.assign(__left=None, __first=None)
                    rows_ = batch.iloc[begin:end]
                    held = rows_.assign(**step.rows(rows_), __head=head)
                    begin = end
            if held is not None:
                yield closed(held)

        return rows.repartition("__range").sortWithinPartitions("__range", "__at").mapInPandas(run, ends)

    base = durable(walked(placed, {}))
    assumed = make(None).state()
    seen = {r["__range"]: r for r in base.filter("__left is not null").select("__range", key, "__left", "__first", "__head").collect()}
    left = {p: r["__left"] for p, r in seen.items()}
    entry = dict.fromkeys(seen, assumed)
    version = dict.fromkeys(seen, 0)
    versions = [base]
    places = sorted(seen)
    while True:
        changed = {}
        for before, place in zip(places, places[1:]):
            if _same(seen[before][key], seen[place]["__first"]) and left[before] != entry[place]:
                changed[place] = left[before]
        if not changed:
            break
        entry.update(changed)
        version.update(dict.fromkeys(changed, len(versions)))
        again = base.filter(F.col("__head") & F.col("__range").isin(list(changed))).select(*placed.columns)
        versions.append(durable(walked(again, changed)))
        for r in versions[-1].filter("__left is not null").select("__range", "__left").collect():
            if seen[r["__range"]]["__head"]:  # the range holds one key alone, so it hands on what this walk left
                left[r["__range"]] = r["__left"]
    names = [*df.columns, *[c.name for c in columns]]
    last = [[p for p in places if version[p] == n] for n in range(len(versions))]
    out = base.filter(~F.col("__head") | F.col("__range").isin(last[0])).select(*[q(c) for c in names])
    for n in range(1, len(versions)):
        out = out.unionByName(versions[n].filter(F.col("__range").isin(last[n])).select(*[q(c) for c in names]))
    return out


def _same(a, b) -> bool:
    """Equal keys; a missing key is a key."""
    return a == b or (pd.isna(a) and pd.isna(b))


def micros(stamps: pd.Series) -> list[int]:
    return stamps.astype("datetime64[us]").astype("int64").tolist()
