"""Exact quantiles (linear interpolation) that never gather a column in one task.

A column of a few rows uses Spark's own `percentile`. A longer one is bracketed by an
approximate sketch, rows below each bracket are counted exactly, and the bracket is narrowed
until few enough rows are left to pick the order statistics from. Every pass is an aggregate
with bounded state, so a few passes cover any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..schema import as_list, q, require_numeric

BUILTIN_ROWS = 200_000  # up to this many values Spark's percentile keeps its map small
PICK_ROWS = 100_000  # most values one bracket may hold when it is finally sorted
SKETCH = 4_000


class _Target:
    """One wanted quantile of one column of one group, and its bracket so far."""

    def __init__(self, n: int, prob: float):
        spot = (n - 1) * prob
        self.n = n
        self.low_rank = math.floor(spot)
        self.share = spot - self.low_rank
        self.high_rank = min(self.low_rank + 1, n - 1) if self.share > 0 else self.low_rank
        self.lo, self.hi = -math.inf, math.inf
        self.below, self.inside = 0, n


def _grouped(df: DataFrame, by: str | None) -> tuple[DataFrame, Column]:
    key = q(by) if by is not None else F.lit(0)
    return df.withColumn("__g", key), F.col("__g")


def exact_quantiles(
    df: DataFrame,
    columns: str | Iterable[str],
    probs: Iterable[float],
    by: str | None = None,
    approx: bool = False,
    builtin_rows: int = BUILTIN_ROWS,
    pick_rows: int = PICK_ROWS,
    sketch: int = SKETCH,
) -> dict[Any, dict[str, list[float | None]]]:
    """Quantiles as `{group: {column: [value per prob]}}`; the only group is 0 without `by`.

    `by` must be a column of few groups (chart categories); callers check that.
    """
    columns = require_numeric(df, as_list(columns))
    probs = list(probs)
    keyed, key = _grouped(df, by)
    keyed = keyed.select("__g", *[q(c).cast("double").alias(c) for c in columns])

    if approx:
        rows = keyed.groupBy(key).agg(
            *[F.percentile_approx(q(c), probs, sketch).alias(c) for c in columns]
        )
        return {r["__g"]: {c: list(r[c] or [None] * len(probs)) for c in columns} for r in rows.collect()}

    counted = keyed.groupBy(key).agg(*[F.count(q(c)).alias(c) for c in columns]).collect()
    sizes = {r["__g"]: {c: r[c] for c in columns} for r in counted}
    if max((n for g in sizes.values() for n in g.values()), default=0) <= builtin_rows:
        rows = keyed.groupBy(key).agg(
            *[F.percentile(q(c), F.array(*map(F.lit, probs))).alias(c) for c in columns]
        )
        return {r["__g"]: {c: list(r[c] or [None] * len(probs)) for c in columns} for r in rows.collect()}

    targets = {
        (g, c, p): _Target(n, prob)
        for g, per in sizes.items()
        for c, n in per.items()
        if n
        for p, prob in enumerate(probs)
    }
    _narrow(keyed, targets, pick_rows, sketch, by is not None)
    picked = _pick(keyed, targets, by is not None)
    out: dict[Any, dict[str, list[float | None]]] = {}
    for g, per in sizes.items():
        out[g] = {}
        for c in per:
            out[g][c] = [picked.get((g, c, p)) for p in range(len(probs))]
    return out


def _with_brackets(keyed: DataFrame, targets: dict, grouped: bool) -> tuple[DataFrame, dict]:
    """Attach each group's bracket ends: literals, or a join with one small row per group."""
    slots = sorted({(c, p) for _, c, p in targets})
    names = {slot: (f"__lo{i}", f"__hi{i}") for i, slot in enumerate(slots)}
    groups = sorted({g for g, _, _ in targets}, key=repr)

    def ends(g: Any) -> list[float | None]:
        out: list[float | None] = []
        for c, p in slots:
            t = targets.get((g, c, p))
            out += [t.lo, t.hi] if t else [None, None]
        return out

    if not grouped:
        values = ends(groups[0])
        flat = [n for slot in slots for n in names[slot]]
        return keyed.withColumns({n: F.lit(v) for n, v in zip(flat, values)}), names
    fields = [T.StructField("__g", keyed.schema["__g"].dataType)]
    fields += [T.StructField(n, T.DoubleType()) for slot in slots for n in names[slot]]
    small = keyed.sparkSession.createDataFrame(
        [(g, *ends(g)) for g in groups], T.StructType([*fields])
    ).withColumnRenamed("__g", "__bg")
    # One row per group, and the groups were already held by the driver.
    joined = keyed.join(F.broadcast(small), keyed["__g"].eqNullSafe(small["__bg"])).drop("__bg")
    return joined, names


def _narrow(keyed: DataFrame, targets: dict, pick_rows: int, sketch: int, grouped: bool) -> None:
    open_targets = {k: t for k, t in targets.items() if t.n > pick_rows}
    while open_targets:
        frame, names = _with_brackets(keyed, open_targets, grouped)
        spots = {k: (t.low_rank - t.below) / max(t.inside - 1, 1) for k, t in open_targets.items()}

        def around(at: float) -> list[float]:
            return [min(1.0, max(0.0, at + side * 4 / sketch)) for side in (-1, 1)]

        # Quantiles of a column that still share their bracket share one sketch.
        sketches: dict[tuple, list[tuple]] = {}
        for c, p in names:
            ends = frozenset((g, t.lo, t.hi) for (g, tc, tp), t in open_targets.items() if (tc, tp) == (c, p))
            sketches.setdefault((c, ends), []).append((c, p))
        place, aggs = {}, []
        for i, slots in enumerate(sketches.values()):
            c, (lo, hi) = slots[0][0], names[slots[0]]
            shares = sorted({x for (g, tc, tp), at in spots.items() if (tc, tp) in slots for x in around(at)})
            inside = F.when(q(c).between(F.col(lo), F.col(hi)), q(c))
            aggs.append(F.percentile_approx(inside, shares, sketch).alias(f"a{i}"))
            place.update({slot: (f"a{i}", shares) for slot in slots})
        marks = {r["__g"]: r for r in frame.groupBy("__g").agg(*aggs).collect()}
        before = {k: (t.lo, t.hi) for k, t in open_targets.items()}
        for (g, c, p), t in open_targets.items():
            name, shares = place[(c, p)]
            lo, hi = around(spots[(g, c, p)])
            t.lo = max(t.lo, marks[g][name][shares.index(lo)])
            t.hi = min(t.hi, marks[g][name][shares.index(hi)])
        _count_brackets(keyed, open_targets, grouped)
        for k, t in open_targets.items():
            # The sketch only suggests; a bracket that missed its rank goes back to its old end.
            missed_low = t.low_rank < t.below
            missed_high = t.high_rank >= t.below + t.inside
            if missed_low:
                t.lo = before[k][0]
            if missed_high:
                t.hi = before[k][1]
        if any(
            t.low_rank < t.below or t.high_rank >= t.below + t.inside for t in open_targets.values()
        ):
            _count_brackets(keyed, open_targets, grouped)
        open_targets = {
            k: t
            for k, t in open_targets.items()
            if t.inside > pick_rows and t.lo < t.hi and (t.lo, t.hi) != before[k]
        }


def _count_brackets(keyed: DataFrame, targets: dict, grouped: bool) -> None:
    frame, names = _with_brackets(keyed, targets, grouped)
    aggs = []
    for i, ((c, _), (lo, hi)) in enumerate(names.items()):
        aggs.append(F.count_if(q(c) < F.col(lo)).alias(f"b{i}"))
        aggs.append(F.count_if(q(c).between(F.col(lo), F.col(hi))).alias(f"i{i}"))
    rows = {r["__g"]: r for r in frame.groupBy("__g").agg(*aggs).collect()}
    for i, (c, p) in enumerate(names):
        for (g, tc, tp), t in targets.items():
            if (tc, tp) == (c, p):
                t.below, t.inside = rows[g][f"b{i}"], rows[g][f"i{i}"]


def _pick(keyed: DataFrame, targets: dict, grouped: bool) -> dict[tuple, float]:
    """Count the values inside each bracket and walk them to the wanted ranks."""
    frame, names = _with_brackets(keyed, targets, grouped)
    slots = list(names)
    cells = F.array(
        *[
            F.when(
                q(c).between(F.col(names[(c, p)][0]), F.col(names[(c, p)][1])),
                F.struct(F.lit(i).alias("slot"), q(c).alias("v")),
            )
            for i, (c, p) in enumerate(slots)
        ]
    )
    values = (
        frame.select("__g", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x"))
        .groupBy("__g", "x.slot", "x.v")
        .agg(F.count("*").alias("n"))
    )
    rank_rows = [
        (g, slots.index((c, p)), t.low_rank - t.below, t.high_rank - t.below)
        for (g, c, p), t in targets.items()
    ]
    ranks = keyed.sparkSession.createDataFrame(
        rank_rows,
        T.StructType(
            [
                T.StructField("__rg", keyed.schema["__g"].dataType),
                T.StructField("__rs", T.IntegerType()),
                T.StructField("lo_rank", T.LongType()),
                T.StructField("hi_rank", T.LongType()),
            ]
        ),
    )
    walked = values.withColumn(
        "upto", F.sum("n").over(W.partitionBy("__g", "slot").orderBy("v"))
    )
    on = walked["__g"].eqNullSafe(ranks["__rg"]) & (walked["slot"] == ranks["__rs"])
    found = (
        walked.join(F.broadcast(ranks), on)
        .groupBy("__g", "slot")
        .agg(
            F.min(F.when(F.col("upto") > F.col("lo_rank"), F.col("v"))).alias("lo"),
            F.min(F.when(F.col("upto") > F.col("hi_rank"), F.col("v"))).alias("hi"),
        )
    )
    out = {}
    for r in found.collect():
        c, p = slots[r["slot"]]
        t = targets[(r["__g"], c, p)]
        out[(r["__g"], c, p)] = r["lo"] + (r["hi"] - r["lo"]) * t.share
    return out


def quantiles(df: DataFrame, columns, probs, **options) -> dict[str, list[float | None]]:
    """`exact_quantiles` of a whole table."""
    columns, probs = as_list(columns), list(probs)
    empty = {c: [None] * len(probs) for c in columns}
    return exact_quantiles(df, columns, probs, **options).get(0, empty)
