"""Pearson, Spearman and Kendall correlation over pairwise complete rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import corr_strength
from ..schema import TableError, q, require_numeric
from ..session import durable
from .lookup import lookup_join
from .sequences import keyed_totals

MAX_COLUMNS = 100
PAIRS_PER_PASS = 300


def _pairs(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    columns = require_numeric(df, columns)
    if not 2 <= len(columns) <= MAX_COLUMNS:
        raise TableError(f"correlation needs 2 to {MAX_COLUMNS} numeric columns, got {len(columns)}")
    return list(combinations(columns, 2))


def _matrix(df: DataFrame, columns: Sequence[str], upper: list[tuple[str, str, float | None]]) -> DataFrame:
    rows = [(c, c, 1.0) for c in columns]
    for x, y, r in upper:
        r = None if r is None or math.isnan(r) else r
        rows += [(x, y, r), (y, x, r)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, corr double")


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix as `(x, y, corr)`; all pairs of a pass share one aggregate."""
    pairs = _pairs(df, columns)
    upper = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        row = df.agg(
            *[F.corr(q(x).cast("double"), q(y).cast("double")).alias(f"r{i}") for i, (x, y) in enumerate(chunk)]
        ).first()
        upper += [(x, y, row[i]) for i, (x, y) in enumerate(chunk)]
    return _matrix(df, columns, upper)


def _ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(key, value, n, before)` of each distinct value of each column, numbered by `key`: its rows and those with smaller values.

    All columns are counted in one pass, and their running totals are one order of columns and values.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("key"), q(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(cells)).filter("value is not null").groupBy("key", "value").agg(F.count("*").cast("double").alias("n"))
    laid = counts.withColumns({"slot": F.lit(0), "total": F.col("n"), "distinct": F.lit(1.0)})
    found = keyed_totals(laid, ["value"], ["total", "distinct"], ["value", "n"])
    return found.select("key", "value", "n", (F.col("total") - F.col("n")).alias("before"), (F.col("distinct") - 1).cast("long").alias("place"))


def _rank_correlations(df: DataFrame, columns: Sequence[str], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson correlations of average ranks of columns without gaps."""
    ranks = durable(_ranks(df, columns).select("key", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")))
    sizes = {r["key"]: r["n"] for r in ranks.groupBy("key").agg(F.count("*").alias("n")).collect()}
    ranked = df.select(*[q(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        own = ranks.filter(F.col("key") == i).select("value", F.col("rank").alias(f"__r{i}"))
        ranked = lookup_join(ranked, own, f"__v{i}", [f"__r{i}"], measured=(sizes.get(i, 0), 40 * sizes.get(i, 0)))
    place = {c: i for i, c in enumerate(columns)}
    values = ranked.agg(*[F.corr(f"__r{place[x]}", f"__r{place[y]}") for x, y in pairs]).first()
    return dict(zip(pairs, values))


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    """Pearson correlation of average ranks over the complete rows of a pair."""
    both = df.select(q(x), q(y)).na.drop()
    return _rank_correlations(both, [x, y], [(x, y)])[x, y]


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix; columns without gaps are ranked once, other pairs on their complete rows."""
    pairs = _pairs(df, columns)
    row = df.agg(F.count("*").alias("rows"), *[F.count(q(c)).alias(c) for c in columns]).first()
    full = [c for c in columns if row[c] == row["rows"]]
    inside = [(x, y) for x, y in pairs if x in full and y in full]
    found = _rank_correlations(df, full, inside) if inside else {}
    return _matrix(df, columns, [(x, y, found[x, y] if (x, y) in found else spearman(df, x, y)) for x, y in pairs])


def _there(column: str):
    return q(column).isNotNull() & ~F.isnan(q(column).cast("double"))


LEVEL_BITS = 6  # bits that number a level of the tree


def _kendalls(df: DataFrame, pairs: list[tuple[str, str]]) -> list[float | None]:
    """Tau-b of each pair of columns over its complete rows, without listing pairs of rows.

    Equal rows are counted first. The places of the distinct values of y are leaves of a binary tree: two rows with different y part at one node,
    where one goes left and one right. At each node the rows that go right are met by the running total, over x, of those that went left: that is the number
    of pairs that rise. All nodes of all levels and pairs of columns are one order of rows, so no node has to fit a task. Pairs of
    rows that fall follow from the numbers of ties.
    """
    cells = F.array(
        *[
            F.when(_there(x) & _there(y), F.struct(F.lit(i).alias("pair"), q(x).cast("double").alias("x"), q(y).cast("double").alias("y")))
            for i, (x, y) in enumerate(pairs)
        ]
    )
    rows = df.select(F.inline(F.filter(cells, lambda c: c.isNotNull())))
    counted = durable(rows.groupBy("pair", "x", "y").agg(F.count("*").cast("double").alias("n")))
    tied = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    sizes = {r["pair"]: r for r in counted.groupBy("pair").agg(F.sum("n").alias("n"), tied.alias("xy")).collect()}
    ties = {}
    for c in ("x", "y"):
        sums = counted.groupBy("pair", c).agg(F.sum("n").alias("n"))
        ties[c] = {r["pair"]: r["t"] for r in sums.groupBy("pair").agg(tied.alias("t")).collect()}

    # Places of the distinct values of y, from one order of all pairs.
    values = counted.select(F.col("pair").alias("key"), F.col("y").alias("value")).distinct()
    laid = values.withColumns({"slot": F.lit(0), "at": F.lit(1.0)})
    places = durable(keyed_totals(laid, ["value"], ["at"], ["value"]).select("key", "value", (F.col("at") - 1).cast("long").alias("place")))
    depth = max(1, int(places.agg(F.max("place")).first()[0] or 0).bit_length())
    key = F.concat_ws(":", F.col("key").cast("string"), F.col("value").cast("string"))
    named = places.select(key.alias("value"), "place")
    placed = lookup_join(counted.withColumn("__y", F.concat_ws(":", F.col("pair").cast("string"), F.col("y").cast("string"))), named, "__y", ["place"])
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    spread_ = placed.select("pair", "x", "n", "place", levels)
    bit = F.expr("shiftright(place, level) & 1")
    node = F.expr(f"((pair * {1 << LEVEL_BITS} + level) * {1 << 40}) + shiftright(place, level + 1)")
    laid = spread_.select(
        node.cast("long").alias("key"), "x", (1 - bit).cast("int").alias("side"), "place", F.when(bit == 1, 0).otherwise(-1).cast("int").alias("slot"),
        F.when(bit == 1, F.lit(0.0)).otherwise(F.col("n")).alias("left"), "n",
    )
    # Rows that go right come before those of the same x that go left: only smaller x count.
    met = keyed_totals(laid, ["x", "side", "place"], ["left"], ["n"])
    pair = F.expr(f"key div {1 << (40 + LEVEL_BITS)}")
    rising = {r["pair"]: r["r"] for r in met.groupBy(pair.alias("pair")).agg(F.sum(F.col("n") * F.col("left")).alias("r")).collect()}
    out = []
    for i in range(len(pairs)):
        if i not in sizes or sizes[i]["n"] < 2:
            out.append(None)
            continue
        n = sizes[i]["n"]
        all_, x, y = n * (n - 1) / 2, ties["x"][i], ties["y"][i]
        signed = 2 * (rising.get(i) or 0.0) - (all_ - x - y + sizes[i]["xy"])
        scale = math.sqrt((all_ - x) * (all_ - y))
        out.append(signed / scale if scale else None)
    return out


def kendall(df: DataFrame, x: str, y: str) -> float | None:
    """Tau-b of two columns over their complete rows."""
    return _kendalls(df, [(x, y)])[0]


def corr_kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix, all pairs of columns in one pass."""
    pairs = _pairs(df, columns)
    return _matrix(df, columns, [(x, y, t) for (x, y), t in zip(pairs, _kendalls(df, pairs))])


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    methods = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}
    if method not in methods:
        raise TableError(f"unknown correlation method {method!r}")
    return methods[method](df, columns)


def top_correlations(matrix: DataFrame) -> DataFrame:
    """`(kind, x, y, corr)`: the strongest positive and negative pair of the upper triangle."""
    upper = matrix.filter((F.col("x") < F.col("y")) & F.col("corr").isNotNull())
    pick = F.struct("x", "y", "corr")
    one = upper.agg(
        F.max_by(pick, F.struct("corr", "x", "y")).alias("hi"), F.min_by(pick, F.struct("corr", "x", "y")).alias("lo")
    )
    items = [
        F.struct(F.lit(kind).alias("kind"), *[F.col(f"{c}.{f}").alias(f) for f in ("x", "y", "corr")])
        for kind, c in (("strongest_positive", "hi"), ("strongest_negative", "lo"))
    ]
    return one.select(F.inline(F.array(*items)))


def labelled(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("strength", corr_strength(F.col("corr")))
