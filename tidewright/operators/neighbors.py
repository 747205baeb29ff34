"""Exact nearest neighbours by pivots, without a join of all pairs.

Rows are filed in the cell of the nearest pivot. A query first meets one part of its own cell, which bounds how far its
neighbours can be; after that it meets only cells that can hold a nearer row by the triangle inequality. Cells that lie side by
side are bundled into blocks, so a query is copied once per block and not once per cell. Both times a task compares bounded
blocks in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from ..functions.hashing import row_hash
from ..schema import q
from ..session import durable
from .lookup import lookup_join

BLOCK_ROWS = 20_000  # rows or queries of a cell that are compared at once
MOST_PIVOTS = 1_024
SAMPLE = 8  # sampled rows per pivot
CHUNK = 256
ROUTED = 16  # points whose distances to all pivots are held at once
SENT = 1 << 15  # copies of queries that are held at once
MEASURED = 32  # candidates that are measured without looking for the nearest of them
SLACK = 1e-9


def _spread_pivots(points: np.ndarray, wanted: int) -> np.ndarray:
    """Means of `wanted` clusters of the sample, in random order; fewer if it holds fewer different rows."""
    rng = np.random.default_rng(42)
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:wanted]]
    for _ in range(5):
        near = np.concatenate([_distances(points[i : i + CHUNK], centres).argmin(axis=1) for i in range(0, len(points), CHUNK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of `a` to all rows of `b`, to rounding."""
    square = np.sum(a * a, axis=1)[:, None] + np.sum(b * b, axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _closest(base: np.ndarray, ids: np.ndarray, point: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances of the candidates in `near`, the k best by distance and id."""
    exact = np.sqrt(np.sum(np.square(base[near] - point), axis=1))
    best = np.lexsort((ids[near], exact))[:k]
    return near[best], exact[best]


@dataclass
class Cells:
    """What is known of the cells: at a level the first 2^level pivots are used.

    `radius[level, p]` bounds the distance of the rows of any group in the cell to its pivot. `bundle[level, p]` numbers the bundle of cells that are
    kept together, and `blocks[level, p]` is the number of parts that its rows are cut into, by the largest group; a cell of several parts is a bundle alone.
    """

    pivots: np.ndarray
    radius: np.ndarray
    bundle: np.ndarray
    blocks: np.ndarray
    between: np.ndarray  # distances of the pivots

    def reached(self, points: np.ndarray, own: np.ndarray, level: int, limits: np.ndarray, among: np.ndarray) -> np.ndarray:
        """For points in the cells `own`, which of the cells `among` can hold a row within the limit of the point.

        The rows of a cell lie within its radius, and nearer to its pivot than to the one the point is nearest to.
        """
        out = np.empty((len(points), len(among)), dtype=bool)
        centres, radius = self.pivots[among], self.radius[level, among]
        for at in range(0, len(points), ROUTED):
            x, mine, limit = points[at : at + ROUTED], own[at : at + ROUTED], limits[at : at + ROUTED, None]
            away = np.sqrt(np.sum(np.square(x[:, None, :] - centres[None, :, :]), axis=2))
            near = np.sqrt(np.sum(np.square(x - self.pivots[mine]), axis=1))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (away * away - near * near) / (2 * self.between[mine][:, among])
            beyond[mine[:, None] == among[None, :]] = 0.0
            most = limit + SLACK * (away + 1)
            out[at : at + ROUTED] = (radius >= 0) & (away - radius <= most) & ~(beyond > most)
        return out


def _side_by_side(points: np.ndarray) -> np.ndarray:
    """Numbers of the points so that near ones follow each other: halved along the widest axis again and again."""

    def halved(taken: np.ndarray) -> list[np.ndarray]:
        if len(taken) < 3:
            return [taken]
        axis = np.ptp(points[taken], axis=0).argmax()
        taken = taken[np.argsort(points[taken, axis], kind="stable")]
        return halved(taken[: len(taken) // 2]) + halved(taken[len(taken) // 2 :])

    return np.concatenate(halved(np.arange(len(points))))


def _bundled(counts: np.ndarray, orders: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per level and pivot the number of a bundle of cells that hold at most `most` rows together, and the parts of a cell that holds more."""
    bundle = np.zeros_like(counts)
    for level, order in enumerate(orders):
        number = filled = 0
        for p in order:
            if filled and filled + counts[level, p] > most:
                number, filled = number + 1, 0
            bundle[level, p] = number
            filled += counts[level, p]
    return bundle, np.maximum(1, -(-counts // most))


def _dealt(rows: DataFrame, bundle: Broadcast, bundle_name: str, part_name: str) -> DataFrame:
    """Add the bundle of the row's cell, and by its `hash` the part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, blocks = bundle.value
        for batch in batches:
            level, p, hashed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "p", "hash"))
            part = np.mod(hashed, blocks[level, p]).astype(np.int32)
            named = [*batch.schema.names, bundle_name, part_name]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bundles[level, p].astype(np.int32)), pa.array(part)], names=named)

    added = [T.StructField(bundle_name, T.IntegerType()), T.StructField(part_name, T.IntegerType())]
    return rows.mapInArrow(deal, T.StructType([*rows.schema.fields, *added]))


def _placed(rows: DataFrame, pivots: Broadcast) -> DataFrame:
    """Add `p`, the nearest of the pivots of the row's level, and `away`, the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, levels = _stack(batch.column("x")), batch.column("level").to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for level in np.unique(levels):
                for rows_ in np.array_split(np.flatnonzero(levels == level), max(1, np.count_nonzero(levels == level) // CHUNK)):
                    found = _distances(x[rows_], centres[: 1 << level]).argmin(axis=1)
                    cell[rows_] = found
                    away[rows_] = np.sqrt(np.sum(np.square(x[rows_] - centres[found]), axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "p", "away"])

    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return rows.mapInArrow(place, schema)


VISIT = ["g", "b", "part", "lane", "sublane"]


def _compared(asked: DataFrame, rows: DataFrame, k: int, kind: T.DataType, cells: Broadcast) -> DataFrame:
    """`(rep, neighbor, distance)`: the k best of each bundle part for the queries `rep, g, level, p, seen, x, limit, b, part, lane, sublane` sent there.

    Queries without a part `seen` meet the rows of their own cell; the others meet the cells within their limit, without what they have seen.
    Queries of near cells share a lane, and a part goes to the lanes that ask for it.
    """
    visits = asked.select(*[F.col(c).alias(f"to_{c}") for c in VISIT]).distinct()
    met_at = [F.col(c) == F.col(f"to_{c}") for c in VISIT[:3]]
    right = rows.join(visits, met_at).select(*[f"to_{c}" for c in VISIT], "id", F.col("p").alias("cell"), F.col("x").alias("vector"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["rep", "neighbor", "distance"], dtype=object)
        known, part = cells.value, int(b["to_part"].iat[0])
        b = b.iloc[np.argsort(b["cell"].to_numpy(), kind="stable")]
        held, begin = np.unique(b["cell"].to_numpy(), return_index=True)
        end = np.append(begin[1:], len(b))
        a = a.assign(seen=a["seen"].fillna(-1).astype(int)).sort_values(["p", "seen"], kind="stable")
        points, every = np.stack(a["x"].to_numpy()), np.stack(b["vector"].to_numpy())
        names, asked_, limits = b["id"].to_numpy(), a["rep"].to_numpy(), a["limit"].to_numpy()
        own, seen, level = a["p"].to_numpy(), a["seen"].to_numpy(), int(a["level"].iat[0])
        cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(seen) != 0)) + 1
        out: list[tuple] = []
        for first, last in zip(np.append(0, cuts), np.append(cuts, len(points))):
            for start in range(first, last, CHUNK):
                stop = min(start + CHUNK, last)
                block, limit = points[start:stop], limits[start:stop]
                if seen[start] < 0:
                    met = held == own[start]
                else:
                    met = known.reached(block, own[start:stop], level, limit, held).any(axis=0)
                    met &= (held != own[start]) | (seen[start] != part)
                if not met.any():
                    continue
                taken = slice(None) if met.all() else np.concatenate([np.arange(f, t) for f, t in zip(begin[met], end[met])])
                base, ids = every[taken], names[taken]
                squares = np.sum(base * base, axis=1)
                own_squares = np.sum(block * block, axis=1)[:, None]
                rough = block @ base.T
                rough *= -2
                rough += own_squares
                rough += squares
                # The rough form loses digits, so everything near the edge is measured exactly.
                edge = np.square(limit) + SLACK * (own_squares[:, 0] + squares.max() + 1)
                for i in range(len(block)):
                    near = np.flatnonzero(rough[i] <= edge[i])
                    if len(near) > MEASURED + k:
                        best = np.partition(rough[i, near], k - 1)[k - 1]
                        near = near[rough[i, near] <= best + SLACK * (own_squares[i, 0] + squares.max() + 1)]
                    found, exact = _closest(base, ids, block[i], near, k)
                    out += [(asked_[start + i], ids[j], d) for j, d in zip(found, exact) if d <= limit[i]]
        return pd.DataFrame(out, columns=["rep", "neighbor", "distance"])

    schema = T.StructType([T.StructField("rep", T.StringType()), T.StructField("neighbor", kind), T.StructField("distance", T.DoubleType())])
    return asked.groupBy(*VISIT).cogroup(right.groupBy(*[f"to_{c}" for c in VISIT])).applyInPandas(compare, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("rep").orderBy("distance", "neighbor"))
    return found.withColumn("position", rank).filter(F.col("position") <= k)


def border_routes(asked: DataFrame, cells: Broadcast) -> DataFrame:
    """The bundle parts that queries `rep, g, level, x, p, seen, limit, lane, sublane` still have to see.

    Few queries are sent out at a time, so a task holds a bounded number of copies of them.
    """
    kinds = asked.schema
    schema = T.StructType([*kinds, T.StructField("b", T.IntegerType()), T.StructField("part", T.IntegerType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        for batch in batches:
            if not batch.num_rows:
                continue
            levels = batch.column("level").to_numpy(zero_copy_only=False)
            for level in np.unique(levels):
                among = np.flatnonzero(known.radius[level, : 1 << level] >= 0)
                among = among[np.argsort(known.bundle[level, among], kind="stable")]
                bundles, begin = np.unique(known.bundle[level, among], return_index=True)
                parts = known.blocks[level, among[begin]]
                step = max(ROUTED, SENT // int(parts.sum()))
                of_level = np.flatnonzero(levels == level)
                for at in range(0, len(of_level), step):
                    some = batch.take(pa.array(of_level[at : at + step]))
                    own, seen, limit = (some.column(c).to_numpy(zero_copy_only=False) for c in ("p", "seen", "limit"))
                    open_ = known.reached(_stack(some.column("x")), own, int(level), limit, among)
                    open_ &= (among[None, :] != own[:, None]) | (known.blocks[level, own] > 1)[:, None]
                    query, bundle = np.nonzero(np.logical_or.reduceat(open_, begin, axis=1))
                    times = parts[bundle]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    query, bundle = np.repeat(query, times), np.repeat(bundle, times)
                    # A cell of several parts is alone in its bundle.
                    left = (parts[bundle] == 1) | (known.bundle[level, own[query]] != bundles[bundle]) | (part != seen[query])
                    sent = some.take(pa.array(query[left]))
                    added = [pa.array(bundles[bundle[left]].astype(np.int32)), pa.array(part[left].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*sent.columns, *added], names=schema.names)

    return asked.mapInArrow(route, schema)


def nearest(
    train: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, exclude_self: bool = False,
    by: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`(query, neighbor, distance, position)` of the k closest rows (of the same `by`, if given).

    Vectors are arrays of numbers of one length; rows without one take no part. Ties go to the smaller key, and keys are unique in `train`.
    Equal query vectors are searched once, and of equal rows only the few with the smallest keys are compared.
    """
    spark, kind = train.sparkSession, train.schema[key].dataType
    wanted = k + 1 if exclude_self else k
    group = F.coalesce(F.concat(F.lit("="), q(by).cast("string")), F.lit("")) if by else F.lit("")

    def plain(df: DataFrame) -> DataFrame:
        chosen = df.select(q(key).alias("id"), q(vector).cast("array<double>").alias("x"), group.alias("g")).filter("x is not null")
        return chosen.withColumn("rep", F.sha2(F.concat_ws(",", "g", F.col("x").cast("array<string>")), 256))

    # Of equal rows no more than `wanted` can be among the nearest: Spark drops the others before they are shuffled.
    least = F.row_number().over(W.partitionBy("rep").orderBy("id"))
    rows = durable(plain(train).withColumn("__r", least).filter(F.col("__r") <= wanted).drop("__r", "rep"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0]
    schema = T.StructType(
        [T.StructField("query", queries.schema[key].dataType), T.StructField("neighbor", kind), T.StructField("distance", T.DoubleType()), T.StructField("position", T.IntegerType())]
    )
    if not most:
        return spark.createDataFrame([], schema)
    top = max(0, math.floor(math.log2(min(MOST_PIVOTS, math.sqrt(most)))))
    # At most SAMPLE * MOST_PIVOTS rows.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE << top).select("x").toArrow().column("x").combine_chunks()
    pivots = _spread_pivots(_stack(sample), 1 << top)
    top = min(top, len(pivots).bit_length() - 1)
    centres = spark.sparkContext.broadcast(pivots)

    # A group uses about as many pivots as the root of its size.
    level = F.least(F.lit(top), F.floor(F.log2(F.sqrt(F.col("n").cast("double"))))).cast("int").alias("level")
    levels = sizes.select("g", level)

    def levelled(df: DataFrame) -> DataFrame:
        if by is None:
            return df.withColumn("level", F.lit(top))
        return lookup_join(df, levels, "g", ["level"], map_key="g").filter("level is not null")

    def counted(placed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the largest group, and how far its rows are: a row per level and pivot."""
        held = placed.groupBy("level", "g", "p").agg(F.count("*").alias("n"), F.max("away").alias("r"))
        counts, radius = np.zeros((top + 1, len(pivots)), dtype=np.int64), np.full((top + 1, len(pivots)), -1.0)
        for r in held.groupBy("level", "p").agg(F.max("n").alias("n"), F.max("r").alias("r")).collect():
            counts[r["level"], r["p"]], radius[r["level"], r["p"]] = r["n"], r["r"]
        return counts, radius

    orders = [_side_by_side(pivots[: 1 << level_]) for level_ in range(top + 1)]
    placed = durable(_placed(levelled(rows), centres))
    counts, radius = counted(placed)
    bundle, blocks = _bundled(counts, orders, block_rows)
    cells = spark.sparkContext.broadcast(Cells(pivots, radius * (1 + SLACK), bundle, blocks, _distances(pivots, pivots)))
    by_rows = spark.sparkContext.broadcast((bundle, blocks))
    filed = _dealt(placed.withColumn("hash", F.xxhash64("id")), by_rows, "b", "part").select("id", "g", "b", "part", "p", "x")

    asked = plain(queries)
    unique = levelled(asked.groupBy("rep").agg(F.first("g").alias("g"), F.first("x").alias("x")))
    unique = durable(_placed(unique, centres).withColumn("hash", F.xxhash64("rep")))
    by_queries = spark.sparkContext.broadcast(_bundled(counted(unique)[0], orders, BLOCK_ROWS))
    unique = _dealt(_dealt(unique, by_rows, "b", "part"), by_queries, "lane", "sublane").drop("away", "hash")
    begun = unique.withColumns({"limit": F.lit(float("inf")), "seen": F.lit(None).cast("int")})
    first = durable(_compared(begun, filed, wanted, kind, cells))
    limits = first.groupBy("rep").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    limit = F.when(F.col("n") >= wanted, F.col("far")).otherwise(F.lit(float("inf")))
    bound = unique.withColumnRenamed("part", "seen").drop("b").join(limits, "rep", "left").withColumn("limit", limit).drop("n", "far")
    second = _compared(border_routes(bound, cells), filed, wanted, kind, cells)
    best = _best(first.unionByName(second), wanted)
    listed = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("found"))
    answered = lookup_join(asked.select("id", "rep"), listed, "rep", ["found"], map_key="rep").filter("found is not null")
    others = F.filter("found", lambda n: n["neighbor"] != F.col("id")) if exclude_self else F.col("found")
    cut = answered.select(F.col("id").alias("query"), F.posexplode(F.slice(others, 1, k)).alias("__at", "__n"))
    return cut.select("query", F.col("__n.neighbor").alias("neighbor"), F.col("__n.distance").alias("distance"), (F.col("__at") + 1).alias("position"))


def knn_classify(
    train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5, exclude_self: bool = False
) -> DataFrame:
    """`(key, prediction, confidence)` by majority of the k nearest, the smallest label on ties."""
    found = nearest(train, queries, key, vector, k, exclude_self)
    labels = train.select(q(key).alias("neighbor"), q(label).alias("label"))
    votes = found.join(labels, "neighbor").groupBy("query", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query").agg(
        F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction"),
        (F.max("votes") / F.sum("votes")).alias("confidence"),
    )
    return best.withColumnRenamed("query", key)


def knn_regress(
    train: DataFrame, queries: DataFrame, key: str, vector: str, target: str, k: int = 5, exclude_self: bool = False
) -> DataFrame:
    """`(key, prediction)` as the mean target of the k nearest."""
    found = nearest(train, queries, key, vector, k, exclude_self)
    targets = train.select(q(key).alias("neighbor"), q(target).cast("double").alias("y"))
    return found.join(targets, "neighbor").groupBy(F.col("query").alias(key)).agg(F.avg("y").alias("prediction"))


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows that bring every class up to the largest one: `(label, vector)`.

    A synthetic row lies between a row and one of its k nearest rows of the same class. A
    class of a single row has no neighbour and stays as it is.
    """
    sizes = {r["c"]: r["n"] for r in df.groupBy(q(label).alias("c")).agg(F.count("*").alias("n")).collect()}
    most = max(sizes.values())
    small = {c: n for c, n in sizes.items() if 1 < n < most}
    schema = T.StructType(
        [T.StructField("__c", df.schema[label].dataType), T.StructField("__n", T.LongType()), T.StructField("__need", T.LongType())]
    )
    needs = df.sparkSession.createDataFrame([(c, n, most - n) for c, n in small.items()], schema)
    minority = df.join(F.broadcast(needs), q(label) == F.col("__c")).select(q(key), q(vector), q(label), "__n", "__need")
    found = nearest(minority, minority, key, vector, k, True, label)

    # Each row founds need // n rows, and the rows with the smallest hashes one more.
    from .sampling import _class_rank

    ranked = _class_rank(minority, label, key, seed)
    copies = F.floor(F.col("__need") / F.col("__n")) + F.when(F.col("__rank") < F.col("__need") % F.col("__n"), 1).otherwise(0)
    base = ranked.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array())))
    near = found.groupBy("query").agg(F.count("*").alias("__found"))
    drawn = base.join(near, q(key) == F.col("query")).drop("query").withColumn(
        "__pick", (F.pmod(row_hash(q(key), F.col("__copy"), seed=seed), F.col("__found")) + 1).cast("int")
    )
    other = found.select(F.col("query").alias("__q"), F.col("neighbor").alias("__o"), F.col("position").alias("__p"))
    paired = drawn.join(other, (q(key) == F.col("__q")) & (F.col("__pick") == F.col("__p")))
    ends = minority.select(q(key).alias("__ok"), q(vector).alias("__ov"))
    gap = F.pmod(row_hash(q(key), F.col("__copy"), seed=seed + 1), F.lit(1_000_000)) / 1_000_000
    mixed = F.zip_with(q(vector).cast("array<double>"), F.col("__ov").cast("array<double>"), lambda a, b: a + (b - a) * F.col("__gap"))
    return (
        paired.join(ends, F.col("__o") == F.col("__ok"))
        .withColumn("__gap", gap)
        .select(q(label), mixed.alias(vector))
    )
