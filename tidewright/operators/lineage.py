"""Dependencies between transformations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import durable
from .lookup import BROADCAST_BYTES, lookup_join, measure

MAX_DEPTH = 10
LEVELS_PER_CUT = 4
ROOTS = 2_048  # roots that are followed at once
WALKED = 1 << 21  # ids that they may lead to together
GRAPH_ROWS = 1 << 20  # of a graph that goes to the roots
PEELED = 8  # steps that may be joined before
SHRUNK = 0.75  # share of the ids that may be met after one step more, for that to be worth it
KNOWN, END, ASKED, TAGS = 0, 1, 2, 3


def lineage_upsert(existing: DataFrame, new: DataFrame, key: str = "transformation_id", seq: str = "seq") -> DataFrame:
    """Insert or replace by id: the row with the highest sequence number stays.

    An aggregate rather than a window, so rows of one id are combined before the shuffle.
    """
    both = existing.unionByName(new)
    kept = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(seq)).alias("r"))
    return kept.select("r.*")


def edge_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore `(parent_id, child_id)`: the first time of an edge stays."""
    both = existing.unionByName(new)
    return both.groupBy("parent_id", "child_id").agg(F.min("created_at").alias("created_at"))


class _Graph:
    """Links of a graph small enough to be everywhere: numbered ids, and the numbers that each leads to."""

    def __init__(self, links: pa.Table):
        lists = links.column("next").combine_chunks()
        held = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        to = lists.flatten()
        kept = to.is_valid().to_numpy(zero_copy_only=False)
        values = links.column("value").to_pandas()
        codes, ids = pd.factorize(pd.concat([values, to.drop_null().to_pandas()], ignore_index=True))
        self.ids, self.kind = pd.Index(ids), lists.type.value_type
        start, to_code = codes[: len(values)][held[kept]], codes[len(values) :]
        order = np.lexsort((to_code, start))
        self.to = to_code[order]
        self.begin = np.searchsorted(start[order], np.arange(len(self.ids) + 1))
        self.known = np.zeros(len(self.ids), dtype=bool)
        self.known[codes[: len(values)]] = True

    def walk(
        self, place: np.ndarray, node: np.ndarray, level: np.ndarray, max_depth: int | None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`(place, number of the id, nearest level)` of all that lies ahead of numbered ids met at a level; few places at a time where they lead far."""
        size, last = len(self.ids), level.max(initial=-1)
        starts = place * size + node
        seen, found = np.zeros(0, dtype=np.int64), []
        ahead, depth = np.zeros(0, dtype=np.int64), 0
        while depth <= last or len(ahead):
            keys = np.unique(np.concatenate([ahead, starts[level == depth]]))
            if len(seen):
                at = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
                keys = keys[seen[at] != keys]
            if len(seen) + len(keys) > WALKED and place.min() < place.max():
                half = (place.min() + place.max()) // 2
                for side in (place <= half, place > half):
                    yield from self.walk(place[side], node[side], level[side], max_depth)
                return
            seen = np.sort(np.concatenate([seen, keys]), kind="stable")
            at_place, at_node = keys // size, keys % size
            found.append((at_place, at_node, np.full(len(keys), depth, dtype=np.int32)))
            if max_depth is not None and depth >= max_depth:
                break
            count = self.begin[at_node + 1] - self.begin[at_node]
            first = np.repeat(self.begin[at_node] - np.cumsum(count) + count, count)
            ahead = np.repeat(at_place, count) * size + self.to[first + np.arange(len(first))]
            depth += 1
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found))


def _by_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come in the order of their first column, all rows of a root in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        roots = batch.column(0)
        if held and roots[0] != held[-1].column(0)[-1]:
            yield pa.Table.from_batches(held)
            held = []
        same = pc.equal(roots, roots[len(roots) - 1]).to_numpy(zero_copy_only=False)
        cut = len(roots) - int(same.sum())
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _walked(graph: _Graph, met: DataFrame, max_depth: int | None, kind: T.DataType, asked: bool) -> DataFrame:
    """What `_reach` returns, from rows `(root, nodes, tags)` that lie together and in order of their root.

    Tags are `KNOWN`, `END` or `ASKED`, plus `TAGS` times the level. `KNOWN` ids have links that are followed already, an `END` is followed in
    the graph or has no links. With `asked` the rows returned are those that were asked for, their `left` telling whether the root leads there.
    """
    shared = met.sparkSession.sparkContext.broadcast(graph)
    schema = T.StructType(
        [met.schema["root"], T.StructField("node", kind), T.StructField("level", T.IntegerType()), T.StructField("left", T.IntegerType())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        out = np.diff(g.begin)
        for table in _by_root(batches):
            roots = table.column(0).combine_chunks()
            step = np.ones(len(roots), dtype=bool)
            step[1:] = pc.not_equal(roots[1:], roots[:-1]).to_numpy(zero_copy_only=False)
            begins = np.append(np.flatnonzero(step), len(roots))
            for at in range(0, len(begins) - 1, ROOTS):
                own = begins[at : at + ROOTS + 1]
                yield from follow(g, out, table.slice(own[0], own[-1] - own[0]), np.diff(own))

    def follow(g: _Graph, out: np.ndarray, table: pa.Table, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        roots = table.column(0).combine_chunks().take(pa.array(np.cumsum(rows) - rows))
        lists = table.column(1).combine_chunks()
        place = np.repeat(np.repeat(np.arange(len(rows)), rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tag, level = (x.astype(np.int64) for x in np.divmod(table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False), TAGS)[::-1])
        values = lists.flatten()
        node = g.ids.get_indexer(values.to_pandas())
        size, beyond = len(g.ids), np.flatnonzero(node < 0)
        other, others = pd.factorize(values.take(pa.array(beyond)).to_pandas())
        node[beyond] = size + other
        ids, span = pa.concat_arrays([pa.array(g.ids, type=g.kind), pa.array(others, type=g.kind)]), size + len(others)
        wanted = np.flatnonzero(tag == ASKED)
        wanted = wanted[np.unique(place[wanted] * span + node[wanted], return_index=True)[1]]
        hit, keys = np.zeros(len(wanted), dtype=bool), place[wanted] * span + node[wanted]

        def told(p: np.ndarray, n: np.ndarray, depth: np.ndarray, left: pa.Array) -> Iterator[pa.RecordBatch]:
            if asked:
                np.logical_or(hit, np.isin(keys, p * span + n), out=hit)
            else:
                yield pa.RecordBatch.from_arrays([roots.take(pa.array(p)), ids.take(pa.array(n)), pa.array(depth.astype(np.int32)), left], names=schema.names)

        far = np.flatnonzero((node >= size) & (tag != ASKED))
        far = far[np.lexsort((level[far], place[far] * span + node[far]))]
        once = np.ones(len(far), dtype=bool)
        once[1:] = (place[far][1:] != place[far][:-1]) | (node[far][1:] != node[far][:-1])
        far = far[once]
        yield from told(place[far], node[far], level[far], pa.array(np.zeros(len(far), dtype=np.int32), mask=tag[far] != KNOWN))
        near = np.flatnonzero((node < size) & (tag != ASKED))
        for p, n, depth in g.walk(place[near], node[near], level[near], max_depth):
            yield from told(p, n, depth, pa.array(out[n].astype(np.int32), mask=~g.known[n]))
        if asked:
            depth = pa.nulls(len(wanted), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [roots.take(pa.array(place[wanted])), ids.take(pa.array(node[wanted])), depth, pa.array(hit.astype(np.int32))], names=schema.names
            )

    return met.mapInArrow(walk, schema)


def _core(links: DataFrame, rows: int, max_depth: int | None, graph_rows: int) -> list[DataFrame] | None:
    """Links of the ids that can be met after 0, 1, 2 ... steps from anywhere, up to the first that fit a broadcast; none if they stay many.

    Whatever is met after n steps leads only to what is met after n steps too, so the last links are all that is needed from there on.
    """
    inner = [links]
    while len(inner) <= (PEELED if max_depth is None else min(PEELED, max_depth)):
        met = inner[-1].select(F.explode("next").alias("value")).distinct()
        inner.append(durable(inner[-1].join(met, "value", "left_semi")))
        before, (rows, width) = rows, measure(inner[-1])
        if rows <= graph_rows and width <= BROADCAST_BYTES:
            return inner
        if rows > SHRUNK * before:
            break
    return None


def _around(inner: list[DataFrame], starts: DataFrame) -> DataFrame:
    """`(root, own, k1, e1, k2, ...)`: what each root meets up to where the last links hold, a row for each of its links.

    From the inside out, ids get what their links lead to, as lists of ids by level: `k1`, `k2`, ... have links that are followed, from `e1`, `e2`, ... the
    walk goes on. Ids that come twice on a level stay once. Fewer and fewer ids are met after more steps, so that the last join is by far the largest.
    """
    take = inner[0].schema["next"].dataType.simpleString()
    none = F.array().cast(take)
    around = inner[-2].select("value", F.col("next").alias("e1"))

    def joined(links: DataFrame, *by: str) -> DataFrame:
        further = [F.col(c).alias(f"{c[0]}{int(c[1:]) + 1}") for c in around.columns[1:]]
        near = around.select(F.col("value").alias("__to"), F.lit(True).alias("__linked"), *further)
        one = F.array("__to").cast(take)
        linked = links.select(*by, F.explode_outer("next").alias("__to")).join(near, "__to", "left")
        first = [F.when(F.col("__linked"), one).otherwise(none).alias("k1"), F.when(F.col("__linked").isNull() & F.col("__to").isNotNull(), one).otherwise(none).alias("e1")]
        return linked.select(*by, *first, *[F.coalesce(c, none).alias(c) for c in near.columns[2:]])

    for links in reversed(inner[1:-2]):
        parts = joined(links, "value")
        around = parts.groupBy("value").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in parts.columns[1:]])
    own = F.when(F.col("next").isNotNull(), KNOWN).otherwise(END).alias("own")
    held = starts.join(inner[0].withColumnRenamed("value", "root"), "root", "left").select("root", own, "next")
    if len(inner) == 2:
        return held.select("root", "own", F.coalesce("next", none).alias("e1"))
    return joined(held, "root", "own")


def _tagged(parts: DataFrame, kind: T.DataType) -> DataFrame:
    """`(root, nodes, tags)` of rows of `_around`, and of rows with an id in `asked`."""
    take = T.ArrayType(kind).simpleString()
    lists = [(F.coalesce(c, F.array().cast(take)), (KNOWN if c[0] == "k" else END) + TAGS * int(c[1:])) for c in parts.columns if c[0] in "ke"]
    if "asked" in parts.columns:
        lists.append((F.when(F.col("asked").isNotNull(), F.array("asked")).otherwise(F.array().cast(take)), ASKED))
    nodes = F.concat(F.array(F.col("root").cast(kind)), *[ids for ids, _ in lists])
    tags = F.concat(F.array("own"), *[F.array_repeat(F.lit(tag), F.size(ids)) for ids, tag in lists])
    return parts.select("root", nodes.alias("nodes"), tags.alias("tags"))


def _reach(
    links: DataFrame,
    roots: DataFrame,
    max_depth: int | None,
    levels_per_cut: int = LEVELS_PER_CUT,
    graph_rows: int = GRAPH_ROWS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """`(root, node, level, left)` of all that each `root` leads to over `links` (`value`, `next`: an array of ids), the root at level 0.

    `left` is the number of links of a node at `max_depth`, missing where the node has no row in `links`. With `asked`, pairs `(root, node)` whose roots are
    `roots`, the different pairs of it are returned instead, with `left` 1 where the root leads to the node and else 0.

    A graph whose measured rows and bytes are within the limits of a broadcast goes to the roots, which are followed where they are. Of a larger graph,
    that goes there which can be met after a few steps from anywhere, if that is within the limits: only the steps before are joined, and a root comes
    together with what it met once. Otherwise all levels are joined, several in one job: within it a node
    may be met again, and the nearest level is kept when the reached nodes are written.
    """
    starts = roots.select("root").distinct()
    kind = links.schema["value"].dataType
    rows, width = measure(links)
    fits = rows <= graph_rows and width <= BROADCAST_BYTES
    held = F.array_distinct(F.filter(F.coalesce("next", F.array()), lambda n: n.isNotNull()))
    inner = [links] if fits else _core(links.filter("value is not null").select("value", held.alias("next")), rows, max_depth, graph_rows)
    if inner:
        graph = _Graph(inner[-1].toArrow())
        alone = starts.filter("root is not null")
        parts = alone.withColumn("own", F.lit(END)) if fits else _around(inner, alone)
        if asked is not None:
            whole = asked.filter("root is not null and node is not null")
            pairs = whole.select("root", F.lit(END).alias("own"), F.col("node").cast(kind).alias("asked"))
            parts = pairs if fits else parts.unionByName(pairs, allowMissingColumns=True)
        if asked is not None or not fits:
            parts = parts.repartition("root").sortWithinPartitions("root")
        found = _walked(graph, _tagged(parts, kind), max_depth, kind, asked is not None)
        if asked is None:
            return found
        gaps = asked.filter("root is null or node is null").select("root", F.col("node").cast(kind).alias("node")).distinct()
        return found.unionByName(gaps.select("root", "node", F.lit(None).cast("int").alias("level"), F.lit(0).alias("left")))
    reached = durable(starts.select("root", F.col("root").alias("node")).withColumn("level", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        steps = levels_per_cut if max_depth is None else min(levels_per_cut, max_depth - depth)
        level = reached.filter(F.col("level") == depth) if depth else reached
        found = reached
        for step in range(1, steps + 1):
            linked = lookup_join(level.select("root", "node"), links, "node", ["next"], measured=(rows, width))
            level = linked.select("root", F.explode("next").alias("node")).filter("node is not null").distinct().withColumn("level", F.lit(depth + step))
            found = found.unionByName(level)
        reached = durable(found.groupBy("root", "node").agg(F.min("level").alias("level")))
        depth += steps
        if reached.filter(F.col("level") == depth).isEmpty():
            break
    if asked is not None:
        hits = reached.select("root", "node", F.lit(1).alias("left"))
        return asked.distinct().join(hits, ["root", "node"], "left").select("root", "node", F.lit(None).cast("int").alias("level"), F.coalesce("left", F.lit(0)).alias("left"))
    counts = links.select("value", F.size(held).alias("left"))
    return lookup_join(reached, counts, "node", ["left"])


def lineage_chain(transformations: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """`(root, transformation_id, level, cut)` of everything each root depends on, at its nearest level.

    `transformations` is `(transformation_id, dependencies)` with one row per id and an array of ids, `roots` has one column `root`. Ids that
    are no transformation end the chain. `cut` marks rows at `max_depth` that have dependencies left.
    """
    nodes = transformations.select(F.col("transformation_id").alias("value"), F.col("dependencies").alias("next"))
    met = _reach(nodes, roots, max_depth, graph_rows=graph_rows).filter("left is not null")
    left = (F.col("level") == max_depth) & (F.col("left") > 0)
    return met.select("root", F.col("node").alias("transformation_id"), "level", left.alias("cut"))


def lineage_cycle_check(edges: DataFrame, candidates: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """`(parent_id, child_id, creates_cycle)`: would the edge let the child reach its parent?

    Ancestors of each distinct parent are followed to the end, candidates with one parent together. Nodes have few parents and many children,
    so this is the short way round.
    """
    links = durable(edges.groupBy(F.col("child_id").alias("value")).agg(F.collect_set("parent_id").alias("next")))
    asked = candidates.select(F.col("parent_id").alias("root"), F.col("child_id").alias("node"))
    found = _reach(links, asked, None, graph_rows=graph_rows, asked=asked)
    child = F.col("node").cast(candidates.schema["child_id"].dataType)
    return found.select(F.col("root").alias("parent_id"), child.alias("child_id"), (F.col("left") > 0).alias("creates_cycle"))


def transform_history(operations: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Per dataset: operations, distinct methods, columns touched and an order-free content hash.

    The operations themselves stay rows; only distinct column names are gathered.
    """
    line = F.concat_ws("|", "method", "column", F.col("seq").cast("string"))
    hashed = F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("decimal(20,0)")
    return operations.groupBy(by).agg(
        F.count("*").alias("operations"),
        F.count_distinct("method").alias("methods"),
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns_modified"),
        F.sum(hashed).cast("string").alias("history_hash"),
    )
