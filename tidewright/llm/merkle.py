"""A Merkle manifest of a table: one tree per source, and one over the sources.

Nodes are numbered within their tree, so the parent and the slot of a node are its number divided by the fanout.
Conditional aggregates spread the children of each parent into one column per slot: all columns together are what the
parent hashes, all but a child's own column are its siblings. A group never has more rows than the fanout, whatever the
size of a source. The siblings above a parent are worked out once per parent, from the root down, and
handed to its children; leaves get theirs last, when only hashes are left to be written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lookup import lookup_join
from ..operators.ranking import global_index
from ..schema import q
from ..session import durable
from .common import crc32_sql, query, read

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sealed(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of values read alike; a missing one is `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[sealed(v) for v in values]), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _joined(columns: Sequence[Column]) -> Column:
    """Digests next to each other; columns without a child add nothing."""
    none = F.unhex(F.lit(""))
    return F.concat(*[F.coalesce(c, none) for c in columns]) if columns else none


def _pivot(nodes: DataFrame, fanout: int, carried: Sequence[str]) -> DataFrame:
    """One row per parent: `tree, idx, n` of the parent and `c0, c1, ...`, the children with `carried` columns."""
    slot = F.col("idx") % fanout
    child = F.struct("digest", *carried)
    spread = [F.max(F.when(slot == k, child)).alias(f"c{k}") for k in range(fanout)]
    parent = F.expr(f"idx div {fanout}").alias("idx")
    count = F.expr(f"(max(n) + {fanout - 1}) div {fanout}").alias("n")
    return nodes.groupBy("tree", parent).agg(count, *spread)


def _above(groups: DataFrame, fanout: int) -> DataFrame:
    """The parents as nodes of the next level."""
    own = _joined([F.col(f"c{k}.digest") for k in range(fanout)])
    return groups.select("tree", "idx", "n", F.unhex(F.sha2(hex_text(own), 256)).alias("digest"))


def _below(groups: DataFrame, paths: DataFrame, fanout: int, carried: Sequence[str]) -> DataFrame:
    """The children with `subroot` and their `path`: siblings left and right of the child and of all nodes above it."""
    children = []
    for k in range(fanout):
        left = _joined([F.col(f"c{i}.digest") for i in range(k)])
        right = _joined([F.col(f"c{i}.digest") for i in range(k + 1, fanout)])
        children.append(
            F.struct(
                (F.col("idx") * fanout + k).alias("idx"), F.col(f"c{k}").isNotNull().alias("there"),
                F.col(f"c{k}.digest").alias("digest"), *[F.col(f"c{k}.{c}").alias(c) for c in carried],
                F.struct(left.alias("left"), right.alias("right")).alias("own"),
            )
        )
    met = groups.drop("n").join(paths, ["tree", "idx"])
    spread = met.select("tree", "subroot", "path", F.inline(F.array(*children))).filter("there")
    path = F.concat(F.array("own"), F.col("path")).alias("path")
    return spread.select("tree", "idx", "digest", *carried, "subroot", path)


class Trees:
    """The levels of many trees, from nodes `tree, idx, n, digest`; idx runs from 0 within a tree of n nodes.

    A tree ends at the level where it has one node.
    """

    def __init__(self, nodes: DataFrame, fanout: int, carried: Sequence[str] = ()):
        self.fanout, self.carried = fanout, tuple(carried)
        self.levels: list[DataFrame] = []
        self.ends: list[DataFrame] = []  # nodes that are roots, by level
        most = nodes.agg(F.max("n")).first()[0] or 0
        while True:
            self.ends.append(nodes.filter("n = 1"))
            if most <= 1:
                break
            held = self.carried if not self.levels else ()
            self.levels.append(durable(_pivot(nodes.filter("n > 1"), fanout, held)))
            nodes = _above(self.levels[-1], fanout)
            most = -(-most // fanout)
        self.ends[1:] = [durable(e) for e in self.ends[1:]]

    def roots(self) -> DataFrame:
        """`tree, digest` of each tree."""
        found = [e.select("tree", "digest") for e in self.ends]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def leaves(self, tops: DataFrame) -> DataFrame:
        """All nodes of the first level with `subroot` and `path`, from `tree, subroot, path` of the roots."""
        paths = None
        for level in range(len(self.levels), -1, -1):
            held = self.carried if level == 0 else ()
            # One row per tree.
            ends = self.ends[level].select("tree", "idx", "digest", *held).join(tops, "tree")
            if paths is not None:
                lower = paths.select("tree", "idx", "subroot", "path")
                ends = ends.unionByName(_below(self.levels[level], lower, self.fanout, held))
            paths = ends
        return paths


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
    tampered: Column | None = None, fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`.

    A leaf hashes the columns `fields`, each with its length. Leaves of a group ascend by id, a missing one first, rows
    of one id by their leaf; each `fanout` of them become their hash until one is left. The group's roots, ordered by the group in
    bytes, a missing one first, give `root` in the same way. `proof_sha256` is the hash of all siblings from the
    leaf to the root. `folded_root` is recomputed from the leaf as it is now and those siblings: where `tampered` holds,
    the text is taken with A-Z in lower case. `verified` says whether the two agree.

    Missing values are part of the leaf and differ from empty ones; a row without id is never tampered with by a test
    of its id. Repeated rows are leaves of their own with equal proofs up to their place. A group of one row is its own root.
    An empty table gives an empty result. Columns that are not in `fields` are not read.
    """
    changed = F.lit(None).cast("binary")
    if tampered is not None:
        lowered = F.translate(q(text_col), UPPER, UPPER.lower())
        now = leaf_digest([lowered if f == text_col else q(f) for f in fields])
        changed = F.when(F.coalesce(tampered, F.lit(False)) & q(text_col).isNotNull(), now)
    narrow = docs.select(
        q(id_col).alias("doc_id"), q(group_col).cast("string").alias("source"), leaf_digest([q(f) for f in fields]).alias("digest"),
        changed.alias("changed"),
    )
    # Texts are read once: only digests are ordered and shuffled.
    narrow = durable(narrow.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", sealed(F.col("source"))))
    ranked = global_index(narrow, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("uid")], "at")
    groups = ranked.groupBy("key").agg(F.min("at").alias("start"), F.count("*").alias("n"), F.first("source").alias("source"))
    numbered = durable(global_index(groups, [F.col("source").asc_nulls_first()], "tree"))
    placed = lookup_join(ranked.drop("uid"), numbered.select("key", "tree", "start", "n"), "key", ["tree", "start", "n"], map_key="key")
    carried = ["doc_id", "source", "changed"]
    nodes = placed.select("tree", (F.col("at") - F.col("start")).alias("idx"), "n", "digest", *carried)

    trees = Trees(nodes, fanout, carried)
    subroots = durable(trees.roots())
    count = subroots.count()
    whole = Trees(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"), fanout)
    top = whole.roots().first()
    root = F.lit(bytes(top["digest"]).hex()) if top else F.lit(None).cast("string")
    no_path = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    begin = whole.roots().select("tree", F.col("digest").alias("subroot"), no_path.alias("path"))
    tops = durable(whole.leaves(begin).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "path"))

    leaves = trees.leaves(tops)
    siblings = F.concat(F.lit(""), F.array_join(F.transform("path", lambda x: F.concat(hex_text(x["left"]), hex_text(x["right"]))), ""))
    folded = F.aggregate(
        "path", hex_text(F.coalesce("changed", "digest")), lambda acc, x: F.sha2(F.concat(hex_text(x["left"]), acc, hex_text(x["right"])), 256)
    )
    proved = leaves.select(
        "doc_id", "source", hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(fanout: int = FANOUT, levels: int = 6, top_levels: int = 3) -> str:
    """The same trees level by level with window functions, for up to fanout^levels rows of a source and fanout^top_levels sources."""
    seal = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    leaf = "sha256(" + " || ".join(seal.format(f) for f in FIELDS) + ")"
    now = "sha256(" + " || ".join(seal.format(low if f == "text" else f) for f in FIELDS) + ")"
    steps = [
        f"d AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 AND text IS NOT NULL THEN {now} ELSE {leaf} END AS changed FROM documents)",
        """l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)""",
        "a0 AS (SELECT g, i, n, leaf AS d FROM l)",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            frame = f"OVER (PARTITION BY g, i // {fanout} ORDER BY i ROWS BETWEEN "
            steps.append(
                f"""s{name}{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') {frame}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le,
                coalesce(string_agg(d, '') {frame}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {name}{k})"""
            )
            steps.append(
                f"""{name}{k + 1} AS (SELECT g, i // {fanout} AS i, (max(n) + {fanout - 1}) // {fanout} AS n,
                CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY g, i // {fanout})"""
            )

    climb("a", levels)
    steps.append(f"b0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, d FROM a{levels})")
    climb("b", top_levels)
    steps.append("f0 AS (SELECT doc_id, g, i, leaf, changed AS f, '' AS p FROM l)")
    at = 0
    for name, count in (("a", levels), ("b", top_levels)):
        for k in range(count):
            meet = f"s.g = x.g AND s.i = x.i // {fanout**k}" if name == "a" else f"s.g = 0 AND s.i = x.g // {fanout**k}"
            steps.append(
                f"""f{at + 1} AS (SELECT doc_id, x.g, x.i, leaf, CASE WHEN s.n = 1 THEN f ELSE sha256(le || f || ri) END AS f,
                CASE WHEN s.n = 1 THEN p ELSE p || le || ri END AS p FROM f{at} x JOIN s{name}{k} s ON {meet})"""
            )
            at += 1
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, a.d AS subroot, b.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b.d AS verified
FROM f{at} x JOIN a{levels} a ON a.g = x.g, b{top_levels} b"""


@query("op13_slot_manifest", _oracle())
def op13_slot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return manifest(read(spark, sf_dir, "documents"), tampered=hit).drop("source")
