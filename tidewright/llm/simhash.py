"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Two fingerprints that differ in at most three bits have a half with at most one differing bit, and
in that half a 16-bit block without any. So each distinct fingerprint enters four tries, one per
block, with that block first, its sister next and the other half last; in each, pairs of trie nodes
are followed together under an error budget of 0 bits down to depth 16, 1 down to 32 and 3 to the
leaves. The tries are dealt by their first block. Within a task, node pairs are ranges of one sorted
array and move down together in numpy, depth first; a pair whose leaves are already joined
is skipped, so a dense group costs about its size and not the square of it.

`similar_groups` asks for a similarity instead of a number of bits. Its signatures have 512 bits, and
each enters 36 tries, one per run of 14 bits with that run first; below it the error budget is what
a pair of the given similarity stays under at each depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lookup import lookup_join
from ..session import durable
from .common import map_texts, query, read, texts_of
from .components import connected_components

BITS = 64
SEED = 42
TRIE_ROWS = 50_000  # rows of a trie that one task takes; larger ones are split into pairs of chunks
SLICE = 1 << 17  # node pairs moved down at once
DIRECT = 48  # leaf pairs of a node pair that are compared at once
COMPARED = 1 << 20  # leaf pairs compared in one step
LANES = 8  # 64-bit words of a signature
RUN = 14  # leading bits of a trie of signatures that admit no error


def _shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each word shingle, words split at and joined by ASCII space."""
    parts = text.encode().lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    width = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash over word shingles with repeats."""
    hashes = _shingle_hashes(text, words)
    counts = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def signature(text: str, words: int = 5) -> bytes:
    """SimHash of 64 x `LANES` bits over the set of word shingles; zeros without any word."""
    hashes = np.unique(np.array(_shingle_hashes(text, words), dtype=np.uint64))
    counts = np.zeros(BITS * LANES, dtype=np.int64)
    steps = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 16):
        # The splitmix64 finalizer gives each lane bits of its own.
        z = hashes[at : at + 255 * 16, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def error_budget(similarity: float) -> list[int]:
    """Differing bits that a pair of signatures may have at each depth of a trie.

    Sets with Jaccard similarity s stand at an angle whose cosine is about 2s / (1 + s), and a bit
    differs with the share of that angle in a half turn. The whole signature allows one standard
    error above the expected number, and each depth three above its part of that.
    """
    bits = BITS * LANES
    share = acos(2 * similarity / (1 + similarity)) / pi
    limit = int(bits * share + sqrt(bits * share * (1 - share)))
    rate = limit / bits
    free = [min(limit, int(rate * d + 3 * sqrt(rate * (1 - rate) * d))) for d in range(bits - RUN)]
    return [0] * (RUN + 1) + [*free[1:], limit]


def _budget(depth: int) -> int:
    return 0 if depth <= 16 else 1 if depth <= 32 else 3


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over arrays: `label` points at the smallest member."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def trie_components(
    group: np.ndarray, key: np.ndarray, start: int = 16, budget: Callable[[int], int] = _budget,
    slice_: int = SLICE, direct: int = DIRECT,
) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the rows and, in that order, the smallest linked position of each row.

    A key is one or several 64-bit words. Rows of one `group` share its first `start` bits, so each
    group is the root of a trie.
    """
    key = key.reshape(len(key), -1)
    order = np.lexsort((*key.T[::-1], group))
    key, group = key[order], group[order]
    words = [np.ascontiguousarray(word) for word in key.T]
    depths = BITS * len(words)
    most = budget(depths)
    n = len(key)
    label = np.arange(n)
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, dtype=np.int64)
    ends = np.append(cuts[1:], n)
    wide = ends - cuts > 1
    lo, hi = cuts[wide], ends[wide]
    stack = [(start, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    changes = None
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > slice_:
            stack.append((depth, *(x[slice_:] for x in (alo, ahi, blo, bhi, diff))))
            alo, ahi, blo, bhi, diff = (x[:slice_] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        if changes is None:
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, diff = (x[~one] for x in (alo, ahi, blo, bhi, diff))
        small = ((ahi - alo) * (bhi - blo) <= direct) | (depth >= depths)
        if small.any():
            # What exceeds one step waits, so that links found until then spare it comparisons.
            later = small & (np.cumsum(np.where(small, (ahi - alo) * (bhi - blo), 0)) > max(COMPARED, direct))
            if later.any():
                stack.append((depth, *(x[later] for x in (alo, ahi, blo, bhi, diff))))
                alo, ahi, blo, bhi, diff = (x[~later] for x in (alo, ahi, blo, bhi, diff))
                small = small[~later]
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            size = na * nb
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(nb, size)
            i, j = np.repeat(alo[small], size) + at // width, np.repeat(blo[small], size) + at % width
            near = sum(np.bitwise_count(word[i] ^ word[j]).astype(np.int16) for word in words) <= most
            merged = _join(label, i[near], j[near])
            if merged is not label or near.any():
                label, changes = merged, None
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        # The first position of each range whose next bit is set.
        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            word, bit = words[depth // BITS], np.uint64(BITS - 1 - depth % BITS)
            left, right = lo.copy(), hi.copy()
            while True:
                active = left < right
                if not active.any():
                    return left
                mid = (left + right) // 2
                ones = (word[np.minimum(mid, n - 1)] >> bit) & np.uint64(1) == 1
                right = np.where(active & ones, mid, right)
                left = np.where(active & ~ones, mid + 1, left)

        own = alo == blo
        am = split(alo, ahi)
        bm = np.where(own, am, am)
        other = ~own
        if other.any():
            bm[other] = split(blo[other], bhi[other])
        allowed = budget(depth + 1)
        apart = [
            (alo, am, bm, bhi, diff + 1, np.ones(len(alo), dtype=bool)),
            (am, ahi, blo, bm, diff + 1, ~own),
        ]
        alike = [(alo, am, blo, bm, diff, np.ones(len(alo), dtype=bool)), (am, ahi, bm, bhi, diff, np.ones(len(alo), dtype=bool))]
        for pairs in (apart, alike):  # like pairs are on top: they join most, so that others can be skipped
            made = []
            for a0, a1, b0, b1, d, use in pairs:
                keep = use & (a1 > a0) & (b1 > b0) & (d <= allowed) & ~((a0 == b0) & (a1 - a0 < 2))
                made.append(tuple(x[keep] for x in (a0, a1, b0, b1, d)))
            joined = tuple(np.concatenate(x) for x in zip(*made))
            if len(joined[0]):
                stack.append((depth + 1, *joined))
    return order, label


def _tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    fp = rows["fp"].to_numpy()
    turn = rows["turn"].to_numpy()
    raw = fp.view(np.uint64)
    block = [(raw >> np.uint64(48 - 16 * b)) & np.uint64(0xFFFF) for b in range(4)]
    key = np.zeros(len(rows), dtype=np.uint64)
    for r in range(4):
        mine = turn == r
        for place, b in enumerate((r, r ^ 1, r ^ 2, r ^ 3)):
            key[mine] |= block[b][mine] << np.uint64(48 - 16 * place)
    group = rows.groupby(["turn", "block", "i", "j"], sort=False).ngroup().to_numpy()
    order, label = trie_components(group, key)
    linked = np.flatnonzero(label != np.arange(len(label)))
    yield pd.DataFrame({"a": fp[order[linked]], "b": fp[order[label[linked]]]})


def _dealt(rows: DataFrame, trie: list[str], node: str, trie_rows: int) -> DataFrame:
    """Rows placed by trie; a trie above `trie_rows` rows is cut into chunks by hash, each pair of chunks for itself."""
    sizes = rows.groupBy(*trie).agg(F.ceil(F.count("*") / trie_rows).cast("int").alias("chunks"))
    large = sizes.filter("chunks > 1")
    own = F.pmod(F.xxhash64(node), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = (
        rows.join(large, trie, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", other)
        .select(node, *trie, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    return placed.repartition(*trie, "i", "j")


def near_links(fps: DataFrame, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """`(a, b)`: links among distinct fingerprints `fp` (long) that join all within three bits.

    Not every pair is listed: what is listed connects the same fingerprints.
    """
    block = F.array(*[F.shiftrightunsigned("fp", 48 - 16 * b).bitwiseAND(F.lit(0xFFFF)).cast("int") for b in range(4)])
    turned = fps.select("fp", F.posexplode(block).alias("turn", "block"))
    return _dealt(turned, ["turn", "block"], "fp", trie_rows).mapInPandas(_tries, "a long, b long")


def trie_roots(sig: bytes) -> list[int]:
    """The tries of a signature: place and content of each run of `RUN` bits."""
    bits = np.unpackbits(np.frombuffer(sig, dtype=np.uint8))
    runs = bits[: len(bits) // RUN * RUN].reshape(-1, RUN).astype(np.int64) @ (1 << np.arange(RUN - 1, -1, -1))
    return (np.arange(len(runs)) << RUN | runs).tolist()


def _signature_tries(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    budget = error_budget(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        parts.clear()
        sig = rows["sig"].to_numpy()
        root = rows["root"].to_numpy()
        key = np.empty((len(rows), LANES), dtype=np.uint64)
        for turn in np.unique(root >> RUN):
            mine = np.flatnonzero(root >> RUN == turn)
            for at in range(0, len(mine), 1 << 14):
                some = mine[at : at + (1 << 14)]
                bits = np.unpackbits(np.frombuffer(b"".join(sig[some]), dtype=np.uint8).reshape(len(some), -1), axis=1)
                key[some] = np.packbits(np.roll(bits, -RUN * int(turn), axis=1), axis=1).view(">u8")
        group = rows.groupby(["root", "i", "j"], sort=False).ngroup().to_numpy()
        order, label = trie_components(group, key, RUN, budget.__getitem__, 1 << 15, 1024)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pd.DataFrame({"a": sig[order[linked]], "b": sig[order[label[linked]]]})

    return run


def similar_links(sigs: DataFrame, similarity: float = 0.8, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """`(a, b)`: links among distinct signatures `sig` with their `roots` that join those of the given similarity."""
    turned = sigs.select("sig", F.explode("roots").alias("root"))
    return _dealt(turned, ["root"], "sig", trie_rows).mapInPandas(_signature_tries(similarity), "a binary, b binary")


def _components_of(marked: DataFrame, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """`marked` with the smallest id reachable over `links` of the values in column `name`, and its group.

    `group_key` is a digest of the group's smallest value: ids can be missing or repeated, it tells groups apart.
    """
    joined = connected_components(links, "a", "b")
    # A group or a value that holds many rows is a hot key of these lookups, which spread its rows.
    member = durable(nodes.join(joined, F.col(name) == F.col("node")).select(name, "component", "least"))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = lookup_join(member, named, "component", ["component_id"], "component").select(name, "component", "component_id")
    group = F.unhex(F.md5(F.hex(F.coalesce("component", name)).cast("binary"))).alias("group_key")
    labels = durable(nodes.join(linked, name, "left").select(name, F.coalesce("component_id", "least").alias("component_id"), group))
    return lookup_join(marked, labels, name, ["component_id", "group_key"], name)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
    trie_rows: int = TRIE_ROWS,
) -> DataFrame:
    """One row per document: `doc_id, component_id, text_hash` (the XXH64 of the text) and `group_key`.

    `group_key` is the same within a group and differs between groups, also where ids are missing or repeated.
    Documents link where their sets of word shingles have a Jaccard similarity of `similarity` or
    more, as estimated from signatures of 512 bits; a pair that is just at it can be missed or one
    just below linked. Empty and missing texts share a signature; texts shorter than a shingle are
    one shingle. Missing ids, repeated rows, empty tables and other columns as in `simhash_groups`.
    """

    def start():
        def one(text: str) -> tuple:
            sig = signature(text, words)
            return sig, trie_roots(sig)

        return one

    texts = texts_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kinds = [("sig", "binary", pa.binary()), ("roots", "array<int>", pa.list_(pa.int32()))]
    marked = durable(map_texts(texts, start, kinds, ("doc_id", "text_hash")))
    # The roots follow from the signature, so any of a group will do.
    nodes = durable(marked.groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("roots").alias("roots")))
    links = similar_links(nodes.select("sig", "roots"), similarity, trie_rows)
    member = _components_of(marked.select("doc_id", "text_hash", "sig"), nodes.select("sig", "least"), links, "sig")
    return member.select("doc_id", "component_id", "text_hash", "group_key")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, trie_rows: int = TRIE_ROWS
) -> DataFrame:
    """One row per document: `doc_id, fingerprint, component_id, text_hash` (the XXH64 of the text).

    The fingerprint is written as 16 hex digits; fingerprints link at three or fewer differing bits,
    and the component is the smallest id reachable over links. Empty and missing texts have
    fingerprint zero, linked like any other. A missing id is passed over as component unless its
    group has no other. Repeated rows stay and share a component; an empty table gives an empty
    result. Columns beyond id and text are not read.
    """

    def start():
        return lambda text: (fingerprint(text, words),)

    texts = texts_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    marked = durable(map_texts(texts, start, [("fp", "long", pa.int64())], ("doc_id", "text_hash")))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = _components_of(marked, nodes, near_links(nodes.select("fp"), trie_rows), "fp")
    return member.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id", "text_hash")


def _hex(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


@query("op3_simhash_groups")
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
