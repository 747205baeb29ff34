"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Components are integers. Their residues modulo several small primes, taken around zero, are multiplied as float32
matrices: the primes are chosen so that every partial sum stays an exact float32. The residues of a score
give the signed score itself by mixed-radix digits around zero, and primes are taken until their product
exceeds twice the largest score that the lengths of the vectors allow. Each task keeps the best rows of every anchor, so a
score matrix exists for one batch at a time only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schema import q
from ..session import durable, scratch_path, spread
from .common import query, read

DEPTH = 256  # products summed before they are reduced
EXACT = 1 << 24  # whole numbers up to this are exact in float32
BLOCK_ANCHORS = 4_096  # anchors in one pass over the rows
TILE = 1 << 20  # scores worked on at once
LIMIT = 1 << 62  # scores must be below
MIN, MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def primes_for(width: int, bound: int) -> list[int]:
    """Odd primes, the largest first, whose products are exact and whose range holds all scores up to `bound`."""
    half = math.isqrt(EXACT // max(1, min(width, DEPTH)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError("scores are too large for the primes there are")
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo an odd p, from -(p-1)/2 to (p-1)/2."""
    half = p // 2
    return (values + half) % p - half


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(values, p).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed scores of all rows of `left` with all rows of `right`, from their residues."""
    parts = []
    for a, b, p in zip(left, right, primes):
        total = None
        for at in range(0, a.shape[1], DEPTH):
            part = (a[:, at : at + DEPTH] @ b[:, at : at + DEPTH].T).astype(np.int64)
            total = part if total is None else centred(total, p) + part
        parts.append(centred(total, p))
    # Mixed radix: value = d0 + d1 * p0 + d2 * p0 * p1 + ..., each digit around zero like its prime.
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        known, weight = np.zeros_like(parts[0]), 1
        for d, before in zip(digits, primes):
            known = known + d * weight
            weight = weight * before % p
        digits.append(centred(centred(parts[i] - known, p) * pow(weight, -1, p), p) if digits else parts[i])
    value = digits[-1]
    for d, p in zip(reversed(digits[:-1]), reversed(primes[: len(digits) - 1])):
        value = value * p + d
    return value


class Best:
    """The first `k` rows of each of `n` lists: higher scores first, then smaller ids, then rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), MIN, dtype=np.int64)
        self.id = np.full((n, k), MAX, dtype=np.int64)
        self.uid = np.full((n, k), MAX, dtype=np.int64)

    def add(self, lists: slice, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Rows in ascending order of id; a score of MIN takes no part."""
        k, width = self.k, scores.shape[1]
        least = self.score[lists, -1]
        if width > k:
            least = np.maximum(least, np.partition(scores, width - k, axis=1)[:, width - k])
        take = (scores >= least[:, None]) & (scores > MIN)
        if np.count_nonzero(take) > 2 * k * len(take):
            ties = scores == least[:, None]
            take &= ~ties | (np.cumsum(ties, axis=1, dtype=np.int32) <= k)
        row, column = np.nonzero(take)
        if not len(row):
            return
        held_row, held_at = np.nonzero(self.score[lists] > MIN)
        n = np.concatenate([row, held_row])
        score = np.concatenate([scores[row, column], self.score[lists][held_row, held_at]])
        id_ = np.concatenate([ids[column], self.id[lists][held_row, held_at]])
        uid = np.concatenate([uids[column], self.uid[lists][held_row, held_at]])
        order = np.lexsort((uid, id_, -score, n))
        n, score, id_, uid = n[order], score[order], id_[order], uid[order]
        place = np.arange(len(n)) - np.searchsorted(n, n)
        keep = place < k
        n, place = n[keep], place[keep]
        for store, values in ((self.score, score), (self.id, id_), (self.uid, uid)):
            store[lists][n, place] = values[keep]


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component; a missing vector, component or one that is not finite gives NULL."""
    doubled = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(doubled, lambda x: F.floor(x * F.lit(factor))))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Components as whole numbers, shorter vectors filled up with 0."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class _Anchors:
    """A block of anchors as the tasks use it; `low` and `high` bound the negatives of each positive."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, labels: list[str], matrix: np.ndarray, primes: list[int]):
        self.uids, self.ids, self.labels, self.primes = uids, ids, labels, primes
        self.residues = residues(matrix, primes)
        self.width = matrix.shape[1]
        self.positive_id = self.positive_score = self.low = self.high = None

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Scores, one tile of anchors by rows at a time, the rows in order of their ids, and which labels agree."""
        rows = max(1, min(8_192, TILE // 64))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids, uids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "uid"))
            order = np.lexsort((uids, ids))
            encoded = part.column("label").dictionary_encode()
            codes = {label: i for i, label in enumerate(encoded.dictionary.to_pylist())}
            labels = encoded.indices.to_numpy(zero_copy_only=False)[order]
            matrix = _matrix(part.column("vector"), self.width)[order]
            own = np.array([codes.get(x, -1) for x in self.labels])
            right = residues(matrix, self.primes)
            step = max(1, TILE // len(ids))
            for begin in range(0, len(self.uids), step):
                cut = slice(begin, begin + step)
                scores = products([r[cut] for r in self.residues], right, self.primes)
                yield cut, scores, own[cut, None] == labels[None, :], ids[order], uids[order]


def _merged(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each list over all tasks, numbered from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 10, low: Fraction = Fraction(3, 10), high: Fraction = Fraction(9, 10), factor: float = 256.0,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` for the rows where `anchor` holds.

    The score of two rows is the inner product of their components, each `floor(factor * x)`. An anchor's positives are its first
    `positives` other rows of the same label; for each, its first `negatives` rows of other labels whose score lies between `low`
    and `high` times that of the positive are returned. Higher scores come first, ties by the smaller id.

    Rows take no part without id, label or vector, or with a component that is missing or not finite. Vectors of different length are
    filled up with zeros. Repeated rows are rows of their own: each repeated anchor gives its own results, and a
    repeated row is listed once for each copy. A positive with no row in its range gives no rows; an empty table
    gives an empty result. Scores of 2^62 and more are refused. Other columns are not read. Anchors are worked on in blocks of about
    `block_anchors`, two passes over the vectors for each; tasks send at most `positives * negatives` rows per anchor.
    """
    label = q(label) if isinstance(label, str) else label
    spark = vectors.sparkSession
    rows = vectors.select(
        q(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), quantised(q(vector_col), factor).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter("vec_id is not null and label is not null and vector is not null")
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    found = rows.agg(F.max(F.size("vector")), F.max(square), F.count(F.when(F.col("anchor"), 1))).first()
    width, bound, anchors = found[0] or 0, found[1] or 0.0, found[2]
    if not bound < LIMIT:
        raise ValueError("scores of 2^62 and more do not fit the result")
    primes = primes_for(max(1, width), math.ceil(bound * 1.000001) + 1)
    blocks = max(1, -(-anchors // block_anchors))
    chosen = rows.filter("anchor").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    narrow = spread(rows.select("vec_id", "label", "vector", "uid"))
    out = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    for block in range(blocks):
        # About `block_anchors` rows.
        held = chosen.filter(F.col("block") == block).select("uid", "vec_id", "label", "vector").orderBy("uid").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        vector = held.column("vector").combine_chunks()
        uids, ids = (held.column(c).to_numpy() for c in ("uid", "vec_id"))
        block_of = _Anchors(uids, ids, held.column("label").to_pylist(), _matrix(vector, max(1, width)), primes)
        first = spark.sparkContext.broadcast(block_of)

        def near(batches: Iterator[pa.RecordBatch], shared=first) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = Best(len(own.uids), positives)
            for batch in batches:
                for cut, scores, same, row_ids, row_uids in own.tiles(batch):
                    other = same & (own.uids[cut, None] != row_uids[None, :])
                    best.add(cut, np.where(other, scores, MIN), row_ids, row_uids)
            n, at = np.nonzero(best.score > MIN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), *[pa.array(s[n, at]) for s in (best.score, best.id, best.uid)]], names=["n", "score", "id", "uid"]
            )

        # At most `positives` rows per anchor of the block.
        listed = _merged(narrow.mapInArrow(near, "n long, score long, id long, uid long"), ["n"], positives).toArrow()
        n, rank, score, id_ = (listed.column(c).to_numpy() for c in ("n", "rank", "score", "id"))
        block_of.positive_id = np.zeros((len(uids), positives), dtype=np.int64)
        block_of.positive_score = np.zeros((len(uids), positives), dtype=np.int64)
        block_of.low = np.full((len(uids), positives), MAX, dtype=np.int64)  # no positive, no negatives
        block_of.high = np.full((len(uids), positives), MIN, dtype=np.int64)
        block_of.positive_id[n, rank - 1] = id_
        block_of.positive_score[n, rank - 1] = score
        block_of.low[n, rank - 1] = [math.ceil(low * int(s)) for s in score]
        block_of.high[n, rank - 1] = [math.floor(high * int(s)) for s in score]
        second = spark.sparkContext.broadcast(block_of)

        def far(batches: Iterator[pa.RecordBatch], shared=second) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = [Best(len(own.uids), negatives) for _ in range(positives)]
            for batch in batches:
                for cut, scores, same, row_ids, row_uids in own.tiles(batch):
                    open_ = np.where(same, MIN, scores)
                    for k in range(positives):
                        fits = (open_ >= np.maximum(own.low[cut, k], MIN + 1)[:, None]) & (open_ <= own.high[cut, k, None])
                        best[k].add(cut, np.where(fits, open_, MIN), row_ids, row_uids)
            for k in range(positives):
                n, at = np.nonzero(best[k].score > MIN)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.uids[n]), pa.array(np.full(len(n), k, dtype=np.int32)), pa.array(own.ids[n]), pa.array(own.positive_id[n, k]),
                        pa.array(own.positive_score[n, k]), *[pa.array(s[n, at]) for s in (best[k].score, best[k].id, best[k].uid)],
                    ],
                    names=["anchor", "place", "anchor_id", "positive_id", "positive_score", "score", "id", "uid"],
                )

        kinds = "anchor long, place int, anchor_id long, positive_id long, positive_score long, score long, id long, uid long"
        result = _merged(narrow.mapInArrow(far, kinds), ["anchor", "place"], negatives)
        result.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
    if not anchors:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)
