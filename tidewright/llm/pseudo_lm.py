"""Masked pseudo-likelihood: a small network predicts each byte from the two before and the two after it.

All windows of the corpus are counted: tasks sum the windows of their texts, Spark the windows of all
tasks. The network (one embedding per place, a tanh layer, a softmax over bytes) is trained in numpy on
that table by rounds of local steps: each partition of the table improves a copy, the copies are
averaged. A document's score is the sum of the conditional log-probabilities of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import durable
from .common import query, read, texts_of

PAD = 0xFF  # a byte that UTF-8 never uses stands outside a text
REACH = 2  # bytes on each side
WIDTH = 32
ROUNDS = 4
BATCH = 4096
SHARD_ROWS = 2_000_000  # windows that one training task steps through
SHARDS = 12
HELD_WINDOWS = 2_000_000  # windows with their counts or values that a task keeps
SLICE = 1 << 21  # bytes worked on at once
RATE = 0.01


def window_slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the windows (the masked byte lowest) with the number of their text, `SLICE` bytes at a time."""
    pad = bytes([PAD]) * REACH
    raw = [t.encode() for t in texts]
    line = np.frombuffer(pad + pad.join(raw) + pad, dtype=np.uint8)
    begins = np.cumsum([0, *[len(r) + REACH for r in raw[:-1]]]) + REACH
    for low in range(REACH, len(line) - REACH, SLICE):
        high = min(low + SLICE, len(line) - REACH)
        inside = np.flatnonzero(line[low:high] != PAD) + low
        codes = line[inside].astype(np.int64)
        for place, shift in enumerate((-2, -1, 1, 2)):
            codes |= line[inside + shift].astype(np.int64) << (8 * (place + 1))
        yield codes, np.searchsorted(begins, inside, side="right") - 1


def merge_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    joined, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(joined)
    joined, n = joined[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
    return joined[first], np.add.reduceat(n, first)


@dataclass(frozen=True)
class Network:
    places: np.ndarray  # 4 x 256 x width
    out: np.ndarray  # width x 256
    bias: np.ndarray  # 256

    @staticmethod
    def start(width: int = WIDTH, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (2 * REACH, 256, width)).astype(np.float32),
            rng.normal(0, 0.1, (width, 256)).astype(np.float32),
            np.zeros(256, dtype=np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.places, self.out, self.bias]

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and log-probabilities of all bytes at each window."""
        sides = [(codes >> (8 * (p + 1))) & 0xFF for p in range(2 * REACH)]
        hidden = np.tanh(sum(self.places[p][s] for p, s in enumerate(sides)))
        z = hidden @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return hidden, z

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), dtype=np.float64)
        for at in range(0, len(codes), BATCH):
            part = codes[at : at + BATCH]
            out[at : at + BATCH] = self.forward(part)[1][np.arange(len(part)), part & 0xFF]
        return out


def local_steps(network: Network, codes: np.ndarray, counts: np.ndarray, rate: float, seed: int) -> tuple[Network, float]:
    """One pass of Adam over weighted windows; the loss is that of the windows before their step."""
    values = [a.copy() for a in network.arrays()]
    first = [np.zeros_like(a) for a in values]
    second = [np.zeros_like(a) for a in values]
    order = np.random.default_rng(seed).permutation(len(codes))
    loss = 0.0
    for step, at in enumerate(range(0, len(order), BATCH), start=1):
        rows = order[at : at + BATCH]
        part, n = codes[rows], counts[rows].astype(np.float32)
        current = Network(*values)
        hidden, logp = current.forward(part)
        target = part & 0xFF
        loss -= float((n * logp[np.arange(len(part)), target]).sum())
        share = (n / n.sum())[:, None]
        error = np.exp(logp)
        error[np.arange(len(part)), target] -= 1
        error *= share
        inner = (error @ values[1].T) * (1 - hidden * hidden)
        places = np.zeros_like(values[0])
        for p in range(2 * REACH):
            side = (part >> (8 * (p + 1))) & 0xFF
            one_hot = np.zeros((256, len(part)), dtype=np.float32)
            one_hot[side, np.arange(len(part))] = 1
            places[p] = one_hot @ inner
        for k, gradient in enumerate((places, hidden.T @ error, error.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient * gradient
            values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(*[v.astype(np.float32) for v in values]), loss


def window_counts(texts: DataFrame) -> DataFrame:
    """`(code, n)`: how often each window occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], names=["code", "n"])

        for batch in batches:
            for found, _ in window_slices(batch.column(1).to_pylist()):
                tally = pd.Series(found).value_counts(sort=False)
                codes.append(tally.index.to_numpy())
                counts.append(tally.to_numpy())
                if sum(map(len, codes)) > HELD_WINDOWS:
                    codes, counts = ([x] for x in merge_counts(codes, counts))
                    if len(codes[0]) > HELD_WINDOWS // 2:
                        yield send()
                        codes, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if sum(map(len, codes)):
            codes, counts = ([x] for x in merge_counts(codes, counts))
            yield send()

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(windows: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Network, list[float]]:
    """The network and the mean loss of each round; `windows` is `(code, n)`.

    Each window goes to one of a number of partitions that grows with the table. A round sends one copy
    of the weights for each partition to the driver (about 170 KB), which averages them by their windows.
    """
    rows = windows.count()
    network, losses = Network.start(width), []
    if not rows:
        return network, losses
    shards = max(SHARDS, -(-rows // SHARD_ROWS))
    dealt = durable(windows.repartition(shards, "code").withColumn("shard", F.spark_partition_id()))
    spark = windows.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network)
        pace = rate * 0.5**turn

        def improve(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace, turn=turn) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            codes = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, dtype=np.int64)
            if not len(codes):
                return
            counts = np.concatenate([p[1] for p in parts])
            order = np.argsort(codes)  # whatever the order the rows came in
            better, loss = local_steps(shared.value, codes[order], counts[order], pace, turn)
            blob = b"".join(a.tobytes() for a in better.arrays())
            yield pa.RecordBatch.from_arrays(
                [pa.array([blob], pa.binary()), pa.array([float(counts.sum())]), pa.array([loss])], names=["weights", "n", "loss"]
            )

        made = dealt.select("code", "n").mapInArrow(improve, "weights binary, n double, loss double").collect()
        total = sum(r["n"] for r in made)
        mean = sum(np.frombuffer(r["weights"], dtype=np.float32).astype(np.float64) * (r["n"] / total) for r in made).astype(np.float32)
        cuts = np.cumsum([a.size for a in network.arrays()])[:-1]
        network = Network(*[x.reshape(a.shape) for x, a in zip(np.split(mean, cuts), network.arrays())])
        losses.append(sum(r["loss"] for r in made) / total)
    return network, losses


def score_texts(texts: DataFrame, network: Network) -> DataFrame:
    """`doc_id, n_bytes, log_probability`; each distinct window is worked out once per task while it is kept."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        known, value = np.empty(0, dtype=np.int64), np.empty(0)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for codes, owner in window_slices(texts):
                place, distinct = pd.factorize(codes)
                at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                met = known[at] == distinct if len(known) else np.zeros(len(distinct), dtype=bool)
                found = np.empty(len(distinct))
                found[met] = value[at[met]]
                found[~met] = net.log_probability(distinct[~met])
                if len(known) > HELD_WINDOWS // 2:
                    known, value = np.empty(0, dtype=np.int64), np.empty(0)
                order = np.argsort(joined := np.concatenate([known, distinct[~met]]))
                known, value = joined[order], np.concatenate([value, found[~met]])[order]
                base = owner[0] if len(owner) else 0
                part = np.bincount(owner - base, weights=found[place])
                sums[base : base + len(part)] += part
                sizes[base : base + len(part)] += np.bincount(owner - base)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(sums)], names=["doc_id", "n_bytes", "log_probability"]
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {kind}, n_bytes long, log_probability double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: `doc_id, n_bytes, log_probability, mean_log_probability`.

    Every byte of the whole text is predicted from both sides. An empty or missing text has no bytes, a
    sum of 0 and no mean. Repeated rows and missing ids stay as rows and count in training as often as they
    occur; an empty table gives an empty result. Columns beyond id and text are not read.
    """
    texts = texts_of(docs, id_col, text_col)
    network, _ = train(durable(window_counts(texts)), rounds=rounds)
    scored = score_texts(texts, network)
    mean = F.when(F.col("n_bytes") > 0, F.col("log_probability") / F.col("n_bytes"))
    return scored.withColumn("mean_log_probability", mean)


@query("op8_pseudo_likelihood")
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))
