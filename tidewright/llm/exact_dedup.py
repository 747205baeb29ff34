"""Exact duplicates by digest, with the frequent digests settled on the map side.

A Misra-Gries summary per task, merged in Spark, names the few digests that can hold a large share
of the rows. Their exact counts and winners are worked out with map-side combination and broadcast
(at most `counters` rows), so their rows are never shuffled. All other digests hold a small share
each and go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import durable
from .common import query, read, texts_of

COUNTERS = 1024


class MisraGries:
    """At most `counters` keys with lower bounds of their counts; the error is n / counters."""

    def __init__(self, counters: int):
        self.counters = counters
        self.rows = 0
        self.held = pd.Series(dtype="int64")

    def add(self, keys: pd.Series) -> None:
        self.rows += len(keys)
        held = self.held.add(keys.value_counts(), fill_value=0)
        if len(held) > self.counters:
            held = held - held.nlargest(self.counters + 1).iloc[-1]
            held = held[held > 0]
        self.held = held


def frequent_keys(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """`(key)`: at most `counters` keys, among them each that holds 2.5 / counters of all rows or more.

    Each task sends the counters above half its own error, which adds at most n / (2 * counters).
    """
    kept = df.select(key).filter(F.col(key).isNotNull())
    rows = kept.count()

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary = MisraGries(counters)
        for batch in batches:
            summary.add(batch[key])
        held = summary.held[summary.held > summary.rows / (2 * counters)]
        yield pd.DataFrame({key: held.index, "n": held.to_numpy(dtype="int64")})

    kind = df.schema[key].dataType.simpleString()
    merged = kept.mapInPandas(summarise, f"{key} {kind}, n long").groupBy(key).agg(F.sum("n").alias("n"))
    return merged.filter(F.col("n") > max(1, rows / counters)).select(key)


def plain_digest(text: Column) -> Column:
    """SHA-256 of a text in which each run of ASCII white space is one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when identical after each run of ASCII white space became one space; a missing
    text is empty, and empty texts form a group like any other. The smallest id of a group stays;
    a missing id comes after all others. Of repeated rows with the smallest id exactly one is
    `kept`. An empty table gives an empty result. Columns beyond id and text are not read.
    """
    digests = durable(
        texts_of(docs, id_col, text_col)
        .select("doc_id", plain_digest(F.col("text")).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    candidates = F.broadcast(frequent_keys(digests, "digest", counters))
    winners = (
        digests.join(candidates, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), first.alias("best"))
    )
    # At most `counters` rows.
    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter(F.col("group_size").isNotNull())
    group = W.partitionBy("digest")
    light = (
        marked.filter(F.col("group_size").isNull())
        .drop("group_size", "best")
        .withColumns({"group_size": F.count("*").over(group), "best": first.over(group)})
    )
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))
