"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewright.llm.common import read, texts_of
from tidewright.llm.decontamination import drop_contaminated
from tidewright.llm.exact_dedup import exact_dedup, plain_digest
from tidewright.llm.piece_bpe import round_trip
from tidewright.llm.simhash import similar_groups
from tidewright.llm.toxicity import THRESHOLD, held_out, learn_lexicon, score_rows
from tidewright.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, chosen: DataFrame, key: Column, name: str) -> DataFrame:
    """One document for each `(doc_id, key)` in `chosen`; of repeated rows one stays.

    Ids are part of the key, so a text with many copies is no hot spot. A missing id is taken as -1,
    which cannot mix groups: the other part of the key tells texts apart.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__id")
    keyed = docs.select(*COLUMNS, id_, key.alias("__key"))
    wanted = chosen.select(id_, F.col(name).alias("__key")).distinct()
    return keyed.join(wanted, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from labelled rows that are not held out, does not reject."""
    lexicon = learn_lexicon(texts_of(docs), read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score_rows(docs.select(*COLUMNS), lexicon, COLUMNS)
    return scored.filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    stays = exact_dedup(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    return _only(docs, stays, plain_digest(F.coalesce("text", F.lit(""))), "digest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id, a missing one last; texts link at a similarity of 0.8 over five words."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    first = similar_groups(docs).groupBy("group_key").agg(best).select("best.doc_id", "best.text_hash")
    return _only(docs, first, F.xxhash64(F.coalesce("text", F.lit(""))), "text_hash")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, re-parameterised ones included."""
    return drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document that is left."""
    return round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

# Fingerprints and pieces cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one keeps is written to the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
