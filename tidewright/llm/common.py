"""What the text operators share: their inputs, per-text Arrow tasks and the two query tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a string's bytes, by the usual table."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    data = f"hex(encode({text}))"
    parts = f"list_transform(range(1, length({data})::BIGINT, 2), lambda i: ('0x' || substr({data}, i, 2))::BIGINT)"
    step = f"xor(c >> 8, ({table}::BIGINT[])[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {parts}), lambda c, b: {step}), 4294967295)"


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, text)` alone, so that other columns cannot clash; a missing text is empty."""
    return df.select(q(id_col).alias("doc_id"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(
    df: DataFrame, start: Callable[[], Callable[[str], tuple]], kinds: list[tuple[str, str, pa.DataType]],
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns `keep` and what is worked out from each whole `text`, one Arrow batch at a time.

    `start` runs once per task and returns the function of a text; `kinds` names its outputs with
    their Spark and Arrow types. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or start()
            rows = [work(t) for t in batch.column("__text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            made = [pa.array(c, type=k) for c, (_, _, k) in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *made], names=[*keep, *[n for n, _, _ in kinds]]
            )

    fields = [df.schema[n] for n in keep]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(s)) for n, s, _ in kinds]])
    return df.select(*[q(n) for n in keep], F.col("text").alias("__text")).mapInArrow(run, schema)
