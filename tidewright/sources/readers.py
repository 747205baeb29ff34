"""Scans: every format becomes a lazy, splittable DataFrame with NULL as the only missing value."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schema import TableError, nulls_for_nan, q, string_columns
from .writers import line_breaks

# File suffix to format.
FORMATS = {
    ".csv": "csv",
    ".txt": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".parquet": "parquet",
    ".xlsx": "excel",
    ".xls": "excel",
}


def _plain_timestamps(schema: T.StructType) -> T.StructType:
    """Read zone-less timestamps as TIMESTAMP so watermarks and pushed filters work."""
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType(), f.nullable)
            if isinstance(f.dataType, T.TimestampNTZType)
            else f
            for f in schema
        ]
    )


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", multiline: bool = False,
    one_line: bool = False, strict: bool = True,
) -> DataFrame:
    """CSV with a header. Give a schema on large data: inference reads the file twice.

    Quoted line breaks need `multiline`, which reads each file in one task; `one_line` reads what
    `sink_csv(one_line=True)` wrote, stays splittable and keeps line breaks. With `strict`, a row with
    the wrong number of fields or a value of the wrong type ends the read instead of passing
    as a row of gaps.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("escape", '"')
    if multiline:
        reader = reader.option("multiLine", True).option("lineSep", "\n")
    if strict:
        # Without pruning every field of a row is looked at, whatever columns a query asks for.
        reader = reader.option("mode", "FAILFAST").option("columnPruning", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    found = reader.csv(path)
    if one_line:
        found = found.withColumns({c: line_breaks(q(c)) for c in string_columns(found)})
    return nulls_for_nan(found)


def scan_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    lines: bool = False,
) -> DataFrame:
    """A records array per file, or one record per line (`lines=True`, splittable)."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return nulls_for_nan(reader.json(path))


def scan_parquet(spark: SparkSession, path: str, nan_columns: Sequence[str] = ()) -> DataFrame:
    """Parquet as it is, so that filters on every column reach the scan and can skip row groups.

    NaN becomes NULL in `nan_columns` alone; name the columns of files whose writers mark gaps by NaN.
    """
    found = spark.read.parquet(path).schema
    return nulls_for_nan(spark.read.schema(_plain_timestamps(found)).parquet(path), nan_columns)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return scan_parquet(spark, os.path.join(directory, f"{name}.parquet"))


def scan_excel(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One workbook per task; needs openpyxl on the executors and a declared schema."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise TableError("reading Excel needs openpyxl") from error

    def rows(batches):
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield pd.read_excel(io.BytesIO(content))

    files = spark.read.format("binaryFile").load(path).select("content")
    return nulls_for_nan(files.mapInPandas(rows, schema))


def scan_auto(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Choose the format by suffix; unknown suffixes and empty tables are refused."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = FORMATS.get(suffix)
    if kind is None:
        raise TableError(f"unsupported file format {suffix!r}; supported: {sorted(FORMATS)}")
    if kind == "csv":
        df = scan_csv(spark, path, **options)
    elif kind in ("json", "jsonl"):
        df = scan_json(spark, path, lines=kind == "jsonl", **options)
    elif kind == "parquet":
        df = scan_parquet(spark, path)
    else:
        df = scan_excel(spark, path, **options)
    if df.isEmpty():
        raise TableError(f"{path} holds no rows")
    return df


def scan_records(
    spark: SparkSession,
    records: Sequence[Mapping[str, Any]] | Mapping[str, Sequence[Any]],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A table from a list of records or from a mapping of column lists."""
    if isinstance(records, Mapping):
        lengths = {len(v) for v in records.values()}
        if len(lengths) > 1:
            raise TableError("column lists differ in length")
        names = list(records)
        rows = [tuple(row) for row in zip(*records.values())]
        return nulls_for_nan(spark.createDataFrame(rows, schema if schema is not None else names))
    if not records and schema is None:
        raise TableError("no records given")
    names = list(dict.fromkeys(k for record in records for k in record))
    rows = [tuple(record.get(n) for n in names) for record in records]
    return nulls_for_nan(spark.createDataFrame(rows, schema if schema is not None else names))
