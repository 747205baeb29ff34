"""Sinks. Each writer task writes its own part files; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TableError, q, string_columns


def _no_breaks(text: Column) -> Column:
    """Line breaks as \\n and \\r, the backslash doubled."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def line_breaks(text: Column) -> Column:
    """The text that `_no_breaks` was given; doubled backslashes are told apart by splitting at them."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite", one_line: bool = False) -> str:
    """With `one_line`, line breaks in texts are escaped, so that the files stay splittable.

    CSV has one mark for missing and empty texts, so an empty text comes back as missing.
    """
    if one_line:
        df = df.withColumns({c: _no_breaks(q(c)) for c in string_columns(df)})
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    # White space at either end of a text is part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One record per line, which is what Spark can split on the way back."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def sink_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> str:
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def sink_excel(df: DataFrame, path: str, max_rows: int = 1_048_575) -> str:
    """A workbook is one file on one machine, so larger tables are refused, not cut."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise TableError("writing Excel needs openpyxl") from error
    frame = df.limit(max_rows + 1).toPandas()
    if len(frame) > max_rows:
        raise TableError(f"a sheet holds at most {max_rows} rows")
    frame.to_excel(path, index=False)
    return path


def append_dataset(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Concatenate by name; both sides must have the same set of columns."""
    if existing is None:
        return new
    if set(existing.columns) != set(new.columns):
        raise TableError(
            "column mismatch on append: "
            f"{sorted(set(existing.columns) ^ set(new.columns))}"
        )
    return existing.unionByName(new)
