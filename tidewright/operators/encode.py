"""Categorical encoders: fit a table of categories, then apply it by a lookup join.

The same fitted table serves training data, later batches and streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..schema import TableError, numeric_columns, q, require
from ..session import durable
from .lookup import lookup_join
from .ranking import global_index

LOCAL_ROWS = 10_000  # category tables up to this size are kept as literal rows
MAX_ONEHOT = 1_000

# Tokens for missing and unseen categories.
MISSING, NA, UNSEEN = "missing", "__NA__", "__UNSEEN__"


@dataclass
class Categories:
    """Fitted categories of one column: `(value, code, n)` in sorted order."""

    column: str
    frame: DataFrame
    rows: int
    null_token: str | None = None

    def key(self) -> Column:
        key = q(self.column)
        return key if self.null_token is None else F.coalesce(key.cast("string"), F.lit(self.null_token))


def fit_categories(df: DataFrame, column: str, null_token: str | None = None) -> Categories:
    """Count the categories and number them by their sorted order (numbers sort as numbers)."""
    require(df, column)
    key = q(column) if null_token is None else F.coalesce(q(column).cast("string"), F.lit(null_token))
    counts = df.select(key.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    schema = T.StructType(
        [counts.schema["value"], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())]
    )
    first = counts.limit(LOCAL_ROWS + 1).collect()
    if len(first) <= LOCAL_ROWS:
        rows = [(r["value"], i, r["n"]) for i, r in enumerate(sorted(first, key=lambda r: r["value"]))]
        return Categories(column, df.sparkSession.createDataFrame(rows, schema), len(rows), null_token)
    # Too many to hold as literals: number them in place, in range partitions.
    numbered = durable(global_index(counts, ["value"], "code").select("value", "code", "n"))
    return Categories(column, numbered, numbered.count(), null_token)


def fit_all_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, Categories]:
    """Categories of several columns from one pass; a column with more than `LOCAL_ROWS` of them is fitted by itself."""
    columns = list(dict.fromkeys(require(df, columns)))
    cells = [F.struct(F.lit(i).alias("c"), q(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    counts = df.select(F.inline(F.array(*cells))).filter("value is not null").groupBy("c", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("c").orderBy("value"))
    rows = counts.withColumn("place", place).filter(F.col("place") <= LOCAL_ROWS + 1).collect()
    out = {}
    for i, c in enumerate(columns):
        own = [(r["value"], r["n"]) for r in rows if r["c"] == i]
        kind = df.schema[c].dataType
        if len(own) > LOCAL_ROWS or not isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)):
            out[c] = fit_categories(df, c)
            continue
        read = int if isinstance(kind, T.IntegralType) else (lambda v: v == "true") if isinstance(kind, T.BooleanType) else date.fromisoformat if isinstance(kind, T.DateType) else str
        values = sorted((read(v), n) for v, n in own)
        schema = T.StructType([T.StructField("value", kind), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
        out[c] = Categories(c, df.sparkSession.createDataFrame([(v, k, n) for k, (v, n) in enumerate(values)], schema), len(values))
    return out


def _replace(df: DataFrame, cats: Categories, values: dict[str, Column], result) -> DataFrame:
    """Swap the column for `result(joined)` built from the looked-up values."""
    mapping = cats.frame.select("value", "n", *[c.alias(name) for name, c in values.items()])
    keyed = df.withColumn("__key", cats.key())
    joined = lookup_join(keyed, mapping, "__key", list(values))
    new = result(joined)
    return joined.select(*[(new if c == cats.column else q(c)).alias(c) for c in df.columns])


def apply_label(df: DataFrame, cats: Categories, unknown: int | None = None) -> DataFrame:
    """Codes for known categories; missing stays NULL, others become `unknown`."""
    def pick(joined):
        code = F.col("__code")
        if unknown is not None:
            code = F.when(F.col("__key").isNotNull(), F.coalesce(code, F.lit(unknown)))
        return code

    return _replace(df, cats, {"__code": F.col("code")}, pick)


def encode_label(df: DataFrame, column: str, null_token: str | None = None) -> DataFrame:
    return apply_label(df, fit_categories(df, column, null_token))


def unseen_categories(df: DataFrame, cats: Categories) -> DataFrame:
    """`(value, n)` of the values that the fitted table does not know."""
    found = df.select(cats.key().alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    return found.join(cats.frame.select("value"), "value", "left_anti")


def apply_label_unseen(df: DataFrame, cats: Categories) -> DataFrame:
    """Codes with unseen values sent to the unseen token if fitted, else to the first category."""
    known = cats.frame.filter(F.col("value").cast("string") == UNSEEN).select("code").first()
    fallback = known["code"] if known else 0
    return apply_label(df, cats, fallback)


def encode_frequency(df: DataFrame, column: str, cats: Categories | None = None) -> DataFrame:
    """Share of the value among the non-missing rows."""
    cats = cats or fit_categories(df, column)
    total = cats.frame.agg(F.sum("n")).first()[0] or 1
    return _replace(df, cats, {"__share": F.col("n") / F.lit(total)}, lambda j: F.col("__share"))


def encode_count(df: DataFrame, column: str, cats: Categories | None = None, missing: int | None = None) -> DataFrame:
    """Number of rows with the same value; missing stays NULL or becomes `missing`."""
    cats = cats or fit_categories(df, column)

    def pick(joined):
        return F.col("__count") if missing is None else F.coalesce(F.col("__count"), F.lit(missing))

    return _replace(df, cats, {"__count": F.col("n")}, pick)


def encode_target_count(df: DataFrame, column: str) -> DataFrame:
    return encode_count(df, column, missing=0)


def encode_target_mean(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """Mean of a numeric target per category, shrunk towards the overall mean."""
    require(df, [column, target])
    stats = df.filter(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count(q(target)).alias("n"), F.sum(q(target)).alias("s"))
    overall = df.agg(F.avg(q(target))).first()[0]
    value = (F.col("s") + F.lit(smoothing * (overall or 0.0))) / F.nullif(F.col("n") + F.lit(smoothing), F.lit(0.0))
    mapping = stats.select("value", "n", value.alias("__mean"))
    joined = lookup_join(df, mapping, column, ["__mean"])
    return joined.select(*[(F.col("__mean") if c == column else q(c)).alias(c) for c in df.columns])


def encode_custom(df: DataFrame, column: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Values through a given mapping; unmapped ones become NULL."""
    require(df, column)
    if not mapping:
        raise TableError("custom encoding needs a mapping")
    if len(mapping) <= LOCAL_ROWS:
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        table = F.create_map(*pairs)
        return df.withColumn(column, F.when(q(column).isNotNull(), F.try_element_at(table, q(column))))
    frame = df.sparkSession.createDataFrame(list(mapping.items()), ["value", "__to"])
    joined = lookup_join(df, frame, column, ["__to"])
    return joined.select(*[(F.col("__to") if c == column else q(c)).alias(c) for c in df.columns])


def unmapped_count(before: DataFrame, after: DataFrame, column: str) -> int:
    """How many values a custom mapping left without a result."""
    left = before.agg(F.count(q(column))).first()[0]
    return left - after.agg(F.count(q(column))).first()[0]


def fit_onehot(df: DataFrame, column: str, null_token: str | None = MISSING, cap: int = MAX_ONEHOT) -> list[Any] | None:
    """Sorted categories, the missing token included when there are gaps; None above the cap.

    At most `cap + 1` values reach the driver.
    """
    require(df, column)
    key = q(column) if null_token is None else F.coalesce(q(column).cast("string"), F.lit(null_token))
    found = df.select(key.alias("v")).filter(F.col("v").isNotNull()).distinct().limit(cap + 1).collect()
    return sorted(r["v"] for r in found) if len(found) <= cap else None


def apply_onehot(
    df: DataFrame, column: str, categories: Sequence[Any], null_token: str | None = MISSING, kind: str = "double"
) -> DataFrame:
    """One 0/1 column per category in place of the source column; one projection, no shuffle."""
    key = q(column) if null_token is None else F.coalesce(q(column).cast("string"), F.lit(null_token))
    flags = [F.coalesce((key == F.lit(v)).cast(kind), F.lit(0).cast(kind)).alias(f"{column}_{v}") for v in categories]
    return df.select(*[q(c) for c in df.columns if c != column], *flags)


def encode_onehot(
    df: DataFrame, column: str, null_token: str | None = MISSING, kind: str = "double", cap: int = MAX_ONEHOT
) -> DataFrame:
    categories = fit_onehot(df, column, null_token, cap)
    if categories is None:
        raise TableError(f"{column} has more than {cap} categories; use the vector form or another encoder")
    return apply_onehot(df, column, categories, null_token, kind)


def encode_onehot_capped(df: DataFrame, column: str, max_categories: int) -> DataFrame:
    """One-hot only up to a number of categories; above it the column stays as it is."""
    categories = fit_onehot(df, column, None, max_categories)
    return df if categories is None else apply_onehot(df, column, categories, None, "int")


def encode_onehot_vector(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Sparse vector form for columns with many categories."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    output = output or f"{column}_onehot"
    index = StringIndexer(inputCol=column, outputCol="__idx", handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCol="__idx", outputCol=output, dropLast=True)
    return Pipeline(stages=[index, hot]).fit(df).transform(df).drop("__idx")


def encode_categorical(df: DataFrame, column: str, method: str, mapping: Mapping[Any, Any] | None = None) -> DataFrame:
    """One entry point over all methods, as used by transformation lists."""
    if method == "onehot":
        return encode_onehot(df, column)
    if method == "label":
        return encode_label(df, column)
    if method == "frequency":
        return encode_frequency(df, column)
    if method == "count":
        return encode_count(df, column)
    if method == "target":
        return encode_target_count(df, column)
    if method == "custom":
        return encode_custom(df, column, mapping or {})
    raise TableError(f"unknown encoding method {method!r}")


def encoder_artifact_id(df: DataFrame, columns: Sequence[str], config: str = "", uniques: int = 100) -> DataFrame:
    """`(column, artifact_id)`: hash over name, type, configuration and the first sorted values."""
    out = None
    for c in require(df, columns):
        kind = "numeric" if c in numeric_columns(df) else "categorical"
        first = df.select(q(c).alias("v")).filter(F.col("v").isNotNull()).distinct().orderBy("v").limit(uniques)
        values = F.array_join(F.array_sort(F.collect_list("v")), ",")
        text = F.concat(F.lit(f"{c}|{kind}|{config}|"), values)
        one = first.agg(F.substring(F.sha2(text, 256), 1, 16).alias("artifact_id")).select(F.lit(c).alias("column"), "artifact_id")
        out = one if out is None else out.unionByName(one)
    return out
