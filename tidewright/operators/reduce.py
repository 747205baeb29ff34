"""Principal components of numeric columns or of one array column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import TableError, numeric_columns, q, require


MAX_SUMMED = 30  # up to this many columns all covariances fit one aggregate


@dataclass
class Components:
    """Fitted components: means, loadings with fixed signs, and variances."""

    columns: list[str]
    means: np.ndarray
    loadings: np.ndarray
    variances: list[float]
    ratios: list[float]

    def report(self, spark) -> DataFrame:
        """`(component, explained_variance, ratio, cumulative)`."""
        total, rows = 0.0, []
        for i, (v, r) in enumerate(zip(self.variances, self.ratios)):
            total += r
            rows.append((f"PC{i + 1}", v, r, total))
        return spark.createDataFrame(rows, "component string, explained_variance double, ratio double, cumulative double")


def _is_array(df: DataFrame, columns: Sequence[str]) -> bool:
    return len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.ArrayType)


def _filled(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in columns]


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    if _is_array(df, columns):
        return df.withColumn("__x", array_to_vector(q(columns[0]).cast("array<double>")))
    names = [f"__x{i}" for i in range(len(columns))]
    wide = df.select("*", *[c.alias(n) for c, n in zip(_filled(columns), names)])
    return VectorAssembler(inputCols=names, outputCol="__x").transform(wide).drop(*names)


def _summed(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of a few columns from one aggregate."""
    x, d = _filled(columns), len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.avg(c) for c in x], *[F.covar_samp(x[i], x[j]) for i, j in pairs]).first()
    covariance = np.zeros((d, d))
    for (i, j), value in zip(pairs, row[d:]):
        covariance[i, j] = covariance[j, i] = value
    return np.array(row[:d], dtype=float), covariance


def fit_pca(df: DataFrame, n: int, columns: str | Sequence[str] | None = None) -> Components:
    """Covariance is summed over partitions; the driver only holds a columns x columns matrix."""
    columns = require(df, columns or numeric_columns(df))
    if not _is_array(df, columns) and len(columns) <= MAX_SUMMED:
        means, covariance = _summed(df, columns)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1]
        loadings, spread = vectors[:, order], np.clip(values[order], 0.0, None)
        total = float(spread.sum())
        ratios = [float(v / total) if total else 0.0 for v in spread]
    else:
        # The components are rotated about the mean, which PCA leaves to its caller.
        vectors = _vector(df, columns)
        centering = StandardScaler(withMean=True, withStd=False, inputCol="__x", outputCol="__c").fit(vectors)
        width = len(centering.mean)
        if not 1 <= n <= width:
            raise TableError(f"components must lie in 1..{width}")
        rotation = PCA(k=n, inputCol="__c", outputCol="__p").fit(centering.transform(vectors))
        means, loadings = centering.mean.toArray(), rotation.pc.toArray()
        ratios = [float(r) for r in rotation.explainedVariance]
        total = float(np.sum(np.square(centering.std.toArray())))
    if not 1 <= n <= len(means):
        raise TableError(f"components must lie in 1..{len(means)}")
    loadings = loadings[:, :n]
    largest = loadings[np.argmax(np.abs(loadings), axis=0), np.arange(n)]
    loadings = loadings * np.where(largest < 0, -1.0, 1.0)
    ratios = ratios[:n]
    return Components(columns, means, loadings, [r * total for r in ratios], ratios)


def _oriented(columns: list[str], means: np.ndarray, covariance: np.ndarray, n: int) -> Components:
    """Components of a covariance matrix; the largest loading of each is positive."""
    if not 1 <= n <= len(means):
        raise TableError(f"components must lie in 1..{len(means)}")
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    loadings, spread = vectors[:, order[:n]], np.clip(values[order], 0.0, None)
    largest = loadings[np.argmax(np.abs(loadings), axis=0), np.arange(n)]
    total = float(spread.sum())
    ratios = [float(v / total) if total else 0.0 for v in spread[:n]]
    return Components(columns, means, loadings * np.where(largest < 0, -1.0, 1.0), [r * total for r in ratios], ratios)


@dataclass
class Scatter:
    """Rows, means and summed products of deviations of the columns: all that components need, and parts of it add up."""

    columns: list[str]
    rows: int
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: Scatter) -> Scatter:
        if self.columns != other.columns:
            raise TableError(f"columns differ: {self.columns} and {other.columns}")
        if not self.rows or not other.rows:
            return other if not self.rows else self
        rows, gap = self.rows + other.rows, other.means - self.means
        products = self.products + other.products + np.outer(gap, gap) * (self.rows * other.rows / rows)
        return Scatter(self.columns, rows, self.means + gap * (other.rows / rows), products)

    def components(self, n: int) -> Components:
        return _oriented(self.columns, self.means, self.products / max(1, self.rows - 1), n)


FAN_IN = 16  # partial results that are added up in one task


def scatter_of(df: DataFrame, columns: str | Sequence[str] | None = None) -> Scatter:
    """The scatter of a table in one pass: tasks add up their batches, and their results meet in a tree."""
    columns = require(df, columns or numeric_columns(df))
    array = _is_array(df, columns)
    x = q(columns[0]).cast("array<double>") if array else F.array(*_filled(columns))
    schema = "task int, rows long, means binary, products binary"

    def added(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Scatter:
        total = Scatter([], 0, np.zeros(0), np.zeros((0, 0)))
        for rows, means, products in parts:
            total = total + Scatter([], rows, means, products)
        return total

    def packed(task: int, s: Scatter) -> dict:
        return {"task": [task], "rows": [s.rows], "means": [s.means.tobytes()], "products": [s.products.tobytes()]}

    def unpacked(rows: int, means: bytes, products: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        m = np.frombuffer(means)
        return rows, m, np.frombuffer(products).reshape(len(m), len(m))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moments() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    off = values - values.mean(axis=0)
                    yield batch.num_rows, values.mean(axis=0), off.T @ off

        total = added(moments())
        if total.rows:
            yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId(), total), pa_schema)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        total = added(unpacked(r, m, p) for r, m, p in zip(pdf["rows"], pdf["means"], pdf["products"]))
        return pd.DataFrame(packed(int(pdf["task"].iloc[0]) // FAN_IN, total))

    pa_schema = pa.schema([("task", pa.int32()), ("rows", pa.int64()), ("means", pa.binary()), ("products", pa.binary())])
    chosen = df.select(x.alias("x")).filter("x is not null")
    tasks = chosen.rdd.getNumPartitions()
    found = chosen.mapInArrow(part, schema)
    while tasks > FAN_IN:
        found = found.groupBy(F.floor(F.col("task") / FAN_IN)).applyInPandas(meet, schema)
        tasks = -(-tasks // FAN_IN)
    # At most FAN_IN rows.
    total = added(unpacked(r["rows"], bytes(r["means"]), bytes(r["products"])) for r in found.collect())
    width = len(total.means) if total.rows else 0 if array else len(columns)
    return Scatter(columns, total.rows, total.means if total.rows else np.zeros(width), total.products if total.rows else np.zeros((width, width)))


class StoredScatter:
    """A scatter that is kept in a folder and takes in one batch after another; old rows are not read again.

    Each batch is stored under its number, so a batch that comes twice counts once.
    """

    SCHEMA = "batch long, columns array<string>, rows long, means array<double>, products array<double>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, Scatter] | None:
        """Number of the last batch and the scatter of all rows up to it."""
        path, files = self._file()
        if not files.exists(path):
            return None
        names = [s.getPath().getName() for s in files.listStatus(path)]
        done = [n for n in names if n.startswith("batch-") and files.exists(path.suffix(f"/{n}/_SUCCESS"))]
        if not done:
            return None
        row = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{max(done)}").first()
        means = np.array(row["means"], dtype=float)
        return row["batch"], Scatter(list(row["columns"]), row["rows"], means, np.array(row["products"], dtype=float).reshape(len(means), -1))

    def take(self, df: DataFrame, columns: str | Sequence[str], batch: int | None = None) -> Scatter:
        """Add the rows of a batch; without a number it is the next one."""
        held = self.last()
        number = batch if batch is not None else held[0] + 1 if held else 0
        if held and number <= held[0]:
            return held[1]
        new = scatter_of(df, columns)
        total = held[1] + new if held and new.rows else new if not held else held[1]
        row = (number, total.columns, total.rows, total.means.tolist(), total.products.ravel().tolist())
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{number:012d}")
        return total


def apply_pca(df: DataFrame, model: Components, whiten: bool = False) -> DataFrame:
    """Centered scores `PC1..PCn` in place of the source columns."""
    scale = [v**0.5 if whiten and v > 0 else 1.0 for v in model.variances]
    rest = [q(c) for c in df.columns if c not in model.columns]
    if not _is_array(df, model.columns) and len(model.columns) <= MAX_SUMMED:
        x = _filled(model.columns)
        scores = []
        for i, s in enumerate(scale):
            terms = [(c - F.lit(float(m))) * F.lit(float(w / s)) for c, m, w in zip(x, model.means, model.loadings[:, i])]
            scores.append(sum(terms[1:], terms[0]).alias(f"PC{i + 1}"))
        return df.select(*rest, *scores)
    loadings, means, factors = model.loadings, model.means, np.array(scale)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rotate(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return batch
        return pd.Series(list((np.stack(batch.to_numpy()) - means) @ loadings / factors))

    rotated = _vector(df, model.columns).withColumn("__a", rotate(vector_to_array("__x")))
    return rotated.select(*rest, *[F.col("__a")[i].alias(f"PC{i + 1}") for i in range(len(scale))])


def pca(df: DataFrame, n: int, columns: str | Sequence[str] | None = None, whiten: bool = False) -> DataFrame:
    return apply_pca(df, fit_pca(df, n, columns), whiten)
