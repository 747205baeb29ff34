"""Token, stem, lemma and TF-IDF features of text columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.stemming import porter_stem
from ..functions.text import content_words, words
from ..schema import TableError, q, require, string_columns
from .lookup import BROADCAST_ROWS, lookup_join

MAX_FEATURES = 100_000  # the vocabulary is a driver-side artifact, so its size is bounded


def _text(df: DataFrame, column: str) -> Column:
    require(df, column)
    return q(column) if column in string_columns(df) else q(column).cast("string")


def tokenize_clean(df: DataFrame, column: str) -> DataFrame:
    """The column as its content words, joined by blanks."""
    return df.withColumn(column, F.array_join(content_words(_text(df, column)), " "))


def simple_tokenize(df: DataFrame, column: str, output: str = "tokens") -> DataFrame:
    return df.withColumn(output, words(_text(df, column)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem arrays of tokens. Few words make up most text: only the different tokens of a batch become Python strings, and a worker remembers stems."""
    known: dict[str, str] = {}

    def stem(token: str) -> str:
        out = known.get(token)
        if out is None:
            if len(known) > 200_000:
                known.clear()
            out = known[token] = porter_stem(token)
        return out

    for batch in batches:
        tokens = batch.flatten().dictionary_encode()
        stems = pa.array([stem(t) for t in tokens.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False))
        yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), stems.take(tokens.indices))


def tokenize_stem(df: DataFrame, column: str) -> DataFrame:
    """Content words as stems. Narrow: no token is shuffled to be stemmed."""
    return df.withColumn(column, F.array_join(stem_tokens(content_words(_text(df, column))), " "))


def tokenize_lemma(
    df: DataFrame, column: str, key: str, lemmas: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Content words as dictionary forms; words outside the dictionary stay.

    `lemmas` is `(word, lemma)` with one row per word. A small dictionary is broadcast, a
    larger one is joined. Without a dictionary words are stemmed.
    """
    if lemmas is None:
        return tokenize_stem(df, column)
    mapping = lemmas.select(F.col("word").alias("value"), F.col("lemma").alias("__lemma"))
    tokens = df.select(q(key), F.posexplode(content_words(_text(df, column))).alias("__pos", "__token"))
    looked = lookup_join(tokens, mapping, "__token", ["__lemma"], broadcast_rows=broadcast_rows)
    pair = F.struct("__pos", F.coalesce("__lemma", "__token").alias("t"))
    # One text's own tokens come back together, never more.
    joined = looked.groupBy(q(key).alias("__id")).agg(F.array_sort(F.collect_list(pair)).alias("__all"))
    text = F.coalesce(F.array_join(F.transform("__all", lambda p: p["t"]), " "), F.lit(""))
    out = df.join(joined, q(key) == F.col("__id"), "left").withColumn(column, text)
    return out.select(*[q(c) for c in df.columns])


def explode_tokens(df: DataFrame, column: str, key: str) -> DataFrame:
    """Table of tokens: `(key, position, token)`."""
    return df.select(q(key), F.posexplode(words(_text(df, column))).alias("position", "token"))


@dataclass
class TfIdf:
    """Fitted vocabulary: alphabetical terms with their inverse document frequency."""

    terms: list[str]
    idf: list[float]
    documents: int


def fit_tfidf(df: DataFrame, column: str, max_features: int = 1000) -> TfIdf:
    """The most frequent terms over all texts, with idf = ln((1 + n) / (1 + df)) + 1.

    Totals and document counts come from one pass; only the chosen terms reach the driver.
    """
    if not 0 < max_features <= MAX_FEATURES:
        raise TableError(f"max_features must lie in 1..{MAX_FEATURES}")
    tokens = df.select(content_words(_text(df, column)).alias("t"))
    hits = F.concat(
        F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("total"), F.lit(0).alias("docs"))),
        F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("total"), F.lit(1).alias("docs"))),
    )
    terms = (
        tokens.select(F.inline(hits))
        .groupBy("term")
        .agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
        .collect()
    )
    if not terms:
        raise TableError(f"{column} holds no usable words")
    n = df.count()
    chosen = sorted((r["term"], math.log((1 + n) / (1 + r["docs"])) + 1) for r in terms)
    return TfIdf([t for t, _ in chosen], [w for _, w in chosen], n)


def apply_tfidf(df: DataFrame, column: str, model: TfIdf, output: str = "tfidf") -> DataFrame:
    """Sparse, L2-normalized vectors; one narrow pass, all in the JVM."""
    tokens = df.withColumn("__t", content_words(_text(df, column)))
    counts = CountVectorizerModel.from_vocabulary(model.terms, inputCol="__t", outputCol="__c").transform(tokens)
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(model.idf), inputCol="__c", outputCol="__w").transform(counts)
    return Normalizer(p=2.0, inputCol="__w", outputCol=output).transform(weighted).drop("__t", "__c", "__w")


def _nonzero(df: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """A row for each cell that is not zero; zeros never become rows."""
    cells = F.transform(vector_to_array(vector), lambda w, i: F.struct(i.alias("index"), w.alias("weight")))
    return df.select(*[q(c) for c in keep], F.inline(F.filter(cells, lambda c: c["weight"] != 0)))


def tfidf_long(df: DataFrame, column: str, key: str, max_features: int = 1000) -> DataFrame:
    """`(key, term, weight)` for the terms each text contains."""
    model = fit_tfidf(df, column, max_features)
    cells = _nonzero(apply_tfidf(df, column, model), [key], "tfidf")
    term = F.element_at(F.lit(model.terms), F.col("index") + 1)
    return cells.select(q(key), term.alias("term"), "weight")


def tfidf_wide(df: DataFrame, column: str, max_features: int = 1000, max_columns: int = 2000) -> DataFrame:
    """One `tfidf_{term}` column per term, alphabetical, in place of the text."""
    model = fit_tfidf(df, column, max_features)
    if len(model.terms) > max_columns:
        raise TableError(f"{len(model.terms)} columns are too many; use the long or vector form")
    array = apply_tfidf(df, column, model).withColumn("__a", vector_to_array("tfidf"))
    cells = [F.col("__a")[i].alias(f"tfidf_{t}") for i, t in enumerate(model.terms)]
    return array.select(*[q(c) for c in df.columns if c != column], *cells)


def tfidf_hashing(df: DataFrame, column: str, key: str, n_features: int = 1000) -> DataFrame:
    """`(key, feature, weight)` by hashing: no vocabulary pass, L2-normalized counts.

    Hashes are murmur3 and unsigned.
    """
    tokens = df.withColumn("__t", content_words(_text(df, column)))
    counts = HashingTF(numFeatures=n_features, inputCol="__t", outputCol="__c").transform(tokens)
    vectors = Normalizer(p=2.0, inputCol="__c", outputCol="__v").transform(counts)
    cells = _nonzero(vectors, [key], "__v")
    return cells.select(q(key), F.concat(F.lit("hash_feature_"), F.col("index").cast("string")).alias("feature"), "weight")


def sparsity(df: DataFrame, column: str, max_features: int = 1000) -> DataFrame:
    """`(documents, terms, nonzero, sparsity)` of the TF-IDF matrix."""
    model = fit_tfidf(df, column, max_features)
    vectors = apply_tfidf(df, column, model)
    held = F.size(F.filter(vector_to_array("tfidf"), lambda w: w != 0))
    terms = F.lit(len(model.terms)).cast("long")
    one = vectors.agg(F.count("*").alias("documents"), F.sum(held).alias("nonzero"))
    return one.select("documents", terms.alias("terms"), "nonzero", (1 - F.col("nonzero") / (F.col("documents") * terms)).alias("sparsity"))
