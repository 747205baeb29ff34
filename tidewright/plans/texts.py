"""Token, stem, lemma and TF-IDF features of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, content_words
from ..operators import text
from ..schema import q
from ..session import spread
from ..sources import table
from .inputs import rounded
from .registry import query

SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{2,}'))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
CONTENT = f"list_filter({SPLIT}, lambda t: NOT list_contains({STOP}, t))"
TOKENS = f"tokens AS (SELECT doc_id, {CONTENT} AS t FROM documents)"


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("tokenize_clean", f"WITH {TOKENS} SELECT doc_id, array_to_string(t, ' ') AS text FROM tokens")
def clean_query(spark, sf):
    return text.tokenize_clean(documents(spark, sf), "text")


@query("simple_tokenize", f"SELECT doc_id, array_to_string({SPLIT}, ' ') AS tokens FROM documents")
def simple_query(spark, sf):
    df = text.simple_tokenize(documents(spark, sf), "text").drop("text")
    return df.withColumn("tokens", F.array_join("tokens", " "))


@query(
    "stopwords_remove",
    f"WITH {TOKENS} SELECT doc_id, len({SPLIT}) AS words, len({CONTENT}) AS kept FROM documents",
)
def stopwords_query(spark, sf):
    df = text.simple_tokenize(documents(spark, sf), "text", "w")
    return df.select("doc_id", F.size("w").cast("long").alias("words"), F.size(content_words(F.col("text"))).cast("long").alias("kept"))


@query("tokenize_stem")
def stem_query(spark, sf):
    return text.tokenize_stem(documents(spark, sf), "text")


@query(
    "tokenize_lemma",
    f"""WITH {TOKENS}, v AS (SELECT DISTINCT unnest(t) AS w FROM tokens), l AS (SELECT v.w AS word, s.w AS lemma FROM v JOIN v s ON v.w = s.w || 's'),
    p AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM tokens),
    j AS (SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS text FROM p LEFT JOIN l ON w = word GROUP BY 1)
    SELECT d.doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id""",
)
def lemma_query(spark, sf):
    docs = documents(spark, sf)
    vocabulary = docs.select(F.explode(content_words(F.col("text"))).alias("w")).distinct()
    # A plural whose singular also occurs goes back to the singular.
    lemmas = vocabulary.withColumn("word", F.concat("w", F.lit("s"))).join(
        vocabulary.select(F.col("w").alias("word")), "word", "left_semi"
    )
    return text.tokenize_lemma(docs, "text", "doc_id", lemmas.select("word", F.col("w").alias("lemma")))


def _tfidf(features: int) -> str:
    return f"""WITH {TOKENS}, p AS (SELECT doc_id, unnest(t) AS term FROM tokens), c AS (SELECT doc_id, term, count(*) AS n FROM p GROUP BY 1, 2),
    v AS (SELECT term, count(*) AS docs, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT {features}),
    w AS (SELECT doc_id, c.term, n * idf AS w FROM c JOIN v ON c.term = v.term)"""


@query("tfidf", _tfidf(1000) + " SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def tfidf_query(spark, sf):
    return rounded(text.tfidf_long(documents(spark, sf), "text", "doc_id"), "weight")


@query(
    "tfidf_wide",
    _tfidf(100) + " SELECT doc_id, 'tfidf_' || term AS feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
)
def tfidf_wide_query(spark, sf):
    """A hundred columns, turned into rows again for the comparison."""
    wide = text.tfidf_wide(documents(spark, sf), "text", 100)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), q(c).alias("weight")) for c in wide.columns if c != "doc_id"])
    return rounded(wide.select("doc_id", F.inline(cells)).filter(F.col("weight") != 0), "weight")


@query("tfidf_hashing")
def hashing_query(spark, sf):
    return text.tfidf_hashing(documents(spark, sf), "text", "doc_id")


@query(
    "sparsity",
    _tfidf(1000)
    + """ SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM v) AS terms, (SELECT count(*) FROM w) AS nonzero,
    round(1 - (SELECT count(*) FROM w) / ((SELECT count(*) FROM documents) * (SELECT count(*) FROM v)), 6) AS sparsity""",
)
def sparsity_query(spark, sf):
    return rounded(text.sparsity(documents(spark, sf), "text"), "sparsity")


@query(
    "udtf_tokens",
    f"SELECT doc_id, CAST(unnest(range(len({SPLIT}))) AS INTEGER) AS position, unnest({SPLIT}) AS token FROM documents",
)
def tokens_query(spark, sf):
    return text.explode_tokens(documents(spark, sf), "text", "doc_id")
