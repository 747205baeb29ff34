"""Tokens as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The stop list.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with through during "
    "before after above below up down in out on off over under again further then once"
).split()
# Texts that count as missing.
EMPTY_TEXTS = ("", "nan", "none")

SEPARATORS = r"[^\p{L}\p{N}_]+"
WORD = "^[a-z]{2,}$"


def words(text: Column) -> Column:
    """Lower-case tokens of two or more plain letters; other word characters stay word-bound."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t.rlike(WORD))


def content_words(text: Column) -> Column:
    """Words without stop words, repeats kept; missing texts give no words."""
    known = text.isNotNull() & ~F.lower(F.trim(text)).isin(*EMPTY_TEXTS)
    kept = F.filter(words(text), lambda t: ~t.isin(*STOPWORDS))
    return F.when(known, kept).otherwise(F.array().cast("array<string>"))
