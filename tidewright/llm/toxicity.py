"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters and keeps words apart by one
space. Lexicon entries are whole words or word beginnings with a weight; phrases can exempt an entry.
The summed weights and their density give the score through a fitted logistic curve. Entries and
curve are learned from a bounded sample of labelled rows, by set cover: an entry enters when it explains
enough toxic texts that no earlier entry explains, so words that merely occur in copies of a toxic
text stay out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import q
from ..session import durable
from .common import map_texts, query, read, texts_of

SAMPLE_TOXIC = 4_000  # labelled toxic rows the lexicon may be learned from
SAMPLE_CLEAN = 8_000  # and clean ones
CANDIDATES = 20_000  # entries that the cover chooses from
PREFIXES = range(4, 10)  # lengths of word beginnings that can be entries
THRESHOLD = 0.3

# Common English insults that count before any label is seen.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "disgusting", "worthless", "imbecile")
SEED_WEIGHT = 3.0
# Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "recycle trash", "clown fish", "circus clown")

# Letters that look alike, mapped to the plain one, and digits and signs used for letters.
ALIKE = {
    "a": "аαаɑ", "b": "ЬƅᏏ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κк", "l": "ӏⅼ",
    "m": "ⅿм", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝ",
    "x": "хχ", "y": "уγ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_FOLD = str.maketrans(DIGITS | {c: plain for plain, many in ALIKE.items() for c in many} | {c.upper(): p for p, m in ALIKE.items() for c in m if len(c.upper()) == 1})
_FULLWIDTH = str.maketrans({chr(0xFEE0 + ord(c)): c.lower() for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"})
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_SIGNS = re.compile(r"(?<=\w)[@$!](?=\w)|[@$](?=[^\W\d_])")
_SIGN = {"@": "a", "$": "s", "!": "i"}
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, each with one space before and after it."""
    if not text.isascii():
        text = _HIDDEN.sub("", text.translate(_FULLWIDTH))
    if "@" in text or "$" in text or "!" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    words = _WORDS.findall(text.lower().translate(_FOLD))
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Entries as they appear in folded text: ` word ` or ` beginning`, with weights; exempt phrases; the curve.

    A beginning matches longer words alone.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 0.5)
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                folded = fold(phrase)
                made.add_word(folded, (len(folded), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> list[float]:
        """The best weight at each word that an entry matches, outside exempt phrases."""
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded) if self.weights or self.exceptions else ():
            start = end - length + 1
            if weight is None:
                exempt.append((start, end))
            elif weight > best.get(start, 0.0) and (folded[end] == " " or folded[end + 1] != " "):
                best[start] = weight
        if exempt and best:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in exempt)}
        return list(best.values())

    def features(self, text: str) -> tuple[float, float]:
        """Log of the summed weights, and weights for each hundred words on a log scale."""
        folded = fold(text)
        total = sum(self.hits(folded))
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-z)))


def _terms(folded: str) -> set[str]:
    """Whole words and word beginnings of a folded text, as lexicon entries."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _cover(found: list[tuple[int, list[int]]], stats: list[tuple[str, int, int]], toxic: int, clean: int, needed: int) -> dict[str, float]:
    """Greedy cover of the toxic texts; an entry's weight is its log odds ratio."""
    explains: dict[int, set[int]] = {}
    for doc, (label, entries) in enumerate(found):
        if label:
            for e in entries:
                explains.setdefault(e, set()).add(doc)
    weights = {
        e: float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))) for e, (_, p, n) in enumerate(stats)
    }
    chosen: dict[str, float] = {}
    while explains:
        entry = max(explains, key=lambda e: (len(explains[e]) * weights[e], stats[e][1], stats[e][0]))
        covered = explains.pop(entry)
        if len(covered) < needed:
            break
        chosen[stats[entry][0]] = weights[entry]
        for e in list(explains):
            explains[e] -= covered
            if len(explains[e]) < needed:
                del explains[e]
    return chosen


def _fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression on the two features by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-3, penalty, penalty])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    # A text that matches more is never less toxic.
    return float(beta[0]), float(max(beta[1], 0.0)), float(max(beta[2], 0.0))


def learn_lexicon(
    texts: DataFrame, labels: DataFrame, train: Column, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN,
    seeds: Sequence[str] = SEEDS, exceptions: Sequence[str] = EXCEPTIONS,
) -> Lexicon:
    """Learn from the labelled rows where `train` (a condition on `doc_id`) holds.

    At most `toxic_rows` and `clean_rows` rows are used, chosen by a hash of the id; equal texts count once.
    Without labels of both kinds the seed words alone are used.
    """
    spark = texts.sparkSession
    known = labels.select("doc_id", (q("toxic") == 1).alias("toxic")).filter("doc_id is not null and toxic is not null").filter(train)
    order = F.xxhash64("doc_id")
    chosen = (
        known.filter("toxic").orderBy(order).limit(toxic_rows).union(known.filter("not toxic").orderBy(order).limit(clean_rows))
    )
    # At most toxic_rows + clean_rows ids.
    sample = durable(
        texts.join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
        .groupBy(F.xxhash64("text").alias("same"))
        .agg(F.first("text").alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic"))
        .select("text", "toxic")
    )
    sizes = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = sizes[0] or 0, (sizes[1] or 0) - (sizes[0] or 0)
    base = {f" {w} ": SEED_WEIGHT for w in seeds}
    if not toxic or not clean:
        return Lexicon(base, tuple(exceptions))
    needed = max(3, toxic // 400)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, miss = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (hit if label else miss).update(_terms(fold(text)))
        terms = list(hit.keys() | miss.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([hit[t] for t in terms], pa.int64()), pa.array([miss[t] for t in terms], pa.int64())],
            names=["term", "p", "n"],
        )

    counted = sample.mapInArrow(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Telling terms only: met at least ten times as often in toxic texts.
    telling = counted.filter((F.col("p") >= needed) & (F.col("p") * clean >= 10 * (F.col("n") * toxic)))
    stats = [(r["term"], r["p"], r["n"]) for r in telling.orderBy(F.desc("p"), F.length("term"), "term").limit(CANDIDATES).collect()]
    number = {term: i for i, (term, _, _) in enumerate(stats)}
    shared = spark.sparkContext.broadcast(number)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows = [sorted(held[t] for t in _terms(fold(text)) if t in held) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "entries"])

    matched = sample.mapInArrow(match, "toxic int, entries array<int>").filter("toxic = 1")
    found = [(r["toxic"], r["entries"]) for r in matched.collect()]
    learned = _cover(found, stats, toxic, clean, needed)
    lexicon = Lexicon(base | learned, tuple(exceptions))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([p[i] for p in pairs], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["toxic", "a", "b"])

    lexicon._automaton = None
    measured = sample.mapInArrow(measure, "toxic int, a double, b double").collect()
    x = np.array([[r["a"], r["b"]] for r in measured])
    y = np.array([r["toxic"] for r in measured], dtype=float)
    return Lexicon(lexicon.weights, lexicon.exceptions, _fit_curve(x, y))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def score_rows(texts: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of a table with a `text`, and the `score` of each row."""
    plain = Lexicon(lexicon.weights, lexicon.exceptions, lexicon.curve)

    def start() -> Callable[[str], tuple]:
        return lambda text: (plain.score(text or ""),)

    return map_texts(texts, start, [("score", "double", pa.float64())], keep)


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: `doc_id, held_out, score, predicted`.

    The whole text is scored. An empty or missing text matches nothing and has the lowest score.
    Repeated rows and missing ids stay as rows (a missing id is not held out); an empty table
    gives an empty result. Columns beyond id and text are not read.
    """
    return score_rows(texts_of(docs, id_col, text_col), lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Learn a lexicon from the labelled rows that are not held out, then score every row."""
    lexicon = learn_lexicon(texts_of(docs, id_col, text_col), labels, ~held_out(F.col("doc_id")), **limits)
    return score_toxicity(docs, lexicon, id_col, text_col)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
