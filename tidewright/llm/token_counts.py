"""Token counts by a two-tier lookup on the map side.

The lengths of the most frequent units are a compact table that goes to every worker once. What it
lacks is encoded by the library in the worker that meets it and kept there. No unit is shuffled: to
find the frequent ones, each task sends a bounded summary of its own counts. The table affects
speed alone; every count is exact.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_texts, query, read, texts_of
from .piece_bpe import MARK, default_model, units_of

TABLE_UNITS = 32_768  # entries of the broadcast table
TASK_UNITS = 4_096  # entries that a task sends
HELD_UNITS = 200_000  # counters and misses that a worker keeps


def length_of(library: sentencepiece.SentencePieceProcessor, unit: str) -> int:
    """Tokens of a unit on its own, by the library.

    Behind a line end the library puts no mark before it; its own mark and the line end take two.
    """
    return len(library.encode("\n" + unit.replace(MARK, " "))) - 2


def frequent_units(texts: DataFrame, table_units: int = TABLE_UNITS, task_units: int = TASK_UNITS) -> list[str]:
    """The units met most often over all texts, at most `table_units`; an estimate for rare ones."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update(units_of(text))
                if len(counts) > HELD_UNITS:
                    counts = Counter(dict(counts.most_common(HELD_UNITS // 4)))
        top = [(u, n) for u, n in counts.most_common(task_units) if n > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"]
        )

    met = texts.mapInArrow(summarise, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r["unit"] for r in met.orderBy(F.desc("n"), "unit").limit(table_units).collect()]


class _Lengths(dict):
    """Unit to length: the broadcast table first, then what this worker has met."""

    def __init__(self, table: dict[str, int], model: str):
        super().__init__(table)
        self.limit = len(table) + HELD_UNITS
        self.table = table
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)

    def __missing__(self, unit: str) -> int:
        n = length_of(self.library, unit)
        if len(unit) <= 200:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.table)
            self[unit] = n
        return n


_WORKER: dict[str, _Lengths] = {}


def _lengths(run: str, shared: Broadcast, model: str) -> _Lengths:
    """The lengths of this run in this worker; those of an earlier run are let go."""
    if run not in _WORKER:
        _WORKER.clear()
        _WORKER[run] = _Lengths(shared.value, model)
    return _WORKER[run]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096,
    table_units: int = TABLE_UNITS,
) -> DataFrame:
    """One row per document: `doc_id, n_bytes, n_tokens, over_limit`.

    Tokens are those of the whole text without begin or end; a missing text counts as empty (0 bytes,
    0 tokens). Repeated rows and missing ids stay as rows; an empty table gives an empty result.
    Columns beyond id and text are not read.
    """
    path = model or default_model()
    texts = texts_of(docs, id_col, text_col)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    table = {u: length_of(library, u) for u in frequent_units(texts, table_units)}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    run = uuid.uuid4().hex

    def start():
        lengths = _lengths(run, shared, path)

        def count(text: str) -> tuple[int, int, bool]:
            n = sum(map(lengths.__getitem__, units_of(text)))
            return len(text.encode()), n, n > limit

        return count

    kinds = [("n_bytes", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("over_limit", "boolean", pa.bool_())]
    return map_texts(texts, start, kinds)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
