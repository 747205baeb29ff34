"""Packing of token sequences into several context sizes, planned on a histogram.

Each document is encoded once. Runs of a whole context are sequences by themselves; what is left of a document,
its tail, is routed to the smallest context that holds it. All that the plan needs is how many tails there are of
each length, at most one number per token of the context whatever the size of the corpus: from the longest context
down, its tails open windows, the gaps are filled with the longest tails of shorter contexts that fit, and where none fits a tail is cut to
the gap. A context opens no more windows than the tokens left can fill, so every window ends up full; the tokens that
remain below the shortest context go to windows of the next powers of two. The plan says for ranges of ranks
within a length where the pieces go, and each task looks its documents up.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.ranking import ROW_BITS, global_index
from ..session import durable
from .common import query, read, texts_of

CONTEXTS = (128, 256, 512, 1024)
END = 0  # id behind each document
STEP_TOKENS = 65_536  # tokens of one training step

# From here on the libraries may hold different editions of Unicode, so the reference library is asked.
PLAIN_BELOW = 0x3000


class Ids:
    """Ids of a text as the tokenizers library gives them.

    `ranks` names the same vocabulary as a rank file, which a faster library reads; it is used for texts whose
    characters are all below U+3000, where both libraries agree on every one of them (see the tests).
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.fast = None
        self.far = re.compile(f"[{chr(PLAIN_BELOW)}-\U0010ffff]")
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not self.far.search(text)):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


_WORKER: dict[tuple, Ids] = {}


def ids_of(*files: str | None) -> Ids:
    """The encoder of this worker."""
    if files not in _WORKER:
        _WORKER[files] = Ids(*files)
    return _WORKER[files]


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@dataclass
class _Tails:
    """Tails of one length: of the documents `lo` to `hi` with tails of `of` tokens, those from `start` on."""

    of: int
    start: int
    lo: int
    hi: int


@dataclass(order=True)
class Windows:
    """Windows `first` to `first + count` of one context, all composed alike; `cost` sums the squares of their pieces."""

    first: int
    count: int
    context: int
    cost: int
    step: int = 0  # position of the first in its context, by falling cost


@dataclass
class Plan:
    """Where tails go: `pieces[n]` holds, by rank among the tails of n tokens, `(lo, hi, start, length, sequence, offset)`."""

    pieces: dict[int, list[tuple[int, int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    windows: list[Windows] = field(default_factory=list)
    sequences: int = 0


def plan_windows(tails: dict[int, int], contexts: Sequence[int] = CONTEXTS) -> Plan:
    """Fill windows with `tails[n]` tails of each length n below the longest context.

    The work depends on the number of lengths and not on the number of tails: all windows that are alike are
    handled as one. Every window is exactly full.
    """
    plan = Plan()
    held: dict[int, list[_Tails]] = {n: [_Tails(n, 0, 0, c)] for n, c in tails.items() if c and n}
    lengths = sorted(held)
    left = sum(n * c for n, c in tails.items())

    def put(length: int, some: _Tails) -> None:
        if length not in held:
            held[length] = []
            lengths.insert(bisect_left(lengths, length), length)
        held[length].append(some)

    def take(length: int, most: int) -> _Tails:
        some = held[length][-1]
        if some.hi - some.lo <= most:
            held[length].pop()
            if not held[length]:
                del held[length]
                del lengths[bisect_left(lengths, length)]
            return some
        part = _Tails(some.of, some.start, some.lo, some.lo + most)
        some.lo += most
        return part

    def place(length: int, most: int, cut: int, sequence: int, offset: int) -> int:
        """Put the first `cut` tokens of up to `most` tails into as many windows; what is cut off stays a tail."""
        some = take(length, most)
        plan.pieces[some.of].append((some.lo, some.hi, some.start, cut, sequence, offset))
        if cut < length:
            put(length - cut, _Tails(some.of, some.start + cut, some.lo, some.hi))
        return some.hi - some.lo

    def fill(first: int, count: int, context: int) -> None:
        """Fill the windows; each entry of the stack is a run of windows that are alike so far."""
        stack = [(first, count, 0, 0)]
        while stack:
            first, count, used, cost = stack.pop()
            gap = context - used
            if not gap:
                plan.windows.append(Windows(first, count, context, cost))
                continue
            at = bisect_right(lengths, gap)
            length = lengths[at - 1] if at else lengths[-1]  # the longest that fits, else the longest, cut to the gap
            cut = min(length, gap)
            done = place(length, count, cut, first, used)
            if done < count:
                stack.append((first + done, count - done, used, cost))
            stack.append((first, done, used + cut, cost + cut * cut))

    shortest = min(contexts)
    closing = [1 << b for b in range(shortest.bit_length() - 2, -1, -1)]
    for context in [*sorted(contexts, reverse=True), *closing]:
        own = context // 2 if context > shortest else 0  # lengths above it belong here
        while lengths and lengths[-1] > own and left >= context:
            length = lengths[-1]
            some = held[length][-1]
            count = min(some.hi - some.lo, left // context)
            left -= count * context
            fill(plan.sequences, count, context)
            plan.sequences += count
    for runs in plan.pieces.values():
        runs.sort()
    plan.windows.sort()
    return plan


class Lookup:
    """A plan as the tasks use it: pieces of a tail by its rank, and the step of a sequence."""

    def __init__(self, plan: Plan, whole: int, longest: int, step_tokens: int = STEP_TOKENS):
        self.pieces: dict[int, tuple[list[int], list[list[tuple]]]] = {}
        for length, runs in plan.pieces.items():
            marks = sorted({r[0] for r in runs} | {r[1] for r in runs})
            filed: list[list[tuple]] = [[] for _ in marks]
            for run in runs:
                for k in range(bisect_left(marks, run[0]), bisect_left(marks, run[1])):
                    filed[k].append(run)
            self.pieces[length] = marks, [sorted(f, key=lambda r: r[2]) for f in filed]
        self.sequences, self.longest = plan.sequences, longest
        self.windows = plan.windows
        self.firsts = [w.first for w in self.windows]
        self.groups: dict[int, int] = {}  # steps of each context
        self.base: dict[int, int] = {}
        counts: dict[int, int] = defaultdict(int, {longest: whole})
        for w in sorted(self.windows, key=lambda w: (-w.cost, w.first)):
            w.step = counts[w.context]
            counts[w.context] += w.count
        at = 0
        for context in sorted(counts, reverse=True):
            self.groups[context] = max(1, -(-counts[context] * context // step_tokens))
            self.base[context] = at
            at += self.groups[context]

    def step(self, context: int, position: int) -> int:
        """Steps are dealt back and forth in order of falling cost, so that they cost about the same."""
        steps = self.groups[context]
        turn, place = divmod(position, steps)
        return self.base[context] + (steps - 1 - place if turn % 2 else place)

    def whole(self, number: int) -> tuple[int, int, int]:
        """Sequence, context and step of the run of a whole context with this number."""
        return self.sequences + number, self.longest, self.step(self.longest, number)

    def tail(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """`(start, length, sequence, offset, context, step)` for each piece of a tail."""
        marks, filed = self.pieces[length]
        for lo, _, start, size, first, offset in filed[bisect_right(marks, rank) - 1]:
            sequence = first + rank - lo
            window = self.windows[bisect_right(self.firsts, sequence) - 1]
            yield start, size, sequence, offset, window.context, self.step(window.context, window.step + sequence - window.first)


def encode_documents(
    docs: DataFrame, id_col: str, text_col: str, files: tuple[str | None, ...], longest: int, keep_ids: bool = False
) -> DataFrame:
    """One row per document with its counts, the checksums of its whole contexts and the ids of its tail.

    `whole_before` counts the whole contexts of the documents before it in its task. With `keep_ids` the ids of
    the whole contexts stay as well.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    kind = texts.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, before = ids_of(*files), 0
        for batch in batches:
            tokens, crcs, tails, bodies, earlier = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                all_ids = np.append(ids(text), np.uint32(END)).astype("<u4")
                whole = len(all_ids) // longest
                data = all_ids.tobytes()
                wide = 4 * longest
                tokens.append(len(all_ids))
                crcs.append([zlib.crc32(data[k * wide : (k + 1) * wide]) for k in range(whole)])
                tails.append(data[whole * wide :])
                bodies.append(data[: whole * wide] if keep_ids else None)
                earlier.append(before)
                before += whole
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("uid"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(earlier, pa.int64()), pa.array(tails, pa.binary()), pa.array(bodies, pa.binary()),
                ],
                names=["doc_id", "uid", "doc_tokens", "crcs", "whole_before", "tail", "body"],
            )

    made = f"doc_id {kind}, uid long, doc_tokens long, crcs array<long>, whole_before long, tail binary, body binary"
    return texts.mapInArrow(encode, made).withColumn("tail_tokens", (F.col("doc_tokens") % longest).cast("int"))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str | None, ...] | None = None,
    contexts: Sequence[int] = CONTEXTS, step_tokens: int = STEP_TOKENS, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step`.

    `files` are a tokenizer file and, optionally, the rank file and the pattern of the same vocabulary; `contexts` are powers
    of two. Each document is its ids and one end id; each id lies in exactly one piece. `context` is the size of the
    sequence, which is always full. Sequences of one context are dealt to steps of `step_tokens` tokens that
    cost about the same in attention within pieces. With `keep_ids` a column `ids` holds the ids themselves, see `sequences_of`.

    A missing or empty text is its end id alone; repeated rows and missing ids are documents like any other; a very
    long text is many whole contexts and one tail. An empty table gives an empty result. Other columns are not read.
    """
    files = files or default_files()
    contexts = tuple(sorted(contexts))
    longest = contexts[-1]
    if any(c & (c - 1) or c < 1 for c in contexts):
        raise ValueError(f"contexts are powers of two, not {contexts}")
    encoded = durable(encode_documents(docs, id_col, text_col, files, longest, keep_ids))
    # At most one row per length.
    counted = encoded.groupBy("tail_tokens").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("whole")).collect()
    counts = {r["tail_tokens"]: r["n"] for r in counted}
    plan = plan_windows({n: c for n, c in counts.items() if n}, contexts)
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(plan, sum(r["whole"] for r in counted), longest, step_tokens))
    begin, at = {}, 0
    for n in sorted(counts):
        begin[n] = at
        at += counts[n]

    # One row per task of the encoding.
    task = F.shiftright("uid", ROW_BITS)
    sums = encoded.groupBy(task.alias("__task")).agg(F.sum(F.size("crcs")).alias("n"))
    earlier = W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("__task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("whole_base"))
    ranked = global_index(encoded, ["tail_tokens", "doc_id", "uid"], "at")
    ranked = ranked.withColumn("__task", task).join(F.broadcast(bases), "__task").drop("__task", "uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, wide = shared.value, 4 * longest
        names = ["start", "length", "ids_crc32", "sequence_id", "offset", "context", "step"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[int] = []
            made: list[tuple] = []
            parts: list[np.ndarray] = []
            for row, r in enumerate(batch.drop_columns(["doc_id"]).to_pylist()):
                number = r["whole_base"] + r["whole_before"]
                for k, crc in enumerate(r["crcs"]):
                    sequence, context, step = lookup.whole(number + k)
                    rows.append(row)
                    made.append((k * longest, longest, crc, sequence, 0, context, step))
                    if keep_ids:
                        parts.append(np.frombuffer(r["body"], "<u4", longest, k * wide))
                if not r["tail_tokens"]:
                    continue
                done = len(r["crcs"]) * longest
                for start, size, sequence, offset, context, step in lookup.tail(r["tail_tokens"], r["at"] - begin[r["tail_tokens"]]):
                    data = r["tail"][4 * start : 4 * (start + size)]
                    rows.append(row)
                    made.append((done + start, size, zlib.crc32(data), sequence, offset, context, step))
                    if keep_ids:
                        parts.append(np.frombuffer(data, "<u4"))
            columns = list(zip(*made)) if made else [()] * len(names)
            taken = pa.array(rows, pa.int64())
            arrays = [batch.column("doc_id").take(taken), batch.column("doc_tokens").take(taken)]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds)]
            if keep_ids:
                arrays.append(pa.array([p.astype("int64") for p in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", *names, *(["ids"] if keep_ids else [])])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, context int, step long"
        + (", ids array<long>" if keep_ids else "")
    )
    return ranked.mapInArrow(cut, schema)


def sequences_of(pieces: DataFrame) -> DataFrame:
    """`sequence_id, context, step, ids, doc_ids, lengths`: the packed sequences of `pack_documents(..., keep_ids=True)`."""
    piece = F.struct("offset", "doc_id", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(
        F.first("context").alias("context"), F.first("step").alias("step"), F.sort_array(F.collect_list(piece)).alias("p")
    )
    return whole.select(
        "sequence_id", "context", "step", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")
    )


@query("op11_hierarchical_packing")
def op11_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
