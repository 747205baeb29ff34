"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Numbers, names and units become typed placeholders; what they stood for is kept aside as slots. Windows of
five template words are hash-joined: an item can only reach the share of windows asked for when one of any few
windows of it occurs, so a few with rare words are chosen, and windows of a document are built only where such a word
stands (a prefix filter, which loses nothing). A candidate is then compared in full. A match must lie in one place of the document,
and the slots must be replaced consistently: the same value of the item always by the same value of the document.

Letters of either case are equal, and case alone does not make a name: a capitalised word of the document is read both as itself and as a name, and a
name of the item is met by any capitalised word or by itself in any case.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import q
from .common import map_texts, query, read, texts_of

WINDOW = 5
SHARE = 0.8
CONSISTENT = 0.8
SHIFT = 3  # words by which a match may be moved within itself
BLOCK_ITEMS = 20_000  # items looked up in one pass over the documents
BLOCK_BYTES = 16 << 20  # and their texts

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen".split()
)
# Units of measure and money; single letters only behind a number.
UNITS = frozenset(
    "inch inches foot feet yard yards mile miles ton tons ounce ounces pound pounds liter liters litre "
    "litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars "
    "euro euros cent cents percent degree degrees watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms mm cm km mg kg ml mph kmh $ € £ %".split()
)
SHORT_UNITS = frozenset("m g l".split())
_WORDS = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[$€£%]")
_DIGITS = re.compile(r"[\d_]")
_LETTERS = re.compile(r"\w+|[$€£%]")  # the same words, in a text without digits
_PARTS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]|[$€£%]")
_ENDS = frozenset(".!?:\n")


def _capital(token: str) -> bool:
    return len(token) > 1 and token[0] != token[0].lower()


def kind_of(low: str, before: str) -> str | None:
    """The placeholder of a number or unit in lower case; `before` is the word in front of it."""
    if low in NUMBER_WORDS or low[0].isdigit():
        return NUMBER
    if low in UNITS or low in SHORT_UNITS and before and (before[0].isdigit() or before in NUMBER_WORDS):
        return UNIT
    return None


class Text:
    """Words of a document in lower case; which of them are capitalised is asked for only where something was found."""

    def __init__(self, words: list[str], low: list[str]):
        self.words, self.low = words, low

    @staticmethod
    def of(text: str) -> Text:
        words = (_WORDS if _DIGITS.search(text) else _LETTERS).findall(text)
        return Text(words, " ".join(words).lower().split(" ") if words else [])

    @staticmethod
    def folded(text: str) -> Text | None:
        """The text with each run of capitalised words within a sentence as one word; None if it has no such run."""
        words: list[str] = []
        run = found = False
        for token in _PARTS.findall(text):
            if token in _ENDS:
                run = False
                continue
            name = _capital(token) and kind_of(token.lower(), "") is None
            if name and run:
                words[-1] += f" {token}"
                found = True
            else:
                words.append(token)
            run = name
        return Text(words, [w.lower() for w in words]) if found else None

    def kind(self, p: int) -> str | None:
        return kind_of(self.low[p], self.low[p - 1] if p else "")

    def forms(self, begin: int, width: int) -> list[tuple[str, ...]]:
        """The window at `begin` in all readings of its capitalised words."""
        forms: list[tuple[str, ...]] = [()]
        for p in range(begin, begin + width):
            kind = self.kind(p)
            readings = [kind] if kind else [self.low[p], NAME] if _capital(self.words[p]) else [self.low[p]]
            forms = [(*f, r) for f in forms for r in readings]
        return forms


@dataclass(frozen=True)
class Item:
    """Template words of a benchmark item and the values they stand for in lower case.

    Capitalised words within a sentence are names. Where one begins a sentence it can be a name or not: it is given as its own
    word and is `opened`. An item that is capitalised throughout tells no names.
    """

    item_id: int
    words: tuple[str, ...]
    values: tuple[str, ...]
    opened: frozenset[int] = frozenset()
    text: str = ""

    @staticmethod
    def of(item_id: int, text: str, fold: bool = False) -> Item:
        """With `fold` a run of names within a sentence is one name, an open word before it included."""
        tokens = _PARTS.findall(text)
        within = [b for a, b in zip(tokens, tokens[1:]) if a not in _ENDS and len(b) > 1 and b[0].isalpha()]
        telling = 2 * sum(map(_capital, within)) <= len(within)
        words: list[str] = []
        values: list[str] = []
        opened: set[int] = set()
        begin, run = True, False
        for token in tokens:
            if token in _ENDS:
                begin, run = True, False
                continue
            low = token.lower()
            kind = kind_of(low, values[-1] if values else "")
            name = kind is None and telling and _capital(token)
            if fold and name and run:
                opened.discard(len(words) - 1)
                words[-1] = NAME
                values[-1] += f" {low}"
                continue
            if name and begin:
                opened.add(len(words))
            words.append(kind or (NAME if name and not begin else low))
            values.append(low)
            begin, run = False, name
        return Item(item_id, tuple(words), tuple(values), frozenset(opened), text)

    @staticmethod
    def both(item_id: int, text: str) -> list[Item]:
        """The item with its names one by one and, where that differs, with runs of names as one."""
        plain, folded = Item.of(item_id, text), Item.of(item_id, text, True)
        return [plain] if folded.words == plain.words else [plain, folded]

    @property
    def width(self) -> int:
        return min(WINDOW, len(self.words))

    @property
    def windows(self) -> int:
        return len(self.words) - self.width + 1

    @property
    def telling(self) -> bool:
        """Whether half of the words or more are fixed; else open words must be found as they are."""
        return 2 * sum(self.fixed(k) for k in range(len(self.words))) >= len(self.words)

    def fixed(self, k: int) -> bool:
        return self.words[k] not in (NUMBER, NAME, UNIT) and k not in self.opened

    def loose(self, k: int) -> bool:
        return self.words[k] == NAME or k in self.opened

    def forms(self, i: int) -> list[tuple[str, ...]]:
        """The window at `i`, each name as any name and as itself."""
        forms: list[tuple[str, ...]] = [()]
        for k in range(i, i + self.width):
            readings = [self.values[k], NAME] if self.loose(k) else [self.words[k]]
            forms = [(*f, r) for f in forms for r in readings]
        return forms

    def fits(self, k: int, text: Text, p: int) -> bool:
        """Whether the word at `p` of the text can stand for the item's word `k`."""
        kind = text.kind(p)
        if kind:
            return self.words[k] == kind
        return text.low[p] == self.values[k] and self.words[k] not in (NUMBER, UNIT) or self.loose(k) and _capital(text.words[p])


@dataclass
class Index:
    """Windows of items by their template words, and where in a window the rare words stand that lead to it."""

    items: list[Item]
    windows: dict[tuple[str, ...], list[int]] = field(default_factory=lambda: defaultdict(list))
    leads: dict[str, set[tuple[int, int]]] = field(default_factory=lambda: defaultdict(set))  # word: (width, place in the window)
    bare: set[int] = field(default_factory=set)  # widths of windows without a fixed word: looked for everywhere
    folded: set[str] = field(default_factory=set)  # rare words of windows with names, which may occur in folded documents alone


def anchors(items: list[Item], share: float = SHARE) -> Index:
    """The index of the windows to look up.

    Of n windows at most floor(n - share * n) can be missing, so any one more than that hold a hit. Windows whose words are all fixed
    come first: they are the same however names are folded. Then those with the rarest word.
    """
    used = Counter(w for item in items for w in {w for k, w in enumerate(item.words) if item.fixed(k)})
    index = Index(items)
    for place, item in enumerate(items):
        spare = item.windows - _needed(item.windows, share)

        def rank(i: int, item=item) -> tuple:
            inside = range(i, i + item.width)
            rarest = min((used[item.words[k]] for k in inside if item.fixed(k)), default=len(items) + 1)
            return any(item.loose(k) for k in inside), rarest, sum(not item.fixed(k) for k in inside), i

        for i in sorted(range(item.windows), key=rank)[: spare + 1]:
            inside = range(i, i + item.width)
            fixed = [k for k in inside if item.fixed(k)]
            if fixed:
                lead = min(fixed, key=lambda k: (used[item.words[k]], item.words[k]))
                index.leads[item.words[lead]].add((item.width, lead - i))
                if any(item.loose(k) for k in inside):
                    index.folded.add(item.words[lead])
            else:
                index.bare.add(item.width)
            for form in item.forms(i):
                if place not in index.windows[form][-1:]:
                    index.windows[form].append(place)
    index.windows, index.leads = dict(index.windows), dict(index.leads)
    return index


def _needed(windows: int, share: float) -> int:
    """The least number of windows that makes up the share."""
    return max(1, -(-round(share * windows * 1_000_000) // 1_000_000))


def compare(item: Item, text: Text, offsets: set[int]) -> tuple[float, float, int, int]:
    """Best share of windows found in one place, consistency of its slots, changed slots, and where it begins.

    `offsets` are the moves of the item's words against the text's that are tried.
    """
    strict = bool(item.opened) and not item.telling
    places: list[tuple[int, int]] = []
    size = len(text.low)
    for o in sorted(offsets):
        streak = 0
        for k in range(max(0, -o), min(len(item.words), size - o)):
            streak = streak + 1 if item.fits(k, text, k + o) and not (strict and k in item.opened and text.low[k + o] != item.values[k]) else 0
            if streak >= item.width:
                places.append((o, k - item.width + 1))
    best: tuple[int, int] = (0, 0)
    counts: Counter[int] = Counter()
    low = 0
    for high, (offset, i) in enumerate(places):
        counts[i] += 1
        while places[low][0] < offset - SHIFT:
            counts[places[low][1]] -= 1
            if not counts[places[low][1]]:
                del counts[places[low][1]]
            low += 1
        if len(counts) > best[0]:
            best = (len(counts), low)
    if not best[0]:
        return 0.0, 0.0, 0, 0
    first = places[best[1]][0]
    chosen = {i: offset for offset, i in reversed(places) if first <= offset <= first + SHIFT}
    slots: dict[int, str] = {}
    for i, offset in sorted(chosen.items()):
        for k in range(i, i + item.width):
            if item.words[k] == NUMBER or item.loose(k):
                slots.setdefault(k, text.low[k + offset])
    # An open word that is never a name here and was never changed is an ordinary word and no slot.
    names = {item.values[k] for k, v in slots.items() if k not in item.opened or item.values[k] != v}
    slots = {k: v for k, v in slots.items() if item.values[k] in names}
    mapping: dict[str, Counter[str]] = defaultdict(Counter)
    for k, value in slots.items():
        mapping[item.values[k]][value] += 1
    agree = sum(max(c.values()) for c in mapping.values())
    changed = sum(item.values[k] != v for k, v in slots.items())
    return best[0] / item.windows, agree / len(slots) if slots else 1.0, changed, first


def _met(text: Text, index: Index) -> dict[int, set[int]]:
    """Items with a window in the text, and how far their words may be moved against the text's."""
    found: dict[int, set[int]] = defaultdict(set)
    seen: set[tuple[int, int]] = set()

    def look(begin: int, width: int) -> None:
        if begin < 0 or begin + width > len(text.low) or (begin, width) in seen:
            return
        seen.add((begin, width))
        for form in text.forms(begin, width):
            for place in index.windows.get(form, ()):
                item = index.items[place]
                if item.width == width:
                    for i in range(item.windows):
                        if all(item.fits(i + k, text, begin + k) for k in range(width)):
                            found[place].update(range(begin - i - SHIFT, begin - i + SHIFT + 1))

    if not index.leads.keys().isdisjoint(text.low):
        leads = index.leads
        for p, word in enumerate(text.low):
            if word in leads:
                for width, place in leads[word]:
                    look(p - place, width)
    for width in index.bare:
        for begin in range(len(text.low) - width + 1):
            look(begin, width)
    return found


def find_items(text: str, index: Index, share: float = SHARE, consistent: float = CONSISTENT) -> list[tuple]:
    """`(item_id, coverage, consistency, changed, start)` for each item that the text holds."""
    plain = Text.of(text)
    met = _met(plain, index)
    if not met and not index.bare and index.folded.isdisjoint(plain.low):
        return []
    best: dict[tuple[int, str], tuple] = {}
    folded = Text.folded(text)
    for read_, found in [(plain, met), *([(folded, _met(folded, index))] if folded else [])]:
        for place, offsets in sorted(found.items()):
            item = index.items[place]
            coverage, agreement, changed, start = compare(item, read_, offsets)
            if coverage * item.windows >= _needed(item.windows, share) - 1e-9 and agreement >= consistent:
                hit = (item.item_id, coverage, agreement, changed, start)
                key = (item.item_id, item.text or " ".join(item.values))
                if key not in best or (coverage, agreement, -changed) > (best[key][1], best[key][2], -best[key][3]):
                    best[key] = hit
    return list(best.values())


def item_blocks(benchmark: DataFrame, share: float = SHARE, block_items: int = BLOCK_ITEMS) -> Iterator[Broadcast]:
    """The index of the items, broadcast in blocks bounded by their number and by the bytes of their texts; at least one, which may be empty."""
    spark = benchmark.sparkSession
    listed = texts_of(benchmark, "item_id", "text").filter("doc_id is not null and text != ''").distinct()
    rows, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // block_items), -(-size // BLOCK_BYTES))
    numbered = listed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        items = []
        for r in numbered.filter(F.col("block") == block).orderBy("doc_id", "text").collect():
            items += [item for item in Item.both(int(r["doc_id"]), r["text"]) if item.words]
        yield spark.sparkContext.broadcast(anchors(items, share))


MATCH_TYPE = pa.list_(
    pa.struct(
        [("item_id", pa.int64()), ("coverage", pa.float64()), ("consistency", pa.float64()), ("changed", pa.int32()), ("start", pa.int32())]
    )
)


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE,
    consistent: float = CONSISTENT, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row for each document and item it holds: `doc_id, item_id, kind, coverage, consistency, changed, start`.

    `kind` is `verbatim` when no slot was changed, else `reparameterised`; `start` is the word where it
    begins (a run of names counts as one where only that finds the item). Items with fewer than five words must occur as a whole; items without words, missing texts
    and missing item ids match nothing. Repeated rows are reported once each; equal items under several ids each
    match; an empty table on either side gives an empty result. Documents never move: the items go to them
    in blocks of at most `block_items`, one pass over the documents for each block.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for shared in item_blocks(benchmark, share, block_items):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = [find_items(t, index, share, consistent) for t in batch.column(1).to_pylist()]
                keep = [i for i, h in enumerate(hits) if h]
                named = [
                    [dict(zip(("item_id", "coverage", "consistency", "changed", "start"), h)) for h in hits[i]] for i in keep
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(named, MATCH_TYPE)], names=["doc_id", "found"]
                )

        fields = "item_id:bigint,coverage:double,consistency:double,changed:int,start:int"
        part = texts.mapInArrow(scan, f"doc_id {kind}, found array<struct<{fields}>>")
        found = part if found is None else found.union(part)
    flat = found.select("doc_id", F.inline("found"))
    what = F.when(F.col("changed") == 0, "verbatim").otherwise("reparameterised")
    return flat.select("doc_id", "item_id", what.alias("kind"), "coverage", "consistency", "changed", "start")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = SHARE, consistent: float = CONSISTENT,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark item; nothing is shuffled."""
    columns = docs.columns
    for shared in item_blocks(benchmark, share, block_items):

        def start(shared=shared):
            index = shared.value
            return lambda text: (not find_items(text or "", index, share, consistent),)

        texts = docs.withColumn("text", q(text_col)) if text_col != "text" else docs
        docs = map_texts(texts, start, [("__clean", "boolean", pa.bool_())], columns).filter("__clean").drop("__clean")
    return docs


@query("op2_template_decontamination")
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
