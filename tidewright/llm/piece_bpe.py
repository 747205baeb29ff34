"""SentencePiece BPE encoding by backtracking, and decoding, exact against the library.

A text is cut before white-space marks and at line ends, which no piece crosses. Each unit is then
encoded on its own: an Aho-Corasick automaton lists the longest piece at each position; the encoder
takes the longest one whose neighbourhood with the piece before it survives re-merging, else a
shorter one, and steps back where none fits, remembering failed positions in a bit field. The
result equals merging, since a sequence of pieces is what merging gives exactly when each adjacent
pair is what merging gives for the two alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import q
from .common import map_texts, query, read, texts_of

MARK = "▁"
UNIT_CACHE = 400_000  # units kept per worker
PAIR_CACHE = 1_000_000
LONG_UNIT = 200  # longer units are not kept


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and byte ids of a BPE model with byte fallback and without normalisation."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if library.is_control(i) or library.is_unknown(i) or library.is_unused(i)}
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(size) if library.is_byte(i)}
        self.byte_id = {v: k for k, v in self.bytes.items()}
        normal = [i for i in range(size) if i not in special and i not in self.bytes]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: library.get_score(i) for i in normal}
        if len(self.byte_id) < 256 or library.normalize("A  Áﬁ ") != f"{MARK}A{MARK}{MARK}Áﬁ{MARK}":
            raise ValueError("the model must have byte fallback, a leading mark and no normalisation")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("the model has pieces that cross white space")
        self.single = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        self._shorter: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        self._trees: dict[int, tuple | None] = {}

    def _merges(self, text: str) -> tuple[list[str], list[tuple[int, str]]]:
        """Symbols left after merging, and the merges made as (start, symbol) in their order.

        The best scored adjacent pair goes first, the leftmost of equals.
        """
        parts, made = list(text), []
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made.append((sum(map(len, parts[:at])), parts[at]))
        return parts, made

    def merge(self, text: str) -> list[str]:
        return self._merges(text)[0]

    def shorter(self, i: int) -> int:
        """The next shorter piece that begins this one, or -1."""
        found = self._shorter.get(i)
        if found is None:
            piece = self.pieces[i]
            found = next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)
            self._shorter[i] = found
        return found

    def tree(self, i: int) -> tuple[list, list] | None:
        """How merging builds a piece: the symbols at its left and at its right edge, the last first.

        Each symbol comes with its score. None where merging the piece's text gives something else, or
        where a symbol was not merged in the order of the scores.
        """
        if i in self._trees:
            return self._trees[i]
        piece = self.pieces[i]
        found = None
        made = self._merges(piece)
        if len(made[0]) == 1:
            left, right = [(c, float("inf")) for c in (piece[0], piece[-1])]
            edges: tuple[list, list] = ([left], [right])
            for start, symbol in made[1]:
                score = self.scores[symbol]
                if start == 0:
                    edges[0].insert(0, (symbol, score))
                if start + len(symbol) == len(piece):
                    edges[1].insert(0, (symbol, score))
            ordered = [s for _, s in made[1]]
            if all(self.scores[a] >= self.scores[b] for a, b in zip(ordered, ordered[1:])):
                found = edges
        self._trees[i] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Do the two pieces stay as they are when their joint text is merged?

        Their recorded merges are undone, the latest first. Between two merges, the symbols that meet
        at the border would have merged if their joint score is above that of the merge to come; on
        a tie the leftmost goes first.
        """
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIR_CACHE:
                self._pairs.clear()
            found = self._pairs[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        if left < 0:
            return self.tree(right) is not None or len(self.merge(self.pieces[right])) == 1
        one, two = self.tree(left), self.tree(right)
        if one is None or two is None:
            a, b = self.pieces[left], self.pieces[right]
            return self.merge(a + b) == [a, b]
        a_edge, b_edge = one[1], two[0]
        i = j = 0
        to_come, to_come_is_right = float("-inf"), False
        while True:
            (a, a_score), (b, b_score) = a_edge[i], b_edge[j]
            joint = self.scores.get(a + b)
            if joint is not None and (joint > to_come or joint == to_come and to_come_is_right):
                return False
            if a_score == b_score == float("inf"):
                return True
            if b_score <= a_score:
                to_come, to_come_is_right = b_score, True
                j += 1
            else:
                to_come, to_come_is_right = a_score, False
                i += 1

    def encode_run(self, run: str) -> list[int]:
        """Pieces of a run whose characters all occur in pieces."""
        n = len(run)
        lengths, pairs = self.lengths, self._pairs
        longest = [-1] * n
        for end, i in self.automaton.iter(run):
            longest[end - lengths[i] + 1] = i  # later matches at a start are longer
        failed = 0  # bit field of positions from which no way leads on
        taken: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + lengths[token]
                if not failed >> end & 1:
                    fit = pairs.get(last << 32 | token)
                    if fit is None:
                        fit = self.fits(last, token)
                    if fit:
                        break
                token = self.shorter(token)
            if token >= 0:
                taken.append(token)
                if end == n:
                    return taken
                at, last, token = end, token, longest[end]
            else:
                failed |= 1 << at
                if not taken:
                    raise ValueError(f"no pieces for {run[:40]!r}")
                token = taken.pop()
                at -= lengths[token]
                last = taken[-1] if taken else -1
                token = self.shorter(token)

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit; characters outside the vocabulary become the bytes of their UTF-8 form."""
        if self.single.issuperset(unit):
            return self.encode_run(unit)
        ids: list[int] = []
        for known, run in itertools.groupby(unit, self.single.__contains__):
            part = "".join(run)
            ids += self.encode_run(part) if known else [self.byte_id[b] for b in part.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids as pieces; broken byte sequences become U+FFFD one byte at a time."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", errors="replace"))
                held = bytearray()
            if i is not None:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)


# White-space marks with what follows them, single line ends, and what follows a line end.
UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def units_of(text: str) -> list[str]:
    """Units of a text: no piece crosses their borders."""
    return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


class _Held(dict):
    """Unit to its ids joined by commas; `back` holds the text decoded from them."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.back = _Back(self)

    def __missing__(self, unit: str) -> str:
        ids = self.model.encode_unit(unit)
        joined = ",".join(map(str, ids))
        if len(unit) <= LONG_UNIT:
            if len(self) >= UNIT_CACHE:
                self.clear()
                self.back.clear()
            self[unit] = joined
            self.back[unit] = self.model.decode(ids)
        return joined


class _Back(dict):
    def __init__(self, held: _Held):
        super().__init__()
        self.held = held

    def __missing__(self, unit: str) -> str:
        return self.held.model.decode(list(map(int, self.held[unit].split(","))))


class Codec:
    """Encodes and decodes whole texts, keeping the units a worker has met."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.held = _Held(self.model)

    def encode(self, text: str) -> list[int]:
        joined = ",".join(map(self.held.__getitem__, units_of(text)))
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of any ids, without the mark that encoding puts first."""
        text = self.model.decode(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of the decoded text."""
        units = units_of(text)
        joined = ",".join(map(self.held.__getitem__, units)).encode()
        back = "".join(map(self.held.back.__getitem__, units))[1:].encode()
        n = joined.count(b",") + 1 if joined else 0
        return n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """`doc_id, ids`: the ids of each whole text, without begin or end.

    Missing and empty texts give no ids. Repeated rows and missing ids stay as rows; an empty table
    gives an empty result. Columns beyond id and text are not read.
    """
    path = model or default_model()
    return map_texts(
        texts_of(docs, id_col, text_col), lambda: lambda t: (codec(path).encode(t),), [("ids", "array<int>", pa.list_(pa.int32()))]
    )


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """`doc_id, text` of arrays of ids; a missing array gives an empty text."""
    path = model or default_model()
    kept = encoded.select(q(id_col).alias("doc_id"), F.coalesce(q(ids_col), F.array().cast("array<int>")).alias("text"))
    return map_texts(kept, lambda: lambda ids: (codec(path).decode(ids),), [("text", "string", pa.string())])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of each whole text encoded and decoded again.

    A missing text counts as empty (no ids, digests of the empty string). Each unit is decoded
    from its ids; byte pieces never run across units. Texts need no word limit: a unit of any length
    is encoded in one pass. Repeated rows and missing ids stay as rows; an empty table gives an
    empty result. Columns beyond id and text are not read.
    """
    path = model or default_model()
    kinds = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return map_texts(texts_of(docs, id_col, text_col), lambda: codec(path).digest, kinds)


@query("op7_piece_round_trip")
def op7_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
