"""SentencePiece BPE by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across. The distinct words of a batch lie in one flat array of
symbols; in each round every word finds its least pair rank by a segmented minimum, all its pairs of that rank are merged
at once from left to right, and the array is compacted, until no word has a pair left. Words that a task has met keep
their ids, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import map_rows

#: The mark that stands for a space in pieces; fixed value.
SPACE = "▁"
#: Words that a task keeps with their ids; beyond it starts anew, which costs time but changes no result.
KEPT_WORDS = 300_000
#: Words longer than this are also cut between characters that stand side by side in no piece.
LONG_WORD = 48
#: Symbols from here on are characters without a piece; room for symbols in a pair's key.
LONE, PAIR = 1 << 20, 1 << 24
_NONE = np.int32((1 << 31) - 1)

#: Kinds of pieces in a model file; fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message: integers, or bytes of strings, messages and fixed-width numbers."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """A BPE model with byte fallback that takes texts as they are, with a space put before them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        parts = [dict(_fields(v)) for k, v in message if k == 1]
        trainer, normalizer = (dict(_fields(next(v for k, v in message if k == n))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or trainer.get(24):
            raise ValueError("only BPE models with byte fallback, a leading space and no normalisation are read")
        self.pieces = [p[1].decode() for p in parts]
        self.kinds = np.array([p.get(3, NORMAL) for p in parts])
        if set(self.kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        scores = np.array([np.frombuffer(p.get(2, bytes(4)), dtype="<f4")[0] for p in parts])
        self.end = trainer.get(42, 2)
        self.bytes = np.zeros(256, dtype=np.int32)  # id of each byte
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[int(self.pieces[i][3:5], 16)] = i
        normal = [i for i in range(len(parts)) if self.kinds[i] == NORMAL]
        self._symbols(normal)
        self._pairs(normal, np.unique(-scores, return_inverse=True)[1])
        self._cuts(normal, scores)

    def _symbols(self, normal: list[int]) -> None:
        self.number = {self.pieces[i]: i for i in normal}
        self.by_char = np.arange(LONE, LONE + 0x110000, dtype=np.int32)
        for i in normal:
            if len(self.pieces[i]) == 1:
                self.by_char[ord(self.pieces[i])] = i

    def _pairs(self, normal: list[int], ranks: np.ndarray) -> None:
        symbol = lambda p: self.number.get(p, int(self.by_char[ord(p)]) if len(p) == 1 else None)
        keys, made = [], []
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a * PAIR + b)
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int32)[order]
        self.ranks = ranks[self.made].astype(np.int32)

    def _cuts(self, normal: list[int], scores: np.ndarray) -> None:
        """How texts are cut into words, and the pairs of characters that stand side by side in a piece."""
        several = [self.pieces[i] for i in normal if len(self.pieces[i]) > 1]
        self.side = np.unique(np.array([ord(a) * 0x110000 + ord(b) for p in several for a, b in zip(p, p[1:])], dtype=np.int64))
        line = "" if any("\n" in p for p in several) else r"\n"
        within = rf"[^{SPACE}{line}]"
        shape = rf"{SPACE}+{within}*|{within}+" + (rf"|{line}" if line else "")
        if any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in several):
            shape = r"(?s:.+)"
        else:
            runs = {len(p): scores[self.number[p]] for p in several if set(p) == {SPACE}}
            longest = max(runs, default=0)
            mixed = any(p.startswith(SPACE * 2) and set(p) != {SPACE} for p in several)
            # runs of spaces are merged last and from the left: where the longest piece is what as many spaces become, it
            # is what every longer run begins with
            if longest and not mixed and set(runs.values()) == {scores[normal].min()} and self._whole(longest):
                shape = rf"{SPACE}{{{longest}}}(?={SPACE})|" + shape
        self.words = re.compile(shape).findall

    def _whole(self, n: int) -> bool:
        return len(self.merged(np.full(n, self.by_char[ord(SPACE)]), np.zeros(n, dtype=np.int64))[0]) == 1

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, _NONE where no piece is made, and the piece."""
        key = left.astype(np.int64) * PAIR + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], _NONE), self.made[at]

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges. word: the ascending number of each symbol's word.

        Each word merges the pair of least rank first, the leftmost of equal ones. A round merges all pairs of that rank
        in the same result, save those after a merge whose new pair is due before them: they wait for another round.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.of(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((symbols[gone], word[gone]))
                symbols, word, rank, made = symbols[~gone], word[~gone], rank[~gone], made[~gone]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            i = self._taken(symbols, word, rank, made, np.flatnonzero(rank == np.repeat(least, sizes)))
            symbols[i] = made[i]
            stay = np.ones(len(symbols), dtype=bool)
            stay[i + 1] = False
            rank[i] = rank[i + 1]  # no pair where the second symbol was a word's last
            now = np.cumsum(stay)[i] - 1
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            near = np.concatenate([now, now[now > 0] - 1])
            near = near[near + 1 < len(symbols)]
            near = near[word[near] == word[near + 1]]
            rank[now] = _NONE
            rank[near], made[near] = self.of(symbols[near], symbols[near + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _taken(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of the places i of the words' least ranks, those that are merged in this round."""
        new_chain = np.r_[True, i[1:] != i[:-1] + 1]
        place = np.arange(len(i))
        i = i[(place - np.maximum.accumulate(np.where(new_chain, place, 0))) % 2 == 0]  # from left to right, none overlapping
        first = np.r_[True, word[i[1:]] != word[i[:-1]]]
        if first.all():
            return i
        many = ~first | ~np.r_[first[1:], True]  # words with several places
        k = i[many]
        here, at, new = word[k], rank[k], made[k]
        left, right = symbols[np.maximum(k - 1, 0)], symbols[np.minimum(k + 2, len(symbols) - 1)]
        left[1:] = np.where(k[1:] == k[:-1] + 2, new[:-1], left[1:])  # the neighbour has been merged by then
        has_left, has_right = (k > 0) & (word[k - 1] == here), (k + 2 < len(symbols)) & (word[np.minimum(k + 2, len(symbols) - 1)] == here)
        due = (has_left & (self.of(left, new)[0] <= at)) | (has_right & (self.of(new, right)[0] <= at))
        if not due.any():
            return i
        before = np.cumsum(due) - due
        waits = before > before[np.maximum.accumulate(np.where(first[many], np.arange(len(k)), 0))]
        return np.delete(i, np.flatnonzero(many)[waits])

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each ends."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.by_char[points]
        starts = np.zeros(len(points), dtype=bool)
        starts[np.cumsum(sizes) - sizes] = True
        if (sizes > LONG_WORD).any():
            k = np.flatnonzero((sizes > LONG_WORD)[word])
            k = k[k > 0]
            pair = points[k - 1] * 0x110000 + points[k]
            at = np.minimum(np.searchsorted(self.side, pair), len(self.side) - 1)
            starts[k[self.side[at] != pair]] = True
        part = np.cumsum(starts) - 1
        symbols, part_of = self.merged(symbols, part)
        word = word[starts][part_of] if len(part_of) else word[:0]
        lone = np.flatnonzero(symbols >= LONE)
        if len(lone):  # characters without a piece become their bytes
            utf8 = [chr(c).encode() for c in (symbols[lone] - LONE).tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[lone] = [len(b) for b in utf8]
            wide = np.repeat(symbols, times)
            wide[np.repeat(symbols >= LONE, times)] = self.bytes[np.frombuffer(b"".join(utf8), dtype=np.uint8)]
            symbols, word = wide, np.repeat(word, times)
        return symbols.astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words)))

    @property
    def raw(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        of = {UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        return [of[int(k)](p) for p, k in zip(self.pieces, self.kinds, strict=True)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Numbers(dict):
    """Words numbered as they come; new ones are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches, one after another."""
    to = np.cumsum(sizes)
    return np.repeat(starts - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)


class Encoder:
    """Ids of whole texts; keeps the ids of words that it has met."""

    def __init__(self, path: str) -> None:
        self.model = vocabulary(path)
        raw = self.model.raw
        self.raw, self.raw_ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])]
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.ends = _Numbers(), np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and where each text's begin and end."""
        if len(self.numbers) > KEPT_WORDS:
            self._forget()
        find, number, places, counts = self.model.words, self.numbers.__getitem__, [], []
        for t in texts:
            words = find(SPACE + t.decode().replace(" ", SPACE)) if t else ()
            places.extend(map(number, words))
            counts.append(len(words))
        if self.numbers.new:
            ids, ends = self.model.encode_words(self.numbers.new)
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends])
            self.numbers.new = []
        at = np.array(places, dtype=np.int64)
        sizes = self.ends[at + 1] - self.ends[at]
        own = np.add.reduceat(np.r_[sizes, 0], np.cumsum([0, *counts[:-1]])) if len(counts) else np.zeros(0, dtype=np.int64)
        own = np.where(np.array(counts) > 0, own, 0)
        cuts = np.r_[0, np.cumsum(own + 1)]
        out = np.full(cuts[-1], self.model.end, dtype=np.int32)
        held = np.ones(cuts[-1], dtype=bool)
        held[cuts[1:] - 1] = False
        out[held] = self.ids[_spans(self.ends[at], sizes)]
        return out, cuts

    def texts(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The text of each stretch of ids that encode() made: the space before it is taken off."""
        sizes = self.raw_ends[ids + 1] - self.raw_ends[ids]
        ends = np.r_[0, np.cumsum(sizes)][cuts]
        raw = self.raw[_spans(self.raw_ends[ids], sizes)]
        some = np.flatnonzero(ends[1:] > ends[:-1])
        raw = np.delete(raw, ends[some])
        ends = ends - np.r_[0, np.cumsum(ends[1:] > ends[:-1])]
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]).cast(pa.string())


def encode(docs: DataFrame, path: str, *, text: str = "text", out: str = "ids", decoded: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with the ids of each whole text and the end id after them; a null or empty text has the end id alone.

    decoded: a column for the text that the ids decode to. Added columns replace those of the same name; repeated rows
    give repeated results, an empty table an empty one. A very long text is a batch of its own; one without any place
    to cut takes a round over its symbols for every rank that it merges.
    """

    def make():
        encoder = Encoder(path)

        def work(texts: list[bytes | None]) -> Iterable[pa.Array]:
            ids, cuts = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            return [lists] if decoded is None else [lists, encoder.texts(ids, cuts)]

        return work

    return map_rows(docs, [text], f"`{out}` array<int>" + ("" if decoded is None else f", `{decoded}` string"), make, keep)


def text_of(ids: Sequence[int], model: Vocabulary, raw: Sequence[bytes]) -> str:
    """The text of any ids. Bytes that are no UTF-8 become U+FFFD each; the first piece gives up its leading space."""
    if any(not 0 <= i < len(raw) for i in ids):
        raise ValueError("an id is not in the vocabulary")
    out, run, begun = [], bytearray(), False

    def flush() -> None:
        at = 0
        while at < len(run):
            for n in (4, 3, 2, 1):
                try:
                    out.append(run[at : at + n].decode() if at + n <= len(run) and len(run[at : at + n].decode()) == 1 else "")
                except UnicodeDecodeError:
                    continue
                if out[-1]:
                    at += n
                    break
                out.pop()
            else:
                out.append("�")
                at += 1
        run.clear()

    for i in ids:
        if model.kinds[i] == BYTE:
            run += raw[i]
            begun = True
            continue
        flush()
        piece = raw[i].decode()
        if model.kinds[i] != CONTROL:
            piece = piece[1:] if not begun and piece.startswith(" ") and model.kinds[i] == NORMAL else piece
            begun = True
        out.append(piece)
    flush()
    return "".join(out)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with the text of each array of ids; a null array gives an empty text, an unknown id fails the query.

    A column named as `out` is replaced; repeated rows give repeated results, an empty table an empty one.
    """

    def make():
        model = vocabulary(path)
        raw = model.raw
        return lambda rows: [[text_of(r or (), model, raw) for r in rows]]

    return map_rows(docs, [ids], f"`{out}` string", make, keep)
