"""Counts of many literal patterns in one pass: an automaton with failure links, stepped through many stretches at once.

The time depends on the text alone, not on the number of patterns. All texts of a batch are one string, cut into
stretches that overlap by the longest pattern; a step moves every stretch on by one character. Word bounds are looked at
where a pattern is met. A pattern's matches don't overlap: of those that would, the leftmost counts, as in a regular
expression.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import pieces, ship

#: Stretches that are moved on together, about, and the least length of one.
STRETCHES, SHORTEST = 4096, 64
#: Kinds of word characters: letters, marks, digits, letter numbers, connectors; joiners are too.
_WORD = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Me", "Mc", "Nd", "Nl", "Pc"}


@cache
def word_characters() -> np.ndarray:
    """Whether each code point is part of a word, in the Unicode sense."""
    table = np.fromiter((unicodedata.category(chr(c)) in _WORD for c in range(0x110000)), dtype=bool, count=0x110000)
    table[[0x200C, 0x200D]] = True
    return table


@cache
def ascii_word_characters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in map(chr, range(128)) if c.isalnum() or c == "_"]] = True
    return table


class Automaton:
    """patterns: text -> whether its ends must be word bounds (a word character on one side only)."""

    def __init__(self, patterns: Mapping[str, bool], *, unicode_words: bool = True) -> None:
        self.patterns = [p for p in patterns if p]
        self.bounded = np.array([patterns[p] for p in self.patterns], dtype=bool)
        self.lengths = np.array([len(p) for p in self.patterns], dtype=np.int64)
        self.word = word_characters() if unicode_words else ascii_word_characters()
        self.meets_itself = [any(p.endswith(p[:k]) for k in range(1, len(p))) for p in self.patterns]
        letters = sorted({c for p in self.patterns for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        self._build({c: k + 1 for k, c in enumerate(letters)})

    def _build(self, number: dict[str, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(self.patterns):
            at = 0
            for c in p:
                to = children[at].get(number[c])
                if to is None:
                    to = children[at][number[c]] = len(children)
                    children.append({})
                    ends.append([])
                at = to
            ends[at].append(k)
        self.width = len(number) + 1
        step, fail, queue = np.zeros((len(children), self.width), dtype=np.int32), [0] * len(children), deque([0])
        while queue:
            at = queue.popleft()
            step[at] = step[fail[at]] if at else 0
            for c, to in children[at].items():
                fail[to] = int(step[fail[at], c]) if at else 0
                queue.append(to)
                step[at, c] = to
            if at:
                ends[at] = ends[at] + ends[fail[at]]
        self.step = (step * self.width).ravel()  # states are kept as the first place of their row
        self.first = np.cumsum([0, *map(len, ends)])
        self.met = np.array([k for e in ends for k in e], dtype=np.int64)
        self.meets = np.zeros(len(self.step), dtype=bool)
        self.meets[:: self.width] = [bool(e) for e in ends]

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of every place where a pattern stands, word bounds and overlaps aside."""
        if not self.patterns or not len(points):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        size = max(SHORTEST, -(-len(points) // STRETCHES))
        over, count = int(self.lengths.max()) - 1, -(-len(points) // size)
        padded = np.zeros(over + size * count, dtype=np.int32)
        padded[over : over + len(points)] = self.classes[points]
        stretches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, over + size)[::size].T)
        state, found, rows = np.zeros(count, dtype=np.int32), [], []
        for k, letters in enumerate(stretches):
            state = self.step[state + letters]
            if k >= over and len(here := np.flatnonzero(self.meets[state])):
                found.append(here * size + (k - over))
                rows.append(state[here] // self.width)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        end, row = np.concatenate(found), np.concatenate(rows)
        times = self.first[row + 1] - self.first[row]
        to = np.cumsum(times)
        pattern = self.met[np.repeat(self.first[row] - (to - times), times) + np.arange(to[-1])]
        return np.repeat(end, times), pattern

    def count(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, times) in order, for those that are met."""
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("\0".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        end, pattern = self.hits(points)
        begin = end - self.lengths[pattern] + 1
        text = np.searchsorted(starts, end, side="right") - 1
        good = (begin >= starts[text]) & (end < starts[text] + sizes[text] - 1)  # not over the sign between texts
        word = np.r_[False, self.word[points], False]
        ok = (word[begin] != word[begin + 1]) & (word[end + 1] != word[end + 2])
        good &= ok | ~self.bounded[pattern]
        text, pattern, begin = text[good], pattern[good], begin[good]
        order = np.lexsort((begin, pattern, text))
        text, pattern, begin = text[order], pattern[order], begin[order]
        own = np.asarray(self.meets_itself, dtype=bool)[pattern] if len(pattern) else np.zeros(0, dtype=bool)
        if own.any():
            keep, free, last = np.ones(len(own), dtype=bool), 0, None
            for i in np.flatnonzero(own).tolist():  # only patterns that can overlap themselves
                key = (text[i], pattern[i])
                keep[i] = key != last or begin[i] >= free
                if keep[i]:
                    last, free = key, begin[i] + self.lengths[pattern[i]]
            text, pattern = text[keep], pattern[keep]
        key = text * max(len(self.patterns), 1) + pattern
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        return text[at], pattern[at], np.diff(np.r_[at, len(key)])


def literal_counts(docs: DataFrame, groups: Mapping[str, Sequence[str]], *, text: str = "text", bounded: Mapping[str, bool] | bool = False, unicode_words: bool = True, out: str = "counts") -> DataFrame:
    """docs with out: array<struct<g, n>>, for each group (by its place) the sum of its patterns' counts, if it is not 0.

    A pattern that a group names twice counts twice. bounded: whether patterns stand between word bounds, for all or by
    pattern. The automaton is sent to the tasks; its size is that of the patterns. A null text has no counts.
    """
    ship(docs.sparkSession)
    every = sorted({p for ps in groups.values() for p in ps if p})
    automaton = Automaton({p: bounded if isinstance(bounded, bool) else bounded[p] for p in every}, unicode_words=unicode_words)
    place = {p: i for i, p in enumerate(automaton.patterns)}
    owners = [(place[p], g) for g, ps in enumerate(groups.values()) for p in ps if p]
    pattern_of, group_of = (np.array(x, dtype=np.int64) for x in (zip(*sorted(owners), strict=True) if owners else ((), ())))
    first = np.searchsorted(pattern_of, np.arange(len(every) + 1))
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    kept = [f for f in docs.schema.fields if f.name != out]
    names, width = [*(f.name for f in kept), out], max(len(groups), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, pattern, n = sent.value.count(b.column(b.num_columns - 1).to_pylist())
            times = first[pattern + 1] - first[pattern]
            to = np.cumsum(times)
            group = group_of[np.repeat(first[pattern] - (to - times), times) + np.arange(to[-1] if len(to) else 0)]
            key, inverse = np.unique(np.repeat(row, times) * width + group, return_inverse=True)
            sums = np.bincount(inverse, weights=np.repeat(n, times), minlength=len(key)).astype(np.int32)
            offsets = np.searchsorted(key, np.arange(b.num_rows + 1) * width)
            entries = pa.StructArray.from_arrays([pa.array((key % width).astype(np.int32)), pa.array(sums)], names=["g", "n"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], names=names)

    shape = T.StructType([*kept, *T.StructType.fromDDL(f"`{out}` array<struct<g: int, n: int>>").fields])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("__text")).mapInArrow(run, shape)


def count_of(group: int | Column, counts: str = "counts") -> Column:
    """The count of a group as a column, 0 if it is not met."""
    return F.coalesce(F.get(F.filter(counts, lambda x: x["g"] == group), F.lit(0))["n"], F.lit(0))
