"""Byte-level BPE by corpus-level merge replay.

Spark counts the distinct pre-tokens of all texts. Those that come again, the most frequent first up to a table of
bounded size, are replayed once for the whole corpus, each hash partition of the counts on its own, and the table of
their ids is sent to the tasks. Of the others a task replays those that it meets, block by block and in the same way.

A replay has all its pre-tokens in one array of symbols. An index from ranges of merge ranks to the positions of their
pairs is worked off in rank order, in each turn all positions whose rank is the least of their word; a merge touches
only the two neighbours of its position, whose new pairs enter the index. In long pre-tokens a range is one rank.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.characters import splitter
from ledgerline.llm.common import counted_memory, limit_batches, shared

#: Pre-tokens that a worker keeps, the corpus's table among them; beyond it starts anew, which costs time but changes no result.
KEPT_WORDS = 200_000
#: Pre-tokens in the corpus's table, and bytes of one, at most.
TABLE_WORDS, TABLE_BYTES = 100_000, 64
#: Distinct pre-tokens that a task counts before it hands them on.
COUNTED_WORDS = 300_000
#: Bytes of text whose new pre-tokens are replayed together.
BLOCK_BYTES = 8 << 20
#: Ranks in a range of the index for short words; bytes of the longest of these, its mark included.
RANGE, LONG_WORD = 1024, 128
#: Room for ids in a pair's key.
PAIR = 1 << 24
_NONE = np.int32((1 << 31) - 1)


class Merges:
    """Pairs of symbols with their ranks, and the symbol that a rank makes."""

    def __init__(self, ranks: dict[int, int], made: Sequence[int]) -> None:
        """ranks: left id * PAIR + right id -> rank. The pairs of one rank make the same symbol, which is in none of them."""
        order = np.argsort(keys := np.fromiter(ranks, dtype=np.int64, count=len(ranks)))
        self.keys, self.ranks = keys[order], np.fromiter(ranks.values(), dtype=np.int32, count=len(ranks))[order]
        self.made = made

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no merge; the marks -1 and -2 are in none."""
        key = left.astype(np.int64) * PAIR + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def replay(symbols: np.ndarray, merges: Merges, width: int = 1) -> np.ndarray:
    """The symbols after all merges; a -1 stands after each word and stays.

    In each word the pair of least rank is merged first, the leftmost of equal ones; words don't touch each other. The
    index holds positions by ranges of ranks of the given width. Of the lowest range every word takes its own least rank
    at once, so that a wide range saves turns where words are many and short; a narrow one suits long words, whose other
    positions in the range are looked at again in every turn.
    """
    n = len(symbols)
    symbols = np.concatenate([symbols, [-1, -1]]).astype(np.int32)
    after, before = np.arange(1, n + 3, dtype=np.int32), np.arange(-1, n + 1, dtype=np.int32)
    word = np.cumsum(symbols == -1, dtype=np.int32)
    made = np.asarray(merges.made, dtype=np.int32)
    rank_at = np.full(n + 2, _NONE)
    for low in range(0, n, 1 << 18):
        high = min(n, low + (1 << 18))
        rank_at[low:high] = merges.of(symbols[low:high], symbols[low + 1 : high + 1])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(ranks: np.ndarray, places: np.ndarray) -> None:
        ranges = ranks // width
        order = np.argsort(ranges, kind="stable")
        ranges, places = ranges[order], places[order]
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
        for k, r in enumerate(ranges[cuts[:-1]].tolist()):
            part = places[cuts[k] : cuts[k + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(queue, r)

    def in_turn(i: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of each word's rank, those that it takes from left to right, and those to be looked at again.

        A place overlapped by the one before it is not taken. All after a place whose merge makes a pair of lower rank wait.
        """
        every = i
        chained = np.r_[False, after[i[:-1]] == i[1:]]
        starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
        taken = (np.arange(len(i)) - starts) % 2 == 0
        i, ranks = i[taken], ranks[taken]
        new = made[ranks]
        left, right = symbols[before[i]], symbols[after[after[i]]]
        touching = after[after[i[:-1]]] == i[1:]
        left[1:][touching] = new[:-1][touching]  # the neighbour has been merged by then
        lower = (merges.of(left, new) < ranks) | (merges.of(new, right) < ranks)
        if not lower.any():
            return i, i[:0]
        of = word[i]
        first = np.r_[True, of[1:] != of[:-1]]
        so_far = np.cumsum(lower) - lower
        waits = so_far > so_far[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
        return i[~waits], np.setdiff1d(every, i[~waits], assume_unique=True)

    live = np.flatnonzero(rank_at < _NONE).astype(np.int32)
    if len(live):
        enter(rank_at[live], live)
    while queue:
        lowest = heapq.heappop(queue)
        parts = index.pop(lowest)
        i = parts[0] if len(parts) == 1 else np.concatenate(parts)
        i = i[rank_at[i] // width == lowest]
        if not len(i):
            continue
        if len(parts) > 1:  # runs in order, which this sort merges
            i.sort(kind="stable")
            i = i[np.r_[True, i[1:] != i[:-1]]]
        ranks = rank_at[i]
        of = word[i]
        begins = np.r_[True, of[1:] != of[:-1]]
        later = []
        if not begins.all():
            starts = np.flatnonzero(begins)
            least = np.minimum.reduceat(ranks, starts)[np.cumsum(begins) - 1] == ranks
            if not least.all():
                later.append(i[~least])
                i, ranks, of = i[least], ranks[least], of[least]
            if (of[1:] == of[:-1]).any():
                i, waiting = in_turn(i, ranks)
                ranks = rank_at[i]
                if len(waiting):
                    later.append(waiting)
        if later:
            index[lowest] = later
            heapq.heappush(queue, lowest)
        j = after[i]
        far = after[j]
        symbols[i], symbols[j] = made[ranks], -2
        rank_at[j] = _NONE
        after[i], before[far] = far, i
        touched = np.stack([before[i], i], axis=1).ravel()  # in order: between two of i there is no symbol before the first
        touched = touched[np.r_[touched[0] >= 0, touched[1:] != touched[:-1]]]
        ranks = merges.of(symbols[touched], symbols[after[touched]])
        rank_at[touched] = ranks
        live = np.flatnonzero(ranks < _NONE)
        if len(live):
            enter(ranks[live], touched[live])
    symbols = symbols[:n]
    return symbols[symbols != -2]


def symbols_of(words: list[bytes], byte_ids: Sequence[int]) -> np.ndarray:
    """The ids of the words' bytes with a -1 after each word. A byte FF is in no UTF-8 text."""
    table = np.array(byte_ids, dtype=np.int64)
    table[0xFF] = -1
    return table[np.frombuffer(b"\xff".join([*words, b""]), dtype=np.uint8)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens with ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def rank_table(path: str) -> tuple[Merges, list[int]]:
    """Of a file of ranks: the merges and the id of each byte. Any two tokens whose bytes together are a token merge at its rank."""
    ranks = read_ranks(path)
    merges = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                merges[a * PAIR + b] = rank
    return Merges(merges, range(max(ranks.values()) + 1)), [ranks[bytes([b])] for b in range(256)]


@cache
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, and where each id's begin, with one end more; an unused id has none."""
    tokens = {r: t for t, r in read_ranks(path).items()}
    every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(every), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in every])]


def replayed(words: list[bytes], merges: Merges, byte_ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and where each word's end."""
    symbols = symbols_of(words, byte_ids)
    sizes = np.diff(np.flatnonzero(symbols == -1), prepend=-1)
    long = np.repeat(sizes > LONG_WORD, sizes)
    if long.any():  # short words in wide ranges of ranks, long ones rank by rank
        out, order = zip(*((replay(symbols[x], merges, width), np.flatnonzero((sizes > LONG_WORD) == w)) for x, width, w in ((~long, RANGE, False), (long, 1, True))), strict=True)
        found = np.concatenate(out)
        marks = np.flatnonzero(found == -1)
        order = np.argsort(np.concatenate(order), kind="stable")
        begins, sizes = np.r_[0, marks[:-1] + 1][order], np.diff(marks, prepend=-1)[order]
        to = np.cumsum(sizes) - sizes
        out = found[np.repeat(begins - to, sizes) + np.arange(sizes.sum())]
    else:
        out = replay(symbols, merges, RANGE)
    marks = np.flatnonzero(out == -1)
    return out[out >= 0].astype(np.int32), marks - np.arange(len(marks))


@dataclass
class Table:
    """Pre-tokens with FF after each, their ids one after another, and where each one's begin, with one end more."""

    words: bytes = b""
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))


def counted(docs: DataFrame, pattern: str, *, text: str = "text") -> DataFrame:
    """(word, n): every distinct pre-token of all texts, in the shared folder, each in one partition by its hash."""
    limit_batches(docs.sparkSession)

    def rows(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            split, counts = splitter(pattern), Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    if t:
                        counts.update(split(t))
                if len(counts) > COUNTED_WORDS:
                    yield rows(counts)
                    counts.clear()
            yield rows(counts)
            counts = None

    return shared(docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def corpus_table(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text") -> Table:
    """The ids of the most frequent pre-tokens of the whole corpus, TABLE_WORDS of them at most, replayed by Spark.

    One that comes once is not in it, nor one of more than TABLE_BYTES bytes: at most 30 MB reach the driver.
    """
    counts = counted(docs, pattern, text=text).where((F.col("n") > 1) & (F.octet_length("word") <= TABLE_BYTES))
    level = F.floor(F.log2("n") * 8)  # some hundreds of them, whatever the corpus
    least, taken = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if (taken := taken + r["count"]) > TABLE_WORDS:
            break
        least = r.level
    if least is None:
        return Table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            if words := [w for b in batches for w in b.column(0).to_pylist()]:
                ids, ends = replayed(words, *rank_table(ranks_path))
                row = (b"\xff".join([*words, b""]), ids.tobytes(), np.diff(ends, prepend=0).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["words", "ids", "sizes"])

    found = counts.where(level >= least).select(F.col("word").cast("binary")).mapInArrow(run, "words binary, ids binary, sizes binary").collect()
    sizes = np.frombuffer(b"".join(r.sizes for r in found), dtype=np.int64)
    return Table(b"".join(r.words for r in found), np.frombuffer(b"".join(r.ids for r in found), dtype=np.int32), np.r_[0, np.cumsum(sizes)])


class Numbered:
    """Numbers words in the order in which they first come, after those given."""

    def __init__(self, words: Sequence[str] = ()) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))

    def of(self, words: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=n)

    def since(self, first: int) -> list[str]:
        return list(islice(self.numbers, first, None))


class Encoder:
    """Encodes texts block by block; keeps the ids of the pre-tokens that it has met."""

    def __init__(self, ranks_path: str, pattern: str, table: Table | None = None) -> None:
        self.merges, self.byte_ids = rank_table(ranks_path)
        self.split, self.table = splitter(pattern), table or Table()
        self._forget()

    def _forget(self) -> None:
        """Goes back to the corpus's table."""
        self.words = Numbered([w.decode() for w in self.table.words.split(b"\xff")[:-1]])
        self.ids, self.ends = self.table.ids, self.table.ends

    def _learn(self) -> None:
        new = self.words.since(len(self.ends) - 1)
        if new:
            ids, ends = replayed([w.encode() for w in new], self.merges, self.byte_ids)
            self.ends = np.concatenate([self.ends, len(self.ids) + ends])
            self.ids = np.concatenate([self.ids, ids])

    def encode(self, blocks: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts all ids, and where each text's begin, with one end more."""
        if len(self.words.numbers) > KEPT_WORDS:
            self._forget()
        numbered = []
        for texts in blocks:
            codes = []
            for t in texts:  # one text's pre-tokens at a time
                words = self.split(t) if t else []
                codes.append(self.words.of(words, len(words)))
            numbered.append((np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32), np.array([len(c) for c in codes], dtype=np.int64)))
        self._learn()
        for codes, n in numbered:
            starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
            to = np.r_[0, np.cumsum(sizes)]
            ids = self.ids[np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])]
            yield ids, to[np.r_[0, np.cumsum(n)]]


def _bytes_of(raw: np.ndarray, ends: np.ndarray, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids, of which raw and ends are the byte_table()."""
    own = np.asarray(lists.flatten())
    if len(own) and (own.min() < 0 or own.max() >= len(ends) - 1 or (ends[own + 1] == ends[own]).any()):
        raise ValueError("an id is not in the vocabulary")
    sizes = ends[own + 1] - ends[own]
    to = np.r_[0, np.cumsum(sizes)]
    text = raw[np.repeat(ends[own] - to[:-1], sizes) + np.arange(to[-1])]
    cuts = to[np.r_[0, np.cumsum(lists.value_lengths())]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts), pa.py_buffer(text)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", out: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with the ids of each whole text: an array of ints, empty for a null or empty text.

    Each match of pattern is encoded by itself, without special tokens. docs is read twice: for the corpus's table of
    pre-tokens, when this is called, and for the ids. decoded: a column for the bytes that the ids decode to. Columns of these names are replaced; repeated rows give repeated results, an empty
    table an empty one. A very long text is one block of its own; time grows with its length, not faster.
    """
    limit_batches(docs.sparkSession)
    added = [out] if decoded is None else [out, decoded]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in added} and (keep is None or f.name in keep)]
    names = [f.name for f in kept] + added
    sent = docs.sparkSession.sparkContext.broadcast(corpus_table(docs, ranks_path, pattern, text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = Encoder(ranks_path, pattern, sent.value), [], 0
        table = decoded and byte_table(ranks_path)

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [b.column(len(kept)).to_pylist() for b in held]
            for b, (ids, ends) in zip(held, encoder.encode(texts), strict=True):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                made = [_bytes_of(*table, lists)] if table else []
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), lists, *made], names=names)

        with counted_memory():
            for b in batches:
                held.append(b)
                size += b.column(len(kept)).nbytes
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
            yield from flush()
            encoder = held = None

    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, *, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """docs with the bytes of each array of ids; a null array gives no bytes, an unknown id fails the query.

    A column of the name `out` is replaced; an empty table gives an empty one; each row is decoded alone.
    """
    limit_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower() and (keep is None or f.name in keep)]
    names = [f.name for f in kept] + [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks_path)
        for b in batches:
            made = _bytes_of(*table, b.column(len(kept)).fill_null([]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), made], names=names)

    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
