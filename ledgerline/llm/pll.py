"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the two tokens before and the two after it, itself left out. The vocabulary is the most
frequent words and hashed buckets of the others. The network gives the probability of the token's class and that of the
id within its class, both from the context and both with an exact normaliser; only a word within its bucket has its
share of the bucket's count. So the conditional probabilities of all distinct words at a place sum to 1. A document's
score is the sum of its tokens' conditional log-probabilities.

Vocabulary and classes grow with the distinct words. The counts of the words in buckets never leave Spark: they are
joined to the words of each document, save those of the KNOWN most frequent of them, which are looked up where words are
numbered. Texts are cut into words twice, to count them and to number them; training and scoring read the numbers.

The network is trained in numpy on every window, in rounds: every task works out the gradient of its part of the
round's windows, Spark sums the gradients, and one step is made of the sum. The scores are the same, rounding apart,
however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import counted_memory, cut, limit_batches, map_rows, shared, words_of
from ledgerline.llm.sums import ROWS, blocks, summed

#: Words with ids of their own and classes, at least; GROWTH times the root of the number of distinct words if that is more.
WORDS, BUCKETS, CLASSES, DIM, HIDDEN, GROWTH = 4096, 512, 64, 16, 16, 8
#: The token that stands beyond both ends of a text; words after the first WORDS have the ids after it.
EDGE = WORDS + BUCKETS
WINDOW = (-2, -1, 1, 2)
#: A bias whose power of e is 0, and stays it; the largest logit.
NEVER, MOST = -1e4, 70
TINY = np.finfo(np.float32).tiny
#: Rows whose classes are worked out at once: their logits stay in the processor's cache.
ROWS_AT_ONCE = 512
#: Rounds of a pass over all windows; windows whose gradient is worked out at once.
ROUNDS, WINDOWS = 15, 1 << 14
#: Words in buckets whose counts are sent to the tasks, at most, and their bytes; all others' are joined.
KNOWN, KNOWN_BYTES = 100_000, 64
#: Bytes of words that are counted at once.
COUNTED_BYTES = 32 << 20
#: Tasks whose sums are added up at once.
TOGETHER = 64


@dataclass
class Vocabulary:
    """Ids of frequent words; of every id its class and its place among the ids in order of class; tokens in each bucket."""

    words: dict[bytes, int]
    kind: np.ndarray
    place: np.ndarray
    #: Of the ids in order of class: where each class begins, with one end more.
    starts: np.ndarray
    #: Logarithms of the counts of classes and of ids in order of class, NEVER for those that no text has.
    prior: tuple[np.ndarray, np.ndarray]
    buckets: np.ndarray
    #: The most frequent words in buckets, the logarithms of their counts, and their ids.
    known: tuple[pa.Array, np.ndarray, np.ndarray] | None = None

    @property
    def shapes(self) -> tuple[tuple[int, ...], ...]:
        return shapes(len(self.kind), len(self.starts) - 1)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The ids of words in order, and those of them that are in buckets."""
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(ids < 0)
        rare = [words[i] for i in at.tolist()]
        ids[at] = buckets_of(rare)
        return ids, rare

    def ids(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens with two EDGEs after each text and before the first, and how many tokens each text has."""
        edge = np.full(2, EDGE)
        found = [self.ids_of(words_of(t))[0] for t in texts]
        return np.concatenate([edge, *(x for ids in found for x in (ids, edge))]), np.array([len(ids) for ids in found], dtype=np.int64)


def counted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n): every distinct word of all documents, in the shared folder."""
    limit_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.large_binary()))
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

        with counted_memory():
            held, size = [], 0
            for b in batches:
                words, _ = cut(b.column(0).to_pylist())
                held.append(words)
                size += words.nbytes
                if size > COUNTED_BYTES:
                    yield rows()
                    held, size = [], 0
            yield rows()
            held = None

    made = docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return shared(made)


def vocabulary(docs: DataFrame, *, text: str = "text", counts: DataFrame | None = None) -> Vocabulary:
    """From the counts of every word of every document; the frequent words, KNOWN more with their counts, the buckets' totals and how many words have each count reach the driver."""
    counts = counted(docs, text=text) if counts is None else counts
    sizes = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    most, taken, least = max(WORDS, int(GROWTH * sum(k for _, k in sizes) ** 0.5)), 0, sizes[0][0] + 1 if sizes else 1
    for c, k in sizes:
        if (taken := taken + k) > most:
            break
        least = c
    top = sorted(((bytes(r.word), r.n) for r in counts.where(F.col("n") >= least).collect()), key=lambda r: (-r[1], r[0]))
    rare = counts.where(F.col("n") < least).groupBy((F.crc32("word") % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    words = {w: i if i < WORDS else i + BUCKETS + 1 for i, (w, _) in enumerate(top)}
    n, buckets = np.zeros(max(EDGE + 1, len(top) + BUCKETS + 1)), np.zeros(BUCKETS)
    n[list(words.values())] = [c for _, c in top]
    for r in rare.collect():
        n[WORDS + r.bucket] = buckets[r.bucket] = r.n
    # the most frequent words have classes of their own; by roots of counts the others' classes are small where words are
    # rare: of all divisions of this kind it has about the fewest logits to work out for a token
    classes = int(CLASSES * (len(n) / (EDGE + 1)) ** 0.5)
    kind = np.empty(len(n), dtype=np.int64)
    order, alone = np.argsort(-n, kind="stable"), classes // 8
    kind[order[:alone]] = np.arange(alone)
    tail = np.cumsum(np.sqrt(n[order[alone:]]))
    kind[order[alone:]] = alone + np.minimum((tail - tail[0]) * (classes - alone) // max(tail[-1], 1), classes - alone - 1).astype(np.int64)
    by = np.argsort(kind, kind="stable")
    place = np.empty(len(n), dtype=np.int64)
    place[by] = np.arange(len(n))
    held = np.bincount(kind, n, minlength=classes)
    prior = tuple(np.where(x > 0, np.log(np.maximum(x, 1) / max(n.sum(), 1)), NEVER) for x in (held, n[by]))
    below, more = least, 0
    for c, k in sizes:
        if c < least:
            if (more := more + k) > KNOWN:
                break
            below = c
    known = counts.where((F.col("n") >= below) & (F.col("n") < least) & (F.octet_length("word") <= KNOWN_BYTES)).select("word", "n").toArrow()
    known = known["word"].cast(pa.large_binary()).combine_chunks(), np.log(known["n"].to_numpy()), buckets_of(known["word"].to_pylist())
    return Vocabulary(words, kind, place, np.searchsorted(kind[by], np.arange(classes + 1)), prior, buckets, known)


def shapes(ids: int, classes: int) -> tuple[tuple[int, ...], ...]:
    """Vectors of the ids around, the hidden layer, the classes, and the ids within their classes; the last two with biases."""
    return ((ids, DIM), (len(WINDOW) * DIM, HIDDEN), (HIDDEN,), (HIDDEN + 1, classes), (ids, HIDDEN + 1))


SHAPES = shapes(EDGE + 1, CLASSES)


def unpacked(flat: np.ndarray, like: tuple[tuple[int, ...], ...] = SHAPES) -> list[np.ndarray]:
    out, at = [], 0
    for s in like:
        k = int(np.prod(s))
        out.append(flat[at : at + k].reshape(s).astype(np.float32))
        at += k
    return out


def initial(like: tuple[tuple[int, ...], ...] = SHAPES, prior: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Parameters before the first step. prior: biases of classes and of ids, which then begin with the corpus counts."""
    rng = np.random.default_rng(2)
    scale = (0.3, 1 / np.sqrt(like[1][0]), 0, 1 / np.sqrt(HIDDEN), 0)
    parts = [rng.normal(0, x, s) if x else np.zeros(s) for x, s in zip(scale, like, strict=True)]
    parts[3][HIDDEN], parts[4][:, HIDDEN] = (0, 0) if prior is None else prior
    return np.concatenate([x.ravel() for x in parts])


def powers(logit: np.ndarray, high: bool) -> np.ndarray:
    """Powers of e of logits, in place. No logit counts for more than MOST; high: whether one may be above it."""
    if high:
        np.minimum(logit, MOST, out=logit)
    return np.exp(logit, out=logit)


def may_be_high(weights: np.ndarray) -> bool:
    """Whether a logit of the weights (a row for each of the hidden layer, the last for the biases) may be above MOST."""
    return bool((np.abs(weights[:HIDDEN]).sum(axis=0) + weights[HIDDEN]).max() > MOST - 1)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of small numbers, and where runs of equal ones begin in it, with one end more."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    own = keys[order]
    return order, np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]).tolist() if len(keys) else [0]


def tables_of(p: list[np.ndarray]) -> list[np.ndarray]:
    """For each place around a token what an id there adds to the hidden layer, the first with the layer's bias."""
    emb, w1, b1, _, _ = p
    out = [emb @ w1[k * DIM : (k + 1) * DIM] for k in range(len(WINDOW))]
    out[0] += b1
    return out


class Forward:
    """The network on many windows at once, a column a window: what is done to each number runs along the columns.

    All arrays of a window's size are made once and written again: an array made anew for every few windows costs more in
    pages taken from the system than what is worked out in it.
    """

    def __init__(self, p: list[np.ndarray], v: Vocabulary, windows: int = WINDOWS) -> None:
        _, _, _, w2, self.u = self.p = p
        self.v, self.tables, self.starts = v, tables_of(p), v.starts.tolist()
        self.w2 = np.ascontiguousarray(w2.T)
        self.high = may_be_high(w2), may_be_high(self.u.T)
        kind = w2.dtype
        self.h_all, self.count = np.ones((HIDDEN + 1) * windows, dtype=kind), np.arange(ROWS_AT_ONCE)
        self.rows = np.empty((2, ROWS_AT_ONCE, HIDDEN), dtype=kind)
        self.logits = np.empty(max(w2.shape[1], int(np.diff(v.starts).max(initial=1))) * ROWS_AT_ONCE, dtype=kind)

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        """The hidden layer and a last row of ones, which meets the biases; around: for each place the ids there."""
        n = len(around[0])
        h = self.h_all[: (HIDDEN + 1) * n].reshape(HIDDEN + 1, n)
        h[HIDDEN] = 1
        for a in range(0, n, ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, n)
            x, more = self.rows[:, : b - a]
            np.take(self.tables[0], around[0][a:b], axis=0, out=x, mode="clip")
            for t, i in zip(self.tables[1:], around[1:], strict=True):
                x += np.take(t, i[a:b], axis=0, out=more, mode="clip")
            h[:HIDDEN, a:b] = np.tanh(x, out=x).T
        return h

    def times(self, weights: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Logits, a row for each of the weights."""
        out = self.logits[: len(weights) * h.shape[1]].reshape(len(weights), h.shape[1])
        return np.matmul(weights, h, out=out)

    def classes(self, kind: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Stretches of windows, at most ROWS_AT_ONCE, whose targets are of one class of several ids: begin, end, class."""
        cuts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True]).tolist() if len(kind) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(kind[a])
            if self.starts[k + 1] - self.starts[k] > 1:
                for low in range(a, b, ROWS_AT_ONCE):
                    yield low, min(low + ROWS_AT_ONCE, b), k


class Gradient(Forward):
    """The gradient of the log-probabilities of many windows, less sign.

    What the ids around add to the hidden layer is looked up in tables; the gradient is gathered by rows of the tables,
    and that of the vectors and of the layer before follows from it once, in parts().
    """

    def __init__(self, p: list[np.ndarray], v: Vocabulary) -> None:
        super().__init__(p, v)
        w2, u, sizes = p[3], self.u, np.diff(v.starts)
        self.back2, self.back_u = (np.ascontiguousarray(x[:HIDDEN]) for x in (w2, u.T))
        self.several, self.class_of = np.repeat(sizes > 1, sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.weights = -(self.back2[:, self.class_of] + self.back_u * self.several)
        self.to_tables = [np.zeros((HIDDEN, len(u))) for _ in WINDOW]
        self.to_w2, self.to_u, self.to_own = np.zeros(w2.shape), np.zeros(u.shape), np.zeros(u.T.shape)
        self.back_all, self.each_all = np.empty(HIDDEN * WINDOWS, dtype=w2.dtype), np.empty(ROWS_AT_ONCE, dtype=w2.dtype)
        self.found_all, self.scaled_all = np.empty(HIDDEN * ROWS_AT_ONCE, dtype=w2.dtype), np.empty((HIDDEN + 1) * ROWS_AT_ONCE, dtype=w2.dtype)
        self.column, self.slope = np.empty(WINDOWS), np.empty(WINDOWS, dtype=w2.dtype)

    def stretch(self, own: np.ndarray, weights: np.ndarray, back_weights: np.ndarray, high: bool, back: np.ndarray) -> np.ndarray:
        """Of some windows: adds the mean of the weights, by probability, to back; what the logits' probabilities add to the weights."""
        n = own.shape[1]
        g = powers(self.times(weights, own), high)
        each = np.add.reduce(g, axis=0, out=self.each_all[:n])
        each += TINY
        np.divide(1, each, out=each)
        found = np.matmul(back_weights, g, out=self.found_all[: HIDDEN * n].reshape(HIDDEN, n))
        found *= each
        back += found
        return g @ np.multiply(own, each, out=self.scaled_all[: (HIDDEN + 1) * n].reshape(HIDDEN + 1, n)).T

    def add(self, around: list[np.ndarray], target: np.ndarray) -> None:
        """around: for each place of WINDOW the ids there; target: the ids in the middles."""
        for k in range(0, len(target), WINDOWS):
            self.add_some([x[k : k + WINDOWS] for x in around], target[k : k + WINDOWS])

    def add_some(self, around: list[np.ndarray], target: np.ndarray) -> None:
        order, cuts = in_order(self.v.place[target])  # the tokens of a class stand together
        around, places = [x[order] for x in around], self.v.place[target[order]]
        n, h = len(places), self.hidden(around)
        back = np.take(self.weights, places, axis=1, out=self.back_all[: HIDDEN * n].reshape(HIDDEN, n), mode="clip")
        to_w2 = np.zeros_like(self.w2)
        for a in range(0, n, ROWS_AT_ONCE):
            here = slice(a, min(a + ROWS_AT_ONCE, n))
            to_w2 += self.stretch(h[:, here], self.w2, self.back2, self.high[0], back[:, here])
        self.to_w2 += to_w2.T
        for a, b, k in self.classes(self.class_of[places]):
            ids = slice(self.starts[k], self.starts[k + 1])
            self.to_u[ids] += self.stretch(h[:, a:b], self.u[ids], self.back_u[:, ids], self.high[1], back[:, a:b])
        # the targets' own logits: sums of the hidden layer over the windows of each
        self.to_own[:, places[cuts[:-1]]] += np.add.reduceat(h, cuts[:-1], axis=1)
        for i in range(HIDDEN):
            slope, column = np.multiply(h[i], h[i], out=self.slope[:n]), self.column[:n]
            np.subtract(1, slope, out=slope)
            np.multiply(slope, back[i], out=column)
            for to, ids in zip(self.to_tables, around, strict=True):
                to[i] += np.bincount(ids, column, minlength=to.shape[1])

    def parts(self) -> list[np.ndarray]:
        """In the order of shapes()."""
        emb, w1 = self.p[:2]
        to_emb = sum(t.T @ w1[k * DIM : (k + 1) * DIM].T for k, t in enumerate(self.to_tables))
        own = [np.bincount(self.class_of, x, minlength=self.to_w2.shape[1]) for x in self.to_own]
        return [to_emb, np.concatenate([(t @ emb).T for t in self.to_tables]), self.to_tables[0].sum(axis=1), self.to_w2 - own, self.to_u - self.to_own.T * self.several[:, None]]


def gradient(p: list[np.ndarray], v: Vocabulary, around: np.ndarray, target: np.ndarray, into: list[np.ndarray]) -> None:
    """Adds the gradient of the windows' log-probabilities, less sign, to `into`; target: the ids in their middles."""
    g = Gradient(p, v)
    g.add(list(around.T), target)
    for x, y in zip(into, g.parts(), strict=True):
        x += y


def numbered(docs: DataFrame, vocab: Broadcast, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, in the shared folder, with n_words, __ids (the ids of the words, packed), __known (the sum of the logarithms of
    the counts of the known words in buckets) and __rare (the other words in buckets)."""

    def make():
        v = vocab.value
        size = np.uint16 if len(v.kind) < 1 << 16 else np.uint32
        known, logs, places = v.known or (pa.array([], pa.large_binary()), np.zeros(0), np.zeros(0, dtype=np.int64))
        look = pa.concat_arrays([pa.array(list(v.words), pa.large_binary()), known])
        # with a last place, which words that aren't found have
        id_of = np.concatenate([np.fromiter(v.words.values(), dtype=np.int64, count=len(v.words)), places, [0]])
        log_of = np.concatenate([np.zeros(len(v.words)), logs, [0]])

        def work(texts):
            words, n = cut(texts)
            place = pc.index_in(words, look).fill_null(len(look)).to_numpy()
            at, text_of = np.flatnonzero(place == len(look)), np.repeat(np.arange(len(n)), n)
            rare, ids = words.take(pa.array(at)).to_pylist(), id_of[place]
            ids[at] = buckets_of(rare)
            packed, ends = ids.astype(size).tobytes(), (np.cumsum(n) * np.dtype(size).itemsize).tolist()
            ends_of_rare = np.cumsum(np.bincount(text_of[at], minlength=len(n))).tolist()
            return (
                pa.array(n),
                [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)],
                [rare[a:b] for a, b in zip([0, *ends_of_rare[:-1]], ends_of_rare, strict=True)],
                pa.array(np.bincount(text_of, log_of[place], minlength=len(n))),
            )

        return work

    return shared(map_rows(docs, [text], "n_words bigint, __ids binary, __rare array<binary>, __known double", make, keep))


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The ids of words in buckets."""
    return WORDS + np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % BUCKETS


def edged(packed: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As Vocabulary.ids(), of the ids of numbered() and of their kind."""
    size = np.dtype(np.uint16 if len(v.kind) < 1 << 16 else np.uint32)
    edge = np.full(2, EDGE, dtype=size).tobytes()
    return np.frombuffer(edge + edge.join([*packed, b""]), dtype=size), np.array([len(x) // size.itemsize for x in packed], dtype=np.int64)


def batched(ids: DataFrame, vocab: Broadcast) -> DataFrame:
    """The ids of numbered() documents in the shared folder, a row a batch: the rounds read them alone, without the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = edged(b.column(0).to_pylist(), vocab.value)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own, n)], names=["ids", "n"])

    return shared(ids.select("__ids").mapInArrow(pack, "ids binary, n binary"))


def every(n: np.ndarray, rounds: int, turn: int) -> np.ndarray:
    """Where in ids with EDGEs every rounds-th token of each text stands, the turn-th first; n: the texts' tokens."""
    taken = np.maximum(n - turn + rounds - 1, 0) // rounds
    first = 2 + turn + np.cumsum(n + 2) - (n + 2)
    return np.repeat(first - rounds * (np.cumsum(taken) - taken), taken) + rounds * np.arange(taken.sum())


def train(ids: DataFrame, vocab: Broadcast, *, rounds: int = ROUNDS, passes: int = 1, rate: float = 0.15) -> np.ndarray:
    """Parameters of the network, from numbered() documents.

    Each round takes every rounds-th window of each text, so that a pass takes every window once; Spark sums the tasks'
    gradients, and the driver makes one step with moments of the sums (Adam). What is learnt therefore depends on no
    division of the corpus into tasks, but for the rounding of sums.
    """
    like = vocab.value.shapes
    flat = initial(like, vocab.value.prior)
    first, second = np.zeros(len(flat)), np.zeros(len(flat))
    # as many tasks as there are cores, each over several partitions: what is shuffled is an array a task
    tasks = ids.sparkSession.sparkContext.defaultParallelism
    lanes, fed = -(-tasks // TOGETHER), batched(ids, vocab).coalesce(tasks)
    for r in range(steps := rounds * passes):
        sent = ids.sparkSession.sparkContext.broadcast(flat.astype(np.float32))

        def part(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, turn: int = r % rounds) -> Iterator[pa.RecordBatch]:
            with counted_memory():
                found, seen = Gradient(unpacked(sent.value, like), vocab.value), 0
                size = np.uint16 if len(vocab.value.kind) < 1 << 16 else np.uint32
                for packed, n in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                    own, at = np.frombuffer(packed, dtype=size), every(np.frombuffer(n, dtype=np.int64), rounds, turn)
                    for k in range(0, len(at), WINDOWS):
                        here = at[k : k + WINDOWS]
                        found.add([own[here + o].astype(np.intp) for o in WINDOW], own[here].astype(np.intp))
                    seen += len(at)
                if seen:
                    yield from blocks(np.append(np.concatenate([x.ravel() for x in found.parts()]), seen), lanes, np.float32)

        total = summed(fed.mapInArrow(part, ROWS), len(flat) + 1, lanes, np.float32)
        sent.unpersist()
        if not total[-1]:
            continue
        change = total[:-1] / total[-1]
        first = 0.8 * first + 0.2 * change
        second = 0.99 * second + 0.01 * change * change
        step = rate * min(1, (steps - r) / (0.6 * steps)) * (first / (1 - 0.8 ** (r + 1))) / (np.sqrt(second / (1 - 0.99 ** (r + 1))) + 1e-6)
        flat -= np.where(flat <= NEVER / 2, 0, step)  # what no text has stays so
    return flat


def log_probabilities(p: list[np.ndarray], v: Vocabulary, ids: np.ndarray, net: Forward | None = None) -> np.ndarray:
    """Conditional log-probabilities of all tokens of ids that aren't EDGE, in order; net: the network of p, if it is made."""
    at = np.flatnonzero(ids != EDGE)
    net, out = Forward(p, v, min(WINDOWS, len(at))) if net is None else net, np.empty(len(at), dtype=p[3].dtype)

    def log_of_own(weights: np.ndarray, h: np.ndarray, own: np.ndarray, high: bool) -> np.ndarray:
        g = net.times(weights, h)
        own = np.minimum(g[own, net.count[: len(own)]], MOST)
        return own - np.log(powers(g, high).sum(axis=0) + TINY)

    for low in range(0, len(at), WINDOWS):
        here = at[low : low + WINDOWS]
        order, _ = in_order(v.kind[ids[here]])
        here = here[order]
        own = ids[here]
        kind, places = v.kind[own], v.place[own]
        h, found = net.hidden([ids[here + o] for o in WINDOW]), np.empty(len(here), dtype=out.dtype)
        for a in range(0, len(here), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(here))
            found[a:b] = log_of_own(net.w2, h[:, a:b], kind[a:b], net.high[0])
        for a, b, k in net.classes(kind):
            first, last = net.starts[k], net.starts[k + 1]
            found[a:b] += log_of_own(net.u[first:last], h[:, a:b], places[a:b] - first, net.high[1])
        out[low : low + WINDOWS][order] = found
    return out


def score(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with mean_log_likelihood a word, log_likelihood (the sum of conditional log-probabilities) and n_words.

    Vocabulary and network are learnt from all of docs. A text without words, null included, has null, 0 and 0; an empty
    table gives an empty one. Each row counts as often as it is there, and equal rows have equal scores but for rounding; columns of these
    names are replaced. A very long text is scored whole. What is sent to the tasks grows with the root of the number of
    distinct words. The number of tasks, and so the layout of files, changes scores by the rounding of sums alone.
    """
    sc = docs.sparkSession.sparkContext
    counts = counted(docs, text=text)
    vocab = sc.broadcast(vocabulary(docs, text=text, counts=counts))
    drop = [c for c in docs.columns if c.lower() in ("n_words", "log_likelihood", "mean_log_likelihood")]
    front = [c for c in docs.columns if (keep is None or c in keep) and c not in drop]
    rows = numbered(docs.withColumn("__row", F.monotonically_increasing_id()), vocab, text=text, keep=[*front, "__row"])
    sent = sc.broadcast(train(rows, vocab).astype(np.float32))

    def make():
        v = vocab.value
        p = unpacked(sent.value, v.shapes)
        net = Forward(p, v)

        def work(packed):
            ids, n = edged(packed, v)
            ids = ids.astype(np.intp)
            found = log_probabilities(p, v, ids, net).astype(np.float64)
            ids = ids[ids != EDGE]
            bucket = (ids >= WORDS) & (ids < EDGE)
            found[bucket] -= np.log(v.buckets[ids[bucket] - WORDS])
            return (pa.array(np.bincount(np.repeat(np.arange(len(n)), n), found, minlength=len(n))),)

        return work

    part = map_rows(rows, ["__ids"], "__sum double", make, [*front, "__row", "n_words", "__known"])
    # of a word in a bucket that is not known, what is still wanting is the logarithm of its own count
    rare = rows.select("__row", F.explode("__rare").alias("word")).join(counts, "word").groupBy("__row").agg(F.sum(F.log("n")).alias("__own"))
    total = F.col("__sum") + F.col("__known") + F.coalesce("__own", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return part.join(rare, "__row", "left").select(*(F.col(f"`{c}`") for c in front), mean.alias("mean_log_likelihood"), total.alias("log_likelihood"), "n_words")
