"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one word between, hashed to 2^BITS places and taken once a
document. Each coordinate has its own learning rate; L1 keeps most weights at exactly 0, so that only the others are
sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import limit_batches, map_rows, words_of
from ledgerline.llm.labelled import sample

BITS = 20
#: Labelled documents to learn from, at most.
SAMPLE = 12_000
_KEPT_WORDS = 200_000


class Features:
    """Hashes the words of a batch of texts; keeps the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document in the batch, place) of all features, repeated ones included."""
        words = [words_of(t) for t in texts]
        if len(self.known) > _KEPT_WORDS:
            self.known = {}
        self.known.update((w, crc32(w)) for w in set().union(*words).difference(self.known))
        of = self.known.__getitem__
        n = np.array([len(w) for w in words], dtype=np.int64)
        h = np.fromiter((x for w in words for x in map(of, w)), dtype=np.uint64, count=int(n.sum()))
        doc = np.repeat(np.arange(len(words), dtype=np.int64), n)
        docs, places = [doc], [h * np.uint64(0x9E3779B97F4A7C15)]
        for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            places.append(((h[:-gap] * np.uint64(odd) ^ h[gap:]) * np.uint64(0x9E3779B97F4A7C15))[same])
        return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    def __init__(self, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", most: int = SAMPLE, epochs: int = 5,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, doc_id: str = "doc_id", text: str = "text",
) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not 0, the bias (place 2^BITS) included; learnt from at most `most` labelled rows.

    FTRL takes one example after the other, so one task learns; its input is bounded by `most`. Without labelled rows,
    as of an empty table, there are no weights: every text then has a score of 0.5.
    """
    rows = sample(docs, labels, label, most, learn, doc_id=doc_id, text=text)
    limit_batches(rows.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            doc, place = make.of(b.column(1).cast(pa.binary()).to_pylist())
            keys = np.unique(doc << (BITS + 1) | place)
            ends = np.searchsorted(keys, np.arange(b.num_rows + 1) << (BITS + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys & ((1 << (BITS + 1)) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2)], names=["__id", "x", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.append(np.asarray(x.values, dtype=np.int64), 1 << BITS), y) for b in batches for x, y in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
        model = Ftrl(alpha, beta, l1, l2)
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(examples)):
                model.learn(*examples[k])
        every = np.arange((1 << BITS) + 1)
        w = model.weights(every)
        yield pa.RecordBatch.from_arrays([pa.array(every[w != 0], pa.int64()), pa.array(w[w != 0])], names=["place", "weight"])

    kind = rows.schema["__id"].dataType.simpleString()
    made = rows.mapInArrow(features, f"__id {kind}, x array<int>, y int").repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id", "y", "x")
    found = sorted((r.place, r.weight) for r in made.mapInArrow(fit, "place bigint, weight double").toLocalIterator())
    return np.array([p for p, _ in found], dtype=np.int64), np.array([w for _, w in found], dtype=np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the probability that the whole text is toxic. A null or empty text has the score of the bias alone.

    Each row is scored alone, so repeated rows give repeated results, and whole, however long; an empty table gives an
    empty one; a column of the name `out` is replaced. The weights sent out are bounded by 2^BITS.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        places, weights = sent.value
        dense = np.zeros((1 << BITS) + 1, dtype=np.float64)
        dense[places] = weights
        made = Features()

        def work(texts):
            doc, place = made.of(texts)
            live = dense[place] != 0
            keys = np.unique(doc[live] << (BITS + 1) | place[live])
            margin = dense[1 << BITS] + np.bincount(keys >> (BITS + 1), dense[keys & ((1 << (BITS + 1)) - 1)], minlength=len(texts))
            return (pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30)))),)

        return work

    return map_rows(docs, [text], f"`{out}` double", make, keep)
