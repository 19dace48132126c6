"""Topics by a variational fit whose result does not depend on partitions.

Topics begin from a hash of topic and term. In each round the documents, many at once, bring their own weights up to
date from where they stand, and hand in what each term contributes to each topic, in whole units, so that Spark's sums
are the same in any order. A round can only raise the bound on the evidence, which is kept for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import limit_batches, shared

WORD = r"[\p{L}\p{N}_]{2,}"
#: Units of a term's contribution to a topic, and of a document's share of the bound.
UNIT, BOUND_UNIT = 1 << 20, 1 << 16
#: Steps of a document's weights in a round.
STEPS = 6
#: Documents of a block, about.
BLOCK = 1000


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: carried up to 6 and more, then by its asymptotic series."""
    x, low = np.array(x, dtype=np.float64), 0.0
    for _ in range(6):
        small = x < 6
        low = low - np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: carried up to 8 and more, then by Stirling's series."""
    x, low = np.array(x, dtype=np.float64), 0.0
    for _ in range(8):
        small = x < 8
        low = low - np.where(small, np.log(x), 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def expected_log(a: np.ndarray) -> np.ndarray:
    """Expected logarithms of shares that are Dirichlet with the rows of a."""
    return digamma(a) - digamma(a.sum(axis=-1, keepdims=True))


@dataclass
class Topics:
    """Terms, and the Dirichlet parameters of each topic over them; bounds: of each round."""

    terms: list[str]
    weights: np.ndarray
    prior: float
    bounds: list[float] = field(default_factory=list)

    @staticmethod
    def start(terms: list[str], topics: int, seed: int) -> Topics:
        hashed = [[zlib.crc32(f"{seed}:{k}:{t}".encode()) for t in terms] for k in range(topics)]
        return Topics(terms, 0.5 + np.array(hashed, dtype=np.float64).reshape(topics, len(terms)) / 2**32, 1 / topics)

    def shares(self) -> np.ndarray:
        return self.weights / self.weights.sum(axis=1, keepdims=True)


@dataclass
class Documents:
    """Counts of terms of many documents in flat arrays, and each document's Dirichlet parameters over topics."""

    ids: np.ndarray
    counts: np.ndarray
    doc: np.ndarray
    gamma: np.ndarray

    def _met(self, terms: np.ndarray) -> list[np.ndarray]:
        """Of each topic, the terms' values at every count."""
        return [np.ascontiguousarray(t)[self.ids] for t in terms.T]

    def _sizes(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.gamma))

    def _fit(self, met: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's factors, a column a topic, and at every count the sum over the topics of factor times term."""
        own, total = np.exp(expected_log(self.gamma)), None
        for k, m in enumerate(met):  # one topic after the other, so that no division into batches changes a sum
            part = np.repeat(own[:, k], sizes)
            part *= m
            total = part if total is None else np.add(total, part, out=total)
        return own, total

    def step(self, terms: np.ndarray, prior: float, steps: int) -> None:
        """terms: exp of the expected logarithm of each term in each topic, a row a term."""
        met, sizes = self._met(terms), self._sizes()
        some = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[some]
        for _ in range(steps):
            own, total = self._fit(met, sizes)
            fresh = np.full(self.gamma.shape, prior)
            if len(some):
                share = self.counts / total
                for k, m in enumerate(met):
                    fresh[some, k] += own[some, k] * np.add.reduceat(share * m, first)
            self.gamma = fresh

    def sums(self, terms: np.ndarray, prior: float) -> tuple[np.ndarray, int]:
        """What every term contributes to every topic, and the documents' share of the bound, in units."""
        met, sizes, k = self._met(terms), self._sizes(), self.gamma.shape[1]
        factors, total = self._fit(met, sizes)
        share = self.counts / total * UNIT
        # whole numbers, of one batch: sums are exact
        given = [np.bincount(self.ids, weights=np.rint(np.repeat(factors[:, t], sizes) * m * share), minlength=len(terms)) for t, m in enumerate(met)]
        logs = expected_log(self.gamma)
        own = ((prior - self.gamma) * logs + log_gamma(self.gamma) - log_gamma(np.array(prior))).sum(axis=1) + log_gamma(np.array(k * prior)) - log_gamma(self.gamma.sum(axis=1))
        own += np.bincount(self.doc, weights=self.counts * np.log(total), minlength=len(own))
        return np.stack(given, axis=1).astype(np.int64), int(np.rint(own * BOUND_UNIT).astype(np.int64).sum())


def vocabulary(words: DataFrame, size: int, *, least: int = 2, most: float = 0.95) -> list[str]:
    """The terms of the array column `words` that stand in `least` documents or more and in a share of `most` at the most,
    those of the most documents first; `size` of them at the most reach the driver."""
    n = words.count()
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return [r.term for r in df.where((F.col("df") >= least) & (F.col("df") <= most * n)).orderBy(F.desc("df"), "term").limit(size).collect()]


#: A block of documents: their keys and numbers of terms, and flat arrays as bytes; or a task's sums (at, v).
_STATE = "sizes binary, ids binary, counts binary, gamma binary, at array<int>, v array<bigint>"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, dtype=f"u{max(len(b) // max(n, 1), 1)}").astype(np.int64)


def _documents(n: int, sizes: bytes, ids: bytes, counts: bytes, gamma: bytes | None, topics: int, prior: float) -> Documents:
    """A block of n documents; without a gamma they begin even."""
    own = _unpacked(sizes, n)
    doc, m = np.repeat(np.arange(n), own), int(own.sum())
    counted = _unpacked(counts, m).astype(np.float64)
    if gamma is None:
        start = np.full((n, topics), prior) + (np.bincount(doc, weights=counted, minlength=n) / topics)[:, None]
    else:
        start = np.frombuffer(gamma).reshape(n, topics)
    return Documents(_unpacked(ids, m), counted, doc, start)


def _counted(words: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(keys, sizes, ids, counts, gamma, at, v): blocks of documents with their terms of the vocabulary, nothing fitted yet."""
    sent = words.sparkSession.sparkContext.broadcast(terms)
    shape = T.StructType([T.StructField("keys", T.ArrayType(words.schema[key].dataType)), *T.StructType.fromDDL(_STATE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        width = max(len(known), 1)

        def block(keys: list[pa.Array], met: list[np.ndarray]) -> pa.RecordBatch:
            own = pa.concat_arrays(keys)
            sizes = np.concatenate([np.bincount(m[0] // width, minlength=len(k)) for k, m in zip(keys, met, strict=True)])
            parts = [sizes, np.concatenate([m[0] % width for m in met]), np.concatenate([m[1] for m in met])]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *(pa.array([_packed(x)], pa.binary()) for x in parts)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64()))], names=shape.names)

        keys, met = [], []
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(1)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))
            code = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            keys.append(b.column(0))
            met.append(np.unique((row * width + code)[code >= 0], return_counts=True))
            if sum(map(len, keys)) >= BLOCK:
                yield block(keys, met)
                keys, met = [], []
        if keys:
            yield block(keys, met)

    return shared(words.select(key, "words").mapInArrow(run, shape))


def _round(state: DataFrame, model: Topics) -> DataFrame:
    """The documents' weights brought up to date; every task adds a row of its sums (at, v), and no others have these."""
    topics, terms = model.weights.shape
    logs = expected_log(model.weights)
    sent = state.sparkSession.sparkContext.broadcast(np.exp(logs).T.copy())
    prior, kind = model.prior, state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound, schema = np.zeros((terms, topics), dtype=np.int64), 0, None
        for b in batches:
            schema = b.schema
            gammas = []
            for keys, *parts in zip(*b.columns[:5], strict=True):
                docs = _documents(len(keys), *(x.as_py() for x in parts), topics, prior)
                docs.step(sent.value, prior, STEPS)
                given, own = docs.sums(sent.value, prior)
                total, bound = total + given, bound + own
                gammas.append(docs.gamma.tobytes())
            if gammas:
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(gammas, pa.binary()), *b.columns[5:]], names=schema.names)
        if schema is not None:
            at = np.flatnonzero(total)
            last = [*([None] * (len(schema.names) - 2)), [-1, *at.tolist()], [bound, *total.ravel()[at].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=schema.field(i).type) for i, x in enumerate(last)], names=schema.names)

    return shared(state.where("at is null").mapInArrow(run, kind))


def _shares(state: DataFrame, key: T.StructField, topics: int) -> DataFrame:
    """(key, topic, weight) of the documents of all blocks."""
    shape = T.StructType([key, T.StructField("topic", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, gamma in zip(*b.columns, strict=True):
                n = len(keys)
                own = np.ones((n, topics)) if gamma.as_py() is None else np.frombuffer(gamma.as_py()).reshape(n, topics)
                weight = own / sum(own.T)[:, None]
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(np.repeat(np.arange(n), topics))), pa.array(np.tile(np.arange(topics, dtype=np.int32), n)), pa.array(weight.ravel())], names=shape.names)

    return state.where("at is null").select("keys", "gamma").mapInArrow(run, shape)


def topic_model(docs: DataFrame, *, key: str = "doc_id", text: str = "text", topics: int = 5, vocabulary_size: int = 1000, iterations: int = 20, seed: int = 42, shortest: int = 50) -> tuple[DataFrame, Topics]:
    """(rows (key, topic, weight), topics) of documents longer than `shortest`, over words of two characters or more.

    The vocabulary are words of at most 95 % and at least 2 of the documents. A document without a word of it has even
    weights. What goes through the driver is of the size of topics times vocabulary.
    """
    limit_batches(docs.sparkSession)
    words = docs.where(F.length(text) > shortest).select(key, F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0).alias("words"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if words.rdd.getNumPartitions() < cores:  # a small table of few files: its rounds are for all cores
        words = words.repartition(cores)
    terms = vocabulary(words, vocabulary_size)
    model = Topics.start(terms, topics, seed)
    state = _counted(words, key, terms)
    for _ in range(iterations if terms else 0):
        state = _round(state, model)
        sums = state.where("at is not null").select(F.explode(F.arrays_zip("at", "v")).alias("s")).groupBy("s.at").agg(F.sum("s.v").alias("v"))
        found = {r["at"]: r["v"] for r in sums.toLocalIterator()}
        logs = expected_log(model.weights)
        v = len(terms)
        own = ((model.prior - model.weights) * logs + log_gamma(model.weights) - log_gamma(np.array(model.prior))).sum() + topics * float(log_gamma(np.array(v * model.prior))) - log_gamma(model.weights.sum(axis=1)).sum()
        model.bounds.append(found.pop(-1, 0) / BOUND_UNIT + float(own))
        given = np.zeros(v * topics)
        given[list(found)] = list(found.values())
        model.weights = model.prior + given.reshape(v, topics).T / UNIT
    return _shares(state, words.schema[key], topics), model


def topic_terms(spark, model: Topics, *, n: int = 5) -> DataFrame:
    """(topic, place, term, weight): each topic's n terms of the greatest weight, of equal ones the first by name."""
    rows = []
    for k, own in enumerate(model.shares()):
        best = sorted(range(len(own)), key=lambda i: (-own[i], model.terms[i]))[:n]
        rows += [(k, place, model.terms[i], float(own[i])) for place, i in enumerate(best)]
    return spark.createDataFrame(rows, "topic int, place int, term string, weight double")
