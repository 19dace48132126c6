"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a core (its letters and digits, lower-cased) and a shape (case, tail of punctuation, whether it repeats
the token before). Each core and shape has a sparse random index vector; its word vector is the sum, over the whole
corpus, of the index vectors of itself and of what stands beside it. A document is the mean of its tokens' vectors. The
network's probabilities are calibrated by one temperature on labelled documents that it did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import counted_memory, limit_batches, map_rows
from ledgerline.llm.labelled import sample
from ledgerline.llm.sums import ROWS, blocks, summed

CORES, SHAPES, DIM = 8192, 1024, 32
#: Labelled documents to learn from, at most.
SAMPLE = 20_000
_KEPT_TOKENS = 200_000
#: Tokens whose vectors are summed at once.
SLICE = 1 << 16
_EDGE = b"".join(bytes([b]) for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


def index_vectors() -> np.ndarray:
    """Of each core and then each shape: 4 places of +1 and 4 of -1."""
    rng = np.random.default_rng(20)
    out = np.zeros((CORES + SHAPES, DIM), dtype=np.float32)
    order = np.argsort(rng.random(out.shape), axis=1)
    np.put_along_axis(out, order[:, :4], 1, axis=1)
    np.put_along_axis(out, order[:, 4:8], -1, axis=1)
    return out


class Tokens:
    """Cores and shapes of the tokens of a batch of texts; keeps what it has worked out of tokens."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _code(token: bytes) -> int:
        core = token.strip(_EDGE)
        tail = token[len(token.rstrip(_EDGE)) :] if core else token
        case = 0 if not core else 3 if core.isupper() and len(core) > 1 else 2 if core[:1].isupper() else 1 if core.islower() else 4
        shape = (case * 61 + (crc32(tail[:4]) % 101 if tail else 0)) % (SHAPES // 2)
        return (crc32(core.lower()) % CORES) << 16 | shape

    def of(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cores and shapes (from CORES on) of all tokens, and how many each text has."""
        tokens = [t.split() if t else [] for t in texts]
        if len(self.known) > _KEPT_TOKENS:
            self.known = {}
        code = self._code
        self.known.update((w, code(w)) for w in set().union(*tokens).difference(self.known))
        of = self.known.__getitem__
        n = np.array([len(w) for w in tokens], dtype=np.int64)
        codes = np.fromiter((x for w in tokens for x in map(of, w)), dtype=np.int64, count=int(n.sum()))
        core, shape = codes >> 16, codes & 0xFFFF
        if len(core) > 1:
            again = core[1:] == core[:-1]
            starts = np.cumsum(n)[:-1]
            again[starts[(starts > 0) & (starts < len(core))] - 1] = False  # a text's first token repeats none
            shape[1:] += (SHAPES // 2) * again
        return core, shape + CORES, n


def word_vectors(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Unit vectors of all cores and shapes, from every token of every document."""
    limit_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            index, tokens = index_vectors(), Tokens()
            total = np.zeros((CORES + SHAPES, DIM))
            for b in batches:
                core, shape, n = tokens.of(b.column(0).to_pylist())
                if not len(core):
                    continue
                doc = np.repeat(np.arange(len(n)), n)
                for low in range(0, len(core), SLICE):
                    # a token more on both sides, so that no pair of neighbours is lost
                    front = min(low, 1)
                    c, s, d = (x[low - front : low + SLICE + 1] for x in (core, shape, doc))
                    own = index[c] + index[s]
                    around = own.copy()
                    same = (d[1:] == d[:-1])[:, None]
                    around[1:] += own[:-1] * same
                    around[:-1] += own[1:] * same
                    c, s, around = (x[front : front + SLICE] for x in (c, s, around))
                    for ids in (c, s):
                        order = np.argsort(ids, kind="stable")
                        ids = ids[order]
                        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                        total[ids[first]] += np.add.reduceat(around[order], first, axis=0)
            yield from blocks(total)
            index = tokens = None

    size = (CORES + SHAPES) * DIM
    total = summed(docs.select(F.col(text).cast("binary")).mapInArrow(gather, ROWS), size).reshape(-1, DIM)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(tokens: Tokens, vectors: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    """Means of cores' and of shapes' vectors, and the logarithm of the number of tokens, by text."""
    core, shape, n = tokens.of(texts)
    out = np.zeros((len(texts), 2 * DIM + 1), dtype=np.float32)
    full = np.flatnonzero(n)
    if len(full):
        starts = np.r_[0, np.cumsum(n)[:-1]][full]
        for k, ids in enumerate((core, shape)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[ids], starts, axis=0) / n[full, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, batch: int = 128) -> Model:
    """Adam on the logistic loss; one row in five only sets the temperature."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(own)
        for k in range(0, len(own), batch):
            rows = own[k : k + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h * h)
            t += 1
            for i, d in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                d = d + decay * p[i] * (i in (0, 2))
                m[i] += 0.1 * (d - m[i])
                v[i] += 0.001 * (d * d - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        logit = model.logits(x[held])
        loss = lambda k: np.mean(np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / k))
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Word vectors from all documents; the network from at most `most` labelled rows for which `learn` holds.

    Without labelled rows, as of an empty table, every text has the probability 0.5 of an untrained network's bias.
    """
    vectors = word_vectors(docs, text=text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        tokens = Tokens()
        return lambda texts: (list(pooled(tokens, sent.value, texts)),)

    rows = map_rows(sample(docs, labels, label, most, learn, doc_id=doc_id, text=text), ["text"], "x array<float>", make, ["__id", "y"])
    found = sorted((str(r["__id"]), r.y, r.x) for r in rows.toLocalIterator())  # at most `most` short rows
    x = np.array([r[2] for r in found], dtype=np.float64).reshape(-1, 2 * DIM + 1)
    if not len(x):
        return Model(vectors, np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1), np.zeros((2 * DIM + 1, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    return fit(x, np.array([r[1] for r in found], dtype=np.float64), vectors)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the probability that the whole text is of good quality; null and empty texts are texts without tokens.

    Each row is scored alone, so repeated rows give repeated results, and whole, however long: only the mean over its
    tokens is held. An empty table gives an empty one; a column of the name `out` is replaced. What is sent out has the
    fixed size of the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        tokens = Tokens()
        return lambda texts: (pa.array(sent.value.probabilities(pooled(tokens, sent.value.vectors, texts)).astype(np.float64)),)

    return map_rows(docs, [text], f"`{out}` double", make, keep)
