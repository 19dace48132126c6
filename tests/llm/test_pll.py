"""The work of the pseudo-likelihood for one token, and which windows a round takes."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from ledgerline.llm import pll
from ledgerline.llm.common import cut, words_of


def test_few_logits_a_token(spark):
    """The classes and a token's class together: words are divided so that the mean over tokens is small."""
    rows = [(k, " ".join(["w%d" % j] * (20_000 // (j + 1)))) for k, j in enumerate(range(4000))]
    v = pll.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = np.zeros(len(v.kind))
    counts[[v.words[b"w%d" % j] for j in range(4000)]] = [20_000 // (j + 1) for j in range(4000)]
    sizes, classes = np.diff(v.starts), len(v.starts) - 1
    # words divided by equal counts: 64 + 57
    assert sizes.sum() == len(v.kind) and classes + (counts * sizes[v.kind]).sum() / counts.sum() < 100


@pytest.mark.parametrize("rounds", [1, 3, 15])
def test_rounds_take_every_window_once(rounds):
    n = np.array([0, 1, 2, 0, 7, 31, 15, 0])
    ids = np.concatenate([[pll.EDGE] * 2, *(np.r_[np.arange(k), [pll.EDGE] * 2] for k in n)])
    taken = [pll.every(n, rounds, turn) for turn in range(rounds)]
    assert sorted(np.concatenate(taken).tolist()) == np.flatnonzero(ids != pll.EDGE).tolist()
    assert all((ids[at] % rounds == turn).all() for turn, at in enumerate(taken))
    assert pll.every(np.zeros(0, dtype=np.int64), rounds, 0).tolist() == []


def test_windows_at_once_change_no_gradient(spark):
    texts = [" ".join(f"a{(k * j) % 23} b{j % 7}" for j in range(40)) for k in range(30)]
    v = pll.vocabulary(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    ids, n = v.ids([t.encode() for t in texts])
    rng = np.random.default_rng(3)
    p = [x + rng.normal(0, 0.3, x.shape) * (x > pll.NEVER / 2) for x in pll.unpacked(pll.initial(v.shapes, v.prior), v.shapes)]
    sums = []
    for size in (50, 1 << 14):
        g, at = pll.Gradient(p, v), pll.every(n, 1, 0)
        for k in range(0, len(at), size):
            here = at[k : k + size]
            g.add([ids[here + o] for o in pll.WINDOW], ids[here])
        g.add([here[:0]] * 4, here[:0])
        sums.append(g.parts())
    assert [x.shape for x in sums[0]] == list(v.shapes)
    for x, y in zip(*sums, strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_words_in_buckets_are_found_with_the_ids():
    v = pll.Vocabulary({b"known": 3}, np.zeros(0), np.zeros(0), np.zeros(1), (np.zeros(0), np.zeros(0)), np.zeros(0))
    ids, rare = v.ids_of([b"odd", b"known", b"odd", b"other"])
    assert rare == [b"odd", b"odd", b"other"] and ids[1] == 3 and ids[0] == ids[2] and ((ids >= pll.WORDS) & (ids < pll.EDGE)).tolist() == [True, False, True, True]
    assert [len(x) for x in v.ids_of([])] == [0, 0]


def test_words_of_many_texts_are_cut_as_those_of_one():
    rng = np.random.default_rng(5)
    texts = [None, b"", b" ", b"..", *(bytes(rng.choice(list(b" aZ9.\n\x00\x80\xff,"), rng.integers(0, 12)).astype(np.uint8)) for _ in range(500)), None]
    for part in (texts, texts[:1], texts[:4], []):
        words, n = cut(part)
        assert n.tolist() == [len(words_of(t)) for t in part] and words.to_pylist() == [w for t in part for w in words_of(t)]


def test_known_words_are_looked_up_and_the_others_joined(spark, monkeypatch):
    """Of the words in buckets the frequent ones reach no join, which had a row for each of their places."""
    rows = [(k, " ".join(f"f{j} " * 9 for j in range(32 * k, 32 * k + 32))) for k in range(125)]
    rows += [(1000 + k, " ".join(f"five{j}" for j in range(500)) + f" once{k} " + "x" * 100) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {bytes(r.word): r.n for r in pll.counted(docs).collect()}
    assert sum(counts.values()) == 125 * 32 * 9 + 5 * 502
    v = pll.vocabulary(docs)
    assert not any(w.startswith((b"five", b"once", b"xx")) for w in v.words)
    known = dict(zip(v.known[0].to_pylist(), np.exp(v.known[1]).round(), strict=True))
    rare = [w for w in counts if w not in v.words]
    assert known == {w: counts[w] for w in rare if len(w) <= pll.KNOWN_BYTES} and b"x" * 100 not in known
    monkeypatch.setattr(pll, "KNOWN", 502)  # not the words seen once: a count is taken whole
    few = pll.vocabulary(docs)
    assert set(few.known[0].to_pylist()) == {w for w in rare if counts[w] > 1 and len(w) <= pll.KNOWN_BYTES}
    for r in pll.numbered(docs.where("doc_id >= 1000"), spark.sparkContext.broadcast(few)).collect():
        words = r.text.encode().split()
        assert [bytes(w) for w in r["__rare"]] == [w for w in words if counts[w] == 1 or len(w) > pll.KNOWN_BYTES] and len(r["__rare"]) == 2
        assert r["__known"] == pytest.approx(500 * np.log(5)) and r.n_words == 502
        np.testing.assert_array_equal(np.frombuffer(bytes(r["__ids"]), dtype=np.uint16), few.ids_of(words)[0])
    scored = []
    for most in (502, 0):
        monkeypatch.setattr(pll, "KNOWN", most)
        monkeypatch.setattr(pll, "train", lambda *a, **b: pll.initial(v.shapes, v.prior))
        scored.append([r.log_likelihood for r in pll.score(docs).orderBy("doc_id").collect()])
    assert scored[0] == pytest.approx(scored[1], rel=1e-9)


def test_a_batch_of_windows_takes_few_new_pages(spark):
    """The arrays of a batch are made once: before, each batch made some 9 MB anew, page by page."""
    texts = [" ".join(f"a{(k * j) % 97} b{j % 7}" for j in range(40)) for k in range(300)]
    v = pll.vocabulary(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    ids, n = v.ids([t.encode() for t in texts])
    at = pll.every(n, 1, 0)[: pll.WINDOWS]
    g = pll.Gradient(pll.unpacked(pll.initial(v.shapes, v.prior), v.shapes), v)
    around, target = [ids[at + o] for o in pll.WINDOW], ids[at]
    g.add(around, target)
    tracemalloc.start()
    g.add(around, target)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(at) == pll.WINDOWS and most < 3 << 20


def test_rounds_read_a_row_a_batch(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c") for k in range(2000)], "doc_id long, text string").coalesce(1)
    vocab = spark.sparkContext.broadcast(pll.vocabulary(docs))
    rows = pll.batched(pll.numbered(docs, vocab), vocab).collect()
    assert len(rows) == 4 and sum(len(np.frombuffer(bytes(r.n), dtype=np.int64)) for r in rows) == 2000
