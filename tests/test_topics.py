"""Topics: the special functions, the bound, planted topics, and no dependence on partitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ledgerline.operators import topics as to

GROUPS = [["apple", "pear", "plum", "grape", "melon"], ["bolt", "screw", "nail", "hinge", "bracket"], ["violin", "cello", "flute", "oboe", "harp"]]


def corpus(n=240, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        own = GROUPS[i % 3]
        words = [rng.choice(own) if rng.random() < 0.95 else rng.choice(GROUPS[rng.randrange(3)]) for _ in range(rng.randint(15, 40))]
        rows.append((i, " ".join(words) + " x rare" + str(i)))
    return [*rows, (1000, "nothing of the vocabulary stands here, though the text is long enough"), (1001, "short"), (1002, None)]


def frame(spark, parts=3):
    return spark.createDataFrame(corpus(), "doc_id int, text string").repartition(parts)


def test_special_functions():
    x = np.array([1e-3, 0.2, 0.5, 1.0, 2.5, 7.9, 8.1, 40.0, 1e6])
    assert np.allclose(to.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    slope = [(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x[:8]]
    assert np.allclose(to.digamma(x[:8]), slope, rtol=1e-5, atol=1e-5)
    assert abs(float(to.digamma(np.array(1.0))) + 0.5772156649015329) < 1e-10


def test_planted_topics_are_found_and_the_bound_never_falls(spark):
    rows, model = to.topic_model(frame(spark), topics=3, iterations=25)
    assert all(b >= a - 1e-3 for a, b in zip(model.bounds, model.bounds[1:])) and model.bounds[-1] > model.bounds[0]
    found = [set() for _ in range(3)]
    for r in to.topic_terms(spark, model).collect():
        found[r.topic].add(r.term)
    assert sorted(map(sorted, found)) == sorted(map(sorted, GROUPS))
    weights = {}
    for r in rows.collect():
        weights.setdefault(r.doc_id, {})[r.topic] = r.weight
    assert set(weights) == {*range(240), 1000} and all(abs(sum(w.values()) - 1) < 1e-9 for w in weights.values())
    of = [next(k for k in range(3) if GROUPS[g][0] in found[k]) for g in range(3)]
    assert all(max(w, key=w.get) == of[i % 3] for i, w in weights.items() if i < 240)
    assert all(abs(w - 1 / 3) < 1e-9 for w in weights[1000].values())


def test_partitions_change_nothing(spark):
    made = []
    for parts in (1, 16):
        rows, model = to.topic_model(frame(spark, parts), topics=3, iterations=4)
        made.append((model.terms, model.weights.tolist(), model.bounds, sorted((r.doc_id, r.topic, round(r.weight, 9)) for r in rows.collect())))
    assert made[0] == made[1]


def test_no_documents(spark):
    rows, model = to.topic_model(frame(spark).where("doc_id > 5000"), topics=2)
    assert rows.count() == 0 and to.topic_terms(spark, model).count() == 0 and model.bounds == []


@pytest.mark.parametrize("k", [0, 1])
def test_a_step_is_the_textbooks(k):
    """One document's weights against a plain loop."""
    rng = np.random.default_rng(k)
    terms, counts = np.exp(to.expected_log(rng.random((2, 4)) + 0.5)).T, np.array([3.0, 1.0, 2.0])
    docs = to.Documents(np.array([0, 1, 3]), counts, np.zeros(3, dtype=np.int64), np.array([[1.0, 2.0]]))
    gamma = docs.gamma[0].copy()
    docs.step(terms, 0.5, 2)
    for _ in range(2):
        theta = np.exp([float(to.digamma(np.array(g)) - to.digamma(np.array(gamma.sum()))) for g in gamma])
        gamma = 0.5 + sum(c * theta * terms[i] / (theta * terms[i]).sum() for i, c in zip((0, 1, 3), counts, strict=True))
    assert np.allclose(docs.gamma[0], gamma)


def test_a_round_moves_blocks_of_documents(spark, monkeypatch):
    """A row holds many documents' arrays as bytes, in whatever blocks, with the same result."""
    made = []
    for size in (1, 1000):
        monkeypatch.setattr(to, "BLOCK", size)
        rows, model = to.topic_model(frame(spark), topics=3, iterations=3)
        made.append((model.weights.tolist(), model.bounds, sorted((r.doc_id, r.topic, r.weight) for r in rows.collect())))
    assert made[0] == made[1]
    state = to._counted(spark.createDataFrame([(k, ["apple", "pear", "apple"]) for k in range(300)], "doc_id int, words array<string>").coalesce(1), "doc_id", ["apple", "pear"])
    assert state.count() == 1 and len(state.first().ids) == 600
