"""The automaton against regular expressions, and its time against the number of patterns."""

from __future__ import annotations

import random
import re
import time

import pytest

from ledgerline.functions import patterns as pt


def expression(p, bounded):
    return rf"\b{re.escape(p)}\b" if bounded else re.escape(p)


@pytest.mark.parametrize("seed", range(4))
def test_counts_are_those_of_regular_expressions(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aab c*é") for _ in range(rng.randint(1, 5)))
    patterns = {word(): rng.random() < 0.5 for _ in range(60)} | {"***": False, "aa": False, "aba": True}
    texts = ["".join(rng.choice("aab c*é\n_") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(150)] + [None, "a" * 3000]
    automaton = pt.Automaton(patterns)
    got = {(int(t), automaton.patterns[p]): int(n) for t, p, n in zip(*automaton.count(texts), strict=True)}
    want = {(i, p): n for i, t in enumerate(texts) for p, b in patterns.items() if (n := len(re.findall(expression(p, b), t or "")))}
    assert got == want


def test_stretches_lose_nothing_at_their_borders(monkeypatch):
    monkeypatch.setattr(pt, "SHORTEST", 3)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(500)) for _ in range(3)]
    automaton = pt.Automaton({"abba": False, "ab": False, "bbabab": False})
    monkeypatch.setattr(pt, "STRETCHES", 10_000)
    got = {(int(t), automaton.patterns[p]): int(n) for t, p, n in zip(*automaton.count(texts), strict=True)}
    assert got == {(i, p): n for i, t in enumerate(texts) for p in automaton.patterns if (n := len(re.findall(p, t)))}


def test_groups_and_awkward_rows(spark):
    rows = [(1, "one two one"), (2, None), (3, ""), (4, "two, twofold"), (1, "one two one")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    out = pt.literal_counts(df, {"a": ["one", "two"], "none": [], "twice": ["two", "two"], "never": ["three"]}, bounded=True)
    got = sorted((r.id, [(c.g, c.n) for c in r.counts]) for r in out.collect())
    assert got == [(1, [(0, 3), (2, 2)]), (1, [(0, 3), (2, 2)]), (2, []), (3, []), (4, [(0, 1), (2, 2)])]
    assert pt.literal_counts(df.where("id > 9"), {"a": ["one"]}).count() == 0
    assert pt.literal_counts(df, {}).where("size(counts) > 0").count() == 0


def test_time_does_not_grow_with_the_patterns():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [" ".join(word(rng.randint(2, 9)) for _ in range(300)) for _ in range(400)]
    took = []
    for n in (10, 1000):
        automaton = pt.Automaton({word(8): True for _ in range(n)})
        automaton.count(texts)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            automaton.count(texts)
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < 4 * took[0] + 0.05, took
