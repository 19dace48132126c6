"""Cosines of consecutive filings against plain loops, over many ranges and with repeated and null keys."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from ledgerline.operators import similarity as si
from ledgerline.operators import text as tx

SHAPE = "entity string, section string, doc_id int, filing_date int, text string"


def filings(n=160, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["straße", "été", "the"]
    rows = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30]))
        rows.append((rng.choice(["A", "A", "A", "B", None]), rng.choice(["x", "y"]), k, n - k // 2, None if k % 29 == 0 else " ".join(words).upper() + ". a"))
    return [*rows, ("A", "x", 7, n - 3, "w1 w2 w2"), ("A", "x", 7, 3, "w1 w1 extra"), ("B", "x", None, 9, "w1"), ("lone", "x", 999, 1, "w1 w2")]


def plain(rows, stop):
    tf, n, by = defaultdict(Counter), Counter(), defaultdict(list)
    for e, s, d, at, text in rows:
        n[e, s] += 1
        by[e, s].append((at, -1 if d is None else d, d))
        if None not in (e, s, d):
            tf[e, s, d].update(w for w in (text or "").lower().replace(".", " ").split() if len(w) > 1 and w not in stop)
    df = Counter((e, s, w) for (e, s, _), c in tf.items() for w in c)
    out = []
    for (e, s), docs in by.items():
        docs.sort(key=lambda r: r[:2])
        weight = lambda d: {w: c * (math.log((1 + n[e, s]) / (1 + df[e, s, w])) + 1) for w, c in tf.get((e, s, d), {}).items()}  # noqa: E731, B023
        for (_, _, a), (at, _, b) in zip(docs, docs[1:]):
            if a is not None:
                x, y = weight(a), weight(b)
                size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                out.append((str(e), s, str(b), a, at, sum(v * y.get(w, 0) for w, v in x.items()) / size if size else 0.0))
    return sorted(out)


@pytest.mark.parametrize(("size", "words"), [(1 << 24, 1 << 20), (200, 10)])
def test_against_plain_loops(spark, monkeypatch, size, words):
    monkeypatch.setattr(si, "RANGE", size)
    monkeypatch.setattr(si, "AT_ONCE", words)
    rows = filings()
    for some in (rows, rows[:160]):  # with filings of several rows, and without
        made = tx.tfidf_similarity(spark.createDataFrame(some, SHAPE).repartition(5), ["the"]).collect()
        got = sorted((str(r.entity), r.section, str(r.doc_id), r.previous, r.filing_date, r.similarity) for r in made)
        want = plain(some, {"the"})
        assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs(a[5] - b[5]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_a_task_is_handed_few_rows_and_no_weights(spark):
    """Neither the batches nor the ranges that Python holds grow with the table."""
    made = tx.tfidf_similarity(spark.createDataFrame(filings(), SHAPE), ["the"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and all("__row" in line for line in plan.splitlines() if "Join" in line)  # the last rows of ranges
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_nothing(spark):
    assert tx.tfidf_similarity(spark.createDataFrame([], SHAPE)).count() == 0
    assert tx.tfidf_similarity(spark.createDataFrame([("A", "x", 1, 1, None)], SHAPE)).count() == 0


def test_snippets_are_made_of_the_few_texts(spark):
    rows = spark.createDataFrame([("A", "x", k, k, f"word{k} " * (3 + 100 * k)) for k in range(6)], SHAPE)
    made = tx.shift_snippets(tx.tfidf_similarity(rows), rows, n=2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Join")  # after the joins, so above them
    assert [(r.doc_id, r.previous) for r in made.orderBy("doc_id").collect()] == [(1, 0), (2, 1)]
    assert made.where("doc_id = 1").first().before == "word0 word0 word0"
