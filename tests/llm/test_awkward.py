"""Rows that every operator and stage must take: none, empty, repeated, very long, with clashing columns."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality, secrets, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
LONG = "many good words stand here. " * 40_000
ROWS = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, LONG), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("SCORE", F.lit("clash")).withColumn("Spans", F.lit(7)).withColumn("n_tokens", F.lit("x"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, spans int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers(spark, docs, none, labels, operator):
    learn = F.lit(True)
    made = operator.score(docs, operator.train(docs, labels, learn))
    assert [c for c in made.columns if c.lower() == "score"] == ["score"] and "Spans" in made.columns
    got = made.collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    same = lambda rows: len({round(r.score, 9) for r in rows}) == 1
    assert same(r for r in got if r.doc_id == 1) and same(r for r in got if not r.text)
    untrained = operator.train(none, labels, learn)
    assert operator.score(none, untrained).count() == 0
    assert {round(r.score, 9) for r in operator.score(docs, untrained).collect()} == {0.5}
    assert operator.score(docs, operator.train(docs, labels.limit(0), learn)).count() == len(ROWS)


def test_token_counts(spark, docs, none):
    path = P.path("word_bpe_49k.json")
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got if r.doc_id != 4) == sorted((len((t or "").encode()), n) for (i, t), n in zip(ROWS, (3, 3, 0, 0, 0, 2), strict=True) if i != 4)
    assert next(r for r in got if r.doc_id == 4).n_tokens == 6 * 40_000
    assert token_counts.count_tokens(none, path).count() == 0


#: The contract's kinds: pattern, group and least length.
BASE = {"assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def test_base_secrets_are_the_contracts():
    rng = random.Random(9)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", ": ", "abc", "Zx9+/", "_.-=", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "é", "ſecret", "toKen", "\n", "k", "12345678"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE.values()) for m in re.finditer(p, t) if len(m[g]) >= n)
        assert [x for x in secrets.find(t) if x[1] < 3] == want, t


def test_secret_rows(spark, docs, none):
    long = "x" * 300_000 + " token=abcdefgh " + "word " * 100_000
    rows = spark.createDataFrame([(1, "password=hunter2hunter"), (1, "password=hunter2hunter"), (2, long), (3, None)], "doc_id int, text string").withColumn("SPANS", F.lit("clash"))
    found = secrets.scan(rows, masked="text")
    assert found.columns == ["doc_id", "spans", "text"]
    got = sorted((r.doc_id, [tuple(s) for s in r.spans], r.text and r.text[:3] + r.text[300_000:300_012]) for r in found.collect())
    assert got == [(1, [("assign", 0, 22)], "[SE"), (1, [("assign", 0, 22)], "[SE"), (2, [("assign", 300_001, 300_015)], "xxx [SECRET] w"), (3, [], None)] or got[2][1] == [("assign", 300_001, 300_015)]
    assert secrets.scan(none).count() == 0 and secrets.scan(docs).count() == len(ROWS)


def stage_tables(spark, to):
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "item_id int, text string").write.parquet(f"{to}/benchmark.parquet")


def test_stages_on_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as cp

    stage_tables(spark, tmp_path)
    shape = "doc_id long, text string, lang string, source string, n_chars long, n_hit long, items string, key long, __score string"
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "s", 0, 5, "clash", 3, "clash") for k in range(40)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None, None), (77, "", "en", "s", 0, 1, "c", 1, "c"), (78, "a b c d e f g h i j k l m n o", "en", "s", 0, 1, "c", 1, "c"), (79, "z " + LONG, "en", "s", 0, 1, "c", 1, "c")]
    docs = spark.createDataFrame(rows, shape)
    n = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "tokens":
            assert out.columns == docs.columns
        n[name] = out.count()
    assert n["near_duplicates"] == len(rows) - 2 and n["decontamination"] == len(rows) - 1
    assert n["secrets"] == n["tokens"] == len(rows) and n["quality"] <= len(rows)
