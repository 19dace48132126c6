"""A benchmark in several automata gives what it gives in one, and no text is written on the way."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerline.llm import decontaminate


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31) % 97}" for k in range(n))


def test_four_blocks_are_as_one(spark):
    bench = spark.createDataFrame([(f"i{k}", words(k, 30 + k)) for k in range(12)] + [("short", "w1 w2"), (None, words(50, 20))], "item_id string, text string")
    rows = [(k, words(k % 15, 60) + " SECRETMARK " + words(40 + k, 20)) for k in range(60)] + [(90, None), (91, ""), (92, "nothing in common"), (93, "w1 w2"), (93, "w1 w2"), (None, words(3, 33))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("source", F.lit("s")).repartition(4)
    docs = docs.checkpoint()
    assert decontaminate.dealt(bench, "item_id", "text", 150)[1] >= 4
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "source", "n_words", "hits", "n_hit", "items", "longest_match", "clean").collect()))
    many = decontaminate.find_overlaps(docs, bench, words_per_automaton=150, clean="clean")
    assert key(many) == key(decontaminate.find_overlaps(docs, bench, clean="clean"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    written = [os.path.join(at, f) for at, _, files in os.walk(folder) for f in files if "overlaps-" in at]
    assert written and not any(b"SECRETMARK" in open(f, "rb").read() for f in written)
    assert decontaminate.find_overlaps(docs.where("doc_id > 500"), bench, words_per_automaton=150).count() == 0
