"""The lag over range partitions against a window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.previous import with_previous


@pytest.fixture
def eight(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("keys", [["one"], ["one", "one", "one", "two", None], [None], list("abcdefghijkl")])
def test_one_and_many_keys_over_eight_partitions(eight, keys):
    rng = random.Random(1)
    rows = [(rng.choice(keys), n, None if n % 7 == 0 else float(n), [n, n + 1] if n % 5 else None) for n in rng.sample(range(10_000), 700)]
    df = eight.createDataFrame(rows, "k string, n int, v double, a array<int>")
    made = with_previous(df, {"v": "v_before", "a": "a_before", "n": "n_before"}, by=["k"], order=["n"])
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    assert "Window" not in made._jdf.queryExecution().toString()
    w = Window.partitionBy("k").orderBy("n")
    want = df.select("*", *(F.lag(c).over(w).alias(f"{c}_before") for c in "van"))
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_few_and_no_rows(eight):
    df = eight.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert sorted(map(tuple, with_previous(df, {"n": "m"}, by=["k"], order=["n"]).collect())) == [("a", 1, None), ("b", 2, None)]
    assert with_previous(df.where("n > 5"), {"n": "m"}, by=["k"], order=["n"]).count() == 0
    assert [tuple(r) for r in with_previous(df, {"n": "m"}, by=[], order=["n"]).orderBy("n").collect()] == [("a", 1, None), ("b", 2, 1)]
