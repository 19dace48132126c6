"""Running sums in two levels against a window, and the plans that use them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.running import with_running_sums
from ledgerline.operators import gates, models


@pytest.mark.parametrize("before", [False, True])
def test_sums_over_many_ranges(spark, before):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(1)
        rows = [(n, f"r{n}", None if n % 9 == 0 else rng.randint(-5, 9), rng.randint(0, 8) / 4) for n in rng.sample(range(5000), 400)]
        df = spark.createDataFrame(rows, "n int, name string, whole int, part double")
        got = with_running_sums(df, ["whole", "part"], order=["n"], before=before)
        assert got.schema["whole"].dataType.simpleString() == "bigint"
        assert got.select(F.spark_partition_id()).distinct().count() > 4
        w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = df.select("n", "name", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("whole", "part")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert with_running_sums(df.where("n < 0"), ["whole"], order=["n"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_plan_gathers_all_days_in_one_partition(spark):
    calendar = gates.business_calendar(spark, "2001-01-01", "2001-12-31")
    rows = spark.createDataFrame([("E", f"P{k}", k, float(k), 2.0 * k) for k in range(9)], "entity string, fiscal_period string, feature_available_date int, x double, y double")
    for df in (calendar, models.pooled_walk_forward(rows, ["x"], "y")):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert calendar.agg(F.max("business_index")).first()[0] == 251
