"""Intervals of validity against resolving again for every date."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators import facts as fo
from ledgerline.operators import gates as ga
from ledgerline.operators import validity as vd

KEYS = ["entity", "metric", "fiscal_year"]


def table(spark, n=900):
    rng = random.Random(6)
    day = lambda: dt.date(2001, 1, 1) + dt.timedelta(days=rng.randrange(120))
    rows = []
    for k in range(n):
        filed = None if k % 50 == 0 else day()
        known = None if k % 31 == 0 else (filed or day()) + dt.timedelta(days=rng.choice([0, 0, 0, 9]))
        rows.append((f"E{rng.randrange(3)}", f"m{rng.randrange(4)}", 2000 + rng.randrange(3), rng.choice(["FY", "Q1"]), rng.choice(["10-K", "10-K/A", "10-Q", "8-K"]), None if k % 7 == 0 else day(), day(), filed, known, f"A{k:04}", float(k)))
    shape = "entity string, metric string, fiscal_year int, fp string, form_type string, period_start date, period_end date, filing_date date, source_available_date date, accession string, value double"
    return spark.createDataFrame(rows, shape).withColumn("selection_rank", fo.form_rank()).withColumn("selection_reason", F.col("form_type"))


def test_one_table_answers_a_hundred_dates(spark):
    facts = table(spark).cache()
    valid = vd.validity(facts, keys=KEYS, best=vd.amendment_order(), rank="selection_rank").cache()
    dates = [str(dt.date(2000, 12, 30) + dt.timedelta(days=k * 137 // 100)) for k in range(100)]
    got = vd.at_dates(valid, dates).select("as_of", *KEYS, "accession", "several")
    parts = None
    for d in dates:  # a hundred separate runs, in one action
        one = fo.amendment_resolve(ga.as_of(facts, d), keys=KEYS).select(F.lit(d).cast("date").alias("as_of"), *KEYS, "accession", F.col("selection_reason").endswith("(latest amendment)").alias("several"))
        parts = one if parts is None else parts.unionByName(one)
    assert sorted(map(str, got.collect())) == sorted(map(str, parts.distinct().collect()))
    one = vd.at_date(valid, dates[60]).select(*KEYS, "accession")
    assert sorted(map(str, one.collect())) == sorted(map(str, fo.amendment_resolve(ga.as_of(facts, dates[60]), keys=KEYS).select(*KEYS, "accession").collect()))


def test_intervals_of_a_key_follow_each_other(spark):
    valid = vd.validity(table(spark), keys=KEYS, best=vd.amendment_order())
    assert "several" not in valid.columns
    rows = valid.orderBy(*KEYS, "known_from").collect()
    for a, b in zip(rows, rows[1:]):
        same = all(a[k] == b[k] for k in KEYS)
        assert (a.known_to == b.known_from and a.accession != b.accession) if same else a.known_to is None


def test_deduplication_has_intervals_too(spark):
    facts, keys = table(spark), ["entity", "metric", "fiscal_year", "fp"]
    valid = vd.validity(facts, keys=keys, best=vd.dedup_order(fo.form_rank()))
    for d in ("2001-02-01", "2001-03-15", "2001-09-01"):
        want = fo.fact_dedup(ga.as_of(facts, d)).select(*keys, "accession").collect()
        assert sorted(map(str, vd.at_date(valid, d).select(*keys, "accession").collect())) == sorted(map(str, want))


def test_rows_with_dates_of_their_own(spark):
    valid = vd.validity(table(spark), keys=KEYS, best=vd.amendment_order())
    asked = valid.select(*KEYS).distinct().withColumn("at", F.explode(F.expr("array(date'2000-01-01', date'2001-02-10', date'2001-07-01', null)")))
    made = vd.join_as_of(asked, valid, keys=KEYS, at="at")
    assert made.count() == asked.count() and made.where("at is null and accession is not null").count() == 0
    for d in ("2001-02-10", "2001-07-01"):
        own = made.where(F.col("at") == d).where("accession is not null").select(*KEYS, "accession")
        assert sorted(map(str, own.collect())) == sorted(map(str, vd.at_date(valid, d).select(*KEYS, "accession").collect()))


def test_rows_are_shuffled_once(spark):
    """Every later step of the resolution stays with the key's rows."""
    valid = vd.validity(table(spark).repartition(3), keys=KEYS, best=vd.amendment_order(), rank="selection_rank")
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "max_by" not in plan
