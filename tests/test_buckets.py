"""Bucketed sinks: the plans over them shuffle nothing by entity, and the results are those of plain tables."""

from __future__ import annotations

import random
import re

from ledgerline.operators import metrics as mo
from ledgerline.operators import valuation as va
from ledgerline.sources.readers import write_bucketed


def facts(spark):
    rng = random.Random(2)
    rows = [
        (f"E{e}", y, f"FY{y}", "FY", m, rng.uniform(1, 9), "USD", f"{y + 1}-02-01", f"{y + 1}-02-01", f"{e}-{y}") for e in range(30) for y in (1999, 2000, 2001) for m in (*mo.INPUTS, "cash_and_securities", "diluted_shares")
    ]
    names = "entity string, fiscal_year int, fiscal_period string, fp string, metric string, value double, unit string, filing_date string, source_available_date string, accession string"
    return spark.createDataFrame(rows, names)


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def same(a, b):
    cut = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    return cut(a) == cut(b)


def test_ratios_over_the_sink(spark):
    plain = facts(spark)
    sink = write_bucketed(plain, "facts", by=["entity"], sort=["fiscal_year"], buckets=4)
    assert sink.count() == plain.count() and len(sink.inputFiles()) == 4
    over = mo.ratios(sink)
    assert shuffles(mo.ratios(plain)) and not shuffles(over)
    assert same(over, mo.ratios(plain))


def test_scenarios_over_the_sinks(spark):
    plain = mo.line_items(facts(spark))
    prices = spark.createDataFrame([(f"E{e}", f"2001-12-{d:02}", 10.0 + d) for e in range(30) for d in (1, 9, 30)], "ticker string, date string, adj_close double").selectExpr("ticker", "cast(date as date) as date", "adj_close")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks = write_bucketed(plain, "metrics", by=["entity"], buckets=4), write_bucketed(prices, "prices", by=["ticker"], buckets=4)
        over = va.scenarios(mo.valuation_inputs(*sinks), va.scenario_table(spark))
        assert "SortMergeJoin" in over._jdf.queryExecution().executedPlan().toString()
        assert not shuffles(over)
        assert same(over, va.scenarios(mo.valuation_inputs(plain, prices), va.scenario_table(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
