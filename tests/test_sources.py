"""Older pages of submissions, attribution from the log, leaderboards with coefficients."""

from __future__ import annotations

import json

from ledgerline.operators import gates as ga
from ledgerline.operators import models as mo
from ledgerline.sources import readers as rd

WINDOW = {"report_date": "2020-12-31", "first_fy": 2010, "last_fy": 2020}


def block(*filings):
    names = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
    return {n: [f[i] for f in filings] for i, n in enumerate(names)}


def test_filings_of_recent_blocks_and_older_pages(spark, tmp_path):
    recent = block(("0-20-1", "2020-02-01", "2020-01-26", "10-K", "a.htm"), ("0-20-2", "2020-03-01", "2020-02-20", "8-K", "b.htm"), ("0-21-1", "2021-02-01", "2021-01-26", "10-K", "late.htm"))
    older = block(("0-11-1", "2011-03-01", "2011-01-30", "10-K/A", "c.htm"), ("0-11-2", "2011-05-01", "", "10-Q", "d.htm"), ("0-01-1", "2001-05-01", "2001-03-01", "10-Q", "e.htm"))
    main = {"cik": "7", "name": "Seven", "tickers": ["SVN"], "filings": {"recent": recent, "files": [{"name": "CIK7-submissions-001.json", "filingCount": 3}, {"name": "CIK7-submissions-002.json"}, {"name": None}]}}
    bare = {"cik": "8", "filings": {"recent": block(("0-20-8", "2020-04-01", "2020-03-31", "10-Q", "f.htm"))}}
    for name, body in {"CIK7.json": main, "CIK8.json": bare, "CIK7-submissions-001.json": older, "CIK9-submissions-001.json": older, "CIK10.json": {"cik": "10"}}.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "CIK11.json").write_text("{ no json")
    got = rd.read_filings(spark, str(tmp_path), **WINDOW)
    assert sorted((r.entity, r.accession, r.form_type, str(r.filing_date), str(r.report_period)) for r in got.collect()) == [
        ("7", "0-11-1", "10-K/A", "2011-03-01", "2011-01-30"), ("7", "0-11-2", "10-Q", "2011-05-01", "None"), ("7", "0-20-1", "10-K", "2020-02-01", "2020-01-26"), ("8", "0-20-8", "10-Q", "2020-04-01", "2020-03-31"),
    ]
    assert {r.url for r in got.where("accession = '0-11-1'").collect()} == {"https://www.sec.gov/Archives/edgar/data/7/0111/c.htm"}
    lone = spark.createDataFrame([(json.dumps(main),)], "value string")
    assert [r.accession for r in rd.filings_from_json(lone, **WINDOW).collect()] == ["0-20-1"]  # without pages


def test_attribution_from_the_log_alone(spark):
    lines = [
        {"step": "fetch_peer_financials", "ticker": "A", "timestamp": "2020-05-01T10:00:00Z", "source_date": "2020-04-01", "staleness_days": 90},
        {"step": "fetch_peer_financials", "ticker": "B", "timestamp": "2020-05-01T10:00:00Z", "source_date": "2019-04-01", "staleness_days": 91},
        {"step": "fetch_peer_financials", "ticker": "B", "timestamp": "2020-05-02T10:00:00Z", "source_date": "2019-04-01", "staleness_days": 92},
        {"step": "fetch_peer_financials", "ticker": "C", "timestamp": "2020-05-01T10:00:00Z"},
        {"step": "fetch_peer_financials"}, {"step": "fetch_prices", "ticker": "D", "staleness_days": 500},
    ]
    log = rd.provenance_from_lines(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{bad",)], "value string"))
    tiers = spark.createDataFrame([("A", "semi"), ("B", "context")], "ticker string, tier string")
    made = ga.attribution_from_log(log, tiers)
    assert sorted((r.ticker, r.tier, r.age_days, r.included, r.reasons, str(r.market_date)) for r in made.collect() if r.ticker != "B") == [("A", "semi", 90, True, "", "2020-05-01"), ("C", "other", None, True, "", "2020-05-01")]
    assert made.where("ticker = 'B' and not included").count() == 2
    assert sorted((r.tier or "", r.reason, r.peers) for r in ga.attribution_breakdown(made).collect()) == [("", "stale", 1), ("context", "stale", 1)]


def test_breakdown_counts_each_reason_of_a_peer(spark):
    peers = spark.createDataFrame([("A", None, None, 5.0), ("B", 1.0, "2001-12-01", -1.0), ("C", 1.0, "2001-12-01", 1.0)], "ticker string, market_cap double, d string, net_income double").selectExpr("ticker", "market_cap", "cast(d as date) as source_date", "net_income")
    tiers = spark.createDataFrame([("A", "semi")], "ticker string, tier string")
    made = ga.attribution_breakdown(ga.peer_attribution(peers, tiers, report_date="2001-12-31"))
    assert sorted((r.tier or "", r.reason, r.peers) for r in made.collect()) == [("", "no_earnings", 1), ("", "no_market_cap", 1), ("", "stale", 1), ("context", "no_earnings", 1), ("semi", "no_market_cap", 1), ("semi", "stale", 1)]


def test_leaderboard_lists_coefficients_by_size(spark):
    scores = spark.createDataFrame([("E", "a", 2.0), ("E", "b", 1.0), ("F", "a", 1.0)], "entity string, model string, mae double")
    sizes = spark.createDataFrame([("E", "a", "x", -3.0), ("E", "a", "y", 2.0), ("E", "a", "w", 3.0)], "entity string, model string, feature string, coefficient double")
    got = mo.leaderboard(scores, sizes).orderBy("entity", "place", "coefficient_place").collect()
    assert [(r.entity, r.model, r.place, r.feature, r.coefficient_place) for r in got] == [("E", "b", 1, None, None), ("E", "a", 2, "w", 1), ("E", "a", 2, "x", 2), ("E", "a", 2, "y", 3), ("F", "a", 1, None, None)]
    assert mo.leaderboard(scores).columns[-1] == "place"
