"""Boundary values of single operators on small literal frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import columns as c
from ledgerline.operators import facts as fo
from ledgerline.operators import gates as ga
from ledgerline.operators import market as ma
from ledgerline.operators import metrics as mo
from ledgerline.operators import models as md
from ledgerline.operators import panel as pa
from ledgerline.operators import text as tx
from ledgerline.operators import valuation as va
from ledgerline.sources import readers as rd

D = dt.date.fromisoformat


def rows(df, *columns):
    return sorted(tuple(r[x] for x in columns) for r in df.collect())


def test_period_types(spark):
    df = spark.createDataFrame([(n,) for n in (99, 100, 339, 340, 349, 350, 380, 381)], "d int").withColumn("s", F.lit("2000-01-01").cast("date"))
    got = dict(rows(df.select("d", c.period_type("s", "d").alias("t")), "d", "t"))
    assert got == {99: "quarterly", 100: "ytd", 339: "ytd", 340: "other", 349: "other", 350: "annual", 380: "annual", 381: "other"}


def test_label_algebra(spark):
    df = spark.createDataFrame([("FY2024-Q4",), ("FY2024",), ("FY2024-Q1",), ("2024",)], "p string")
    got = {r.p: (r.n, r.b, r.i) for r in df.select("p", c.next_quarter("p").alias("n"), c.previous_quarter("p").alias("b"), c.quarter_index("p").alias("i")).collect()}
    assert got["FY2024-Q4"] == got["FY2024"] == ("FY2025-Q1", "FY2024-Q3", 8099)
    assert got["FY2024-Q1"][1] == "FY2023-Q4"
    assert got["2024"] == (None, None, None)


def test_safe_div_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (1.0, 4.0)], "a double, b double")
    assert [r.q for r in df.select(c.safe_div("a", "b").alias("q")).collect()] == [None, None, 0.25]


def test_annual_select_takes_the_year_by_its_end(spark):
    """The comparative of an earlier year bears the same year tag and accession and must not win."""
    base = [
        ("E", "revenue", 2025, 130.0, D("2024-01-29"), D("2025-01-26"), "10-K", D("2025-02-26"), "a", None),
        ("E", "revenue", 2025, 27.0, D("2022-01-31"), D("2023-01-29"), "10-K", D("2025-02-26"), "a", None),
        ("E", "revenue", 2025, 40.0, D("2024-10-28"), D("2025-01-26"), "10-K", D("2025-02-26"), "a", None),
    ]
    f = spark.createDataFrame(base, "entity string, metric string, fiscal_year int, value double, period_start date, period_end date, form_type string, filing_date date, accession string, frame string")
    f = fo.period_classify(f)
    ends = spark.createDataFrame([("E", 2025, D("2025-01-26")), ("E", 2023, D("2023-01-29"))], "entity string, fiscal_year int, fy_end date")
    got = {(r.fiscal_year, r.value): r.selection_rank for r in fo.annual_select(f, ends).collect()}
    assert got == {(2025, 130.0): 1, (2023, 27.0): 1, (2025, 40.0): None}


def test_split_factor_is_the_product_of_later_splits(spark):
    f = spark.createDataFrame([("E", "diluted_shares", D("2020-01-01"), 10.0), ("E", "diluted_eps", D("2021-08-01"), 10.0), ("F", "diluted_eps", D("2020-01-01"), 10.0)], "entity string, metric string, period_end date, value double")
    s = spark.createDataFrame([("E", D("2021-07-20"), 4.0), ("E", D("2024-06-10"), 10.0), ("E", D("2025-01-01"), 0.5)], "entity string, split_date date, ratio double")
    assert rows(fo.split_adjust(f, s), "entity", "metric", "adjustment_factor", "value") == [("E", "diluted_eps", 10.0, 1.0), ("E", "diluted_shares", 40.0, 400.0), ("F", "diluted_eps", 1.0, 10.0)]


def test_facts_from_json_and_bad_json(spark):
    doc = '{"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": [{"end": "2024-01-28", "val": 5, "accn": "a", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "bad"}]}}}}}'
    got = rd.facts_from_json(spark.createDataFrame([(doc,), ("{",)], "value string")).collect()
    assert [(r.entity, r.concept, r.unit, r.val, r.end, r.filed) for r in got] == [("7", "Revenues", "USD", 5.0, D("2024-01-28"), None)]


def test_locf_fills_three_days_of_a_gap(spark):
    p = spark.createDataFrame([("A", D("2024-01-01"), 1.0), ("A", D("2024-01-07"), 2.0)], "ticker string, date date, adj_close double").withColumn("source_available_date", F.col("date"))
    assert rows(ma.locf(p), "date", "adj_close") == [(D(f"2024-01-0{k}"), v) for k, v in ((1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (7, 2.0))]


def test_peer_staleness_boundary(spark):
    p = spark.createDataFrame([("a", D("2024-01-01")), ("b", D("2023-12-31")), ("c", None)], "ticker string, d date")
    assert rows(p.select("ticker", va.stale("d", "2024-03-31").alias("s")), "ticker", "s") == [("a", False), ("b", True), ("c", True)]


def test_ytd_to_quarter_and_annual_check(spark):
    m = [("E", "revenue", p, v, D("2024-01-01")) for p, v in (("FY2024-Q1", 10.0), ("FY2024-Q2", 25.0), ("FY2024-Q3", 45.0), ("FY2024", 70.0), ("FY2025-Q1", 5.0))]
    got = pa.ytd_to_quarter(spark.createDataFrame(m, "entity string, metric string, fiscal_period string, value double, source_available_date date"), ["revenue"])
    assert {r.fiscal_period: r.value for r in got.collect()} == {"FY2024-Q1": 10.0, "FY2024-Q2": 15.0, "FY2024-Q3": 20.0, "FY2024-Q4": 25.0, "FY2025-Q1": 5.0, "FY2025-Q2": None, "FY2025-Q3": None, "FY2025-Q4": None}


def test_growth_by_label_not_by_row(spark):
    p = spark.createDataFrame([("E", 1, 10.0), ("E", 2, 20.0), ("E", 4, 40.0), ("E", 5, -5.0)], "entity string, qidx int, revenue double")
    got = {r.qidx: (r.revenue_qoq, r.revenue_yoy) for r in pa.qoq_yoy(p, ["revenue"]).collect()}
    assert got == {1: (None, None), 2: (1.0, None), 4: (None, None), 5: (-1.125, -1.5)}


def test_later_prices_change_no_earlier_return(spark):
    p = [("A", D("2023-01-01") + dt.timedelta(days=k), 100.0 + k % 7) for k in range(500)]
    make = lambda r: spark.createDataFrame(r, "ticker string, date date, adj_close double")
    probes = spark.createDataFrame([("A", D("2024-03-01"))], "ticker string, as_of date")
    got = [rows(ma.trailing_return(probes, make(x), 90, out="r"), "r") for x in ([q for q in p if q[1] <= D("2024-03-01")], [*p, ("A", D("2024-03-02"), 1e6)])]
    assert got[0] == got[1] != [(None,)]


def test_as_of_needs_its_column(spark):
    with pytest.raises(ValueError, match="source_available_date"):
        ga.as_of(spark.createDataFrame([(1,)], "a int"), "2024-01-01")


def test_holidays(spark):
    days = spark.createDataFrame([(2024,)], "y int").select(F.array_sort(ga.federal_holidays(F.col("y"))).alias("h")).first().h
    assert [d.isoformat() for d in days] == ["2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"]


def test_dcf_against_a_loop(spark):
    i = spark.createDataFrame([("E", 100.0, 10.0, 5.0, 80.0)], "entity string, base_revenue double, net_cash double, diluted_shares double, price double")
    got = va.scenarios(i, va.scenario_table(spark)).where("scenario = 'base'").first()
    value = 0.0
    for t in range(1, 11):
        flow = 100 * 1.2**t * (0.35 - 0.05 * (t - 1) / 9)
        value += flow / 1.1**t
    value += flow * 1.03 / 0.07 / 1.1**10
    assert got.per_share == pytest.approx((value + 10) / 5, abs=1e-3)
    root = va.implied_cagr(i).first().implied_cagr
    assert va.implied_cagr(i).select(va.flat_dcf(F.lit(root), F.lit(0.3)).alias("v")).first().v == pytest.approx(80, rel=1e-4)


def test_walk_forward_against_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=12) * 0.1
    df = spark.createDataFrame([("E", D("2020-01-01") + dt.timedelta(days=i), f"P{i:02}", *map(float, x[i]), float(y[i])) for i in range(12)], "entity string, feature_available_date date, fiscal_period string, a double, b double, y double")
    got = {r.fold: r.prediction for r in md.walk_forward(df, ["a", "b"], "y", alpha=1.0, ridge=True).collect()}
    for i in range(3, 12):
        m, k = x[:i].mean(axis=0), y[:i].mean()
        w = np.linalg.solve((x[:i] - m).T @ (x[:i] - m) + np.eye(2), (x[:i] - m).T @ (y[:i] - k))
        assert got[i + 1] == pytest.approx(k + (x[i] - m) @ w, abs=1e-5)


def test_pooled_walk_forward_learns_from_earlier_days_only(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, days = rng.normal(size=(30, 2)), np.repeat(np.arange(10), 3)
    y = x @ [1.0, 3.0] + 0.5
    df = spark.createDataFrame([(f"E{i % 3}", f"P{d}", D("2020-01-01") + dt.timedelta(days=int(d)), *map(float, v), float(t)) for i, (d, v, t) in enumerate(zip(days, x, y, strict=True))], "entity string, fiscal_period string, feature_available_date date, a double, b double, y double")
    got = {(r.entity, r.fiscal_period): r for r in md.pooled_walk_forward(df, ["a", "b"], "y", alpha=1.0, ridge=True).collect()}
    assert len(got) == 24  # the first two days have under five rows before them
    for i in range(6, 30):
        own = days < days[i]
        m, k = x[own].mean(axis=0), y[own].mean()
        w = np.linalg.solve((x[own] - m).T @ (x[own] - m) + np.eye(2), (x[own] - m).T @ (y[own] - k))
        r = got[f"E{i % 3}", f"P{days[i]}"]
        assert r.n_train == own.sum() and r.prediction == pytest.approx(k + (x[i] - m) @ w, abs=1e-5)


def test_ttm_needs_four_consecutive_quarters(spark):
    q = spark.createDataFrame([("E", "revenue", f"FY202{y}-Q{k}", 1.0) for y, k in ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2))], "entity string, metric string, fiscal_period string, value double")
    assert rows(mo.ttm(q, "revenue"), "fiscal_period", "ttm")[-2:] == [("FY2020-Q4", 4.0), ("FY2021-Q2", None)]
    assert rows(mo.ttm(q, "revenue", strict=False), "fiscal_period", "ttm")[-1] == ("FY2021-Q2", 4.0)


def test_html_and_sections(spark):
    html = "<html><style>x</style><!-- c --><p>Item 1. Business</p><p>Item 7. Discussion</p><p>Item 1. Business</p><p>" + "long &amp; wide " * 20 + "</p><p>Item 7. Discussion</p><p>short</p></html>"
    f = spark.createDataFrame([("A", "10-K", html)], "accession string, form_type string, html string")
    got = {r.section_name: r for r in tx.parse_filings(f).collect()}
    assert got["business"].parse_status == "success" and "long & wide" in got["business"].text
    assert got["mda"].parse_status == "missing" and got["risk_factors"].text is None


def test_change_point_of_a_step(spark):
    s = spark.createDataFrame([("s", D("2020-01-01") + dt.timedelta(days=i), 0.0 if i < 10 else 5.0) for i in range(20)], "series string, date date, value double")
    assert [(r.break_date, r.available_date) for r in tx.change_points(s, penalty=3.0).collect()] == [(D("2020-01-11"), D("2020-01-20"))]


@pytest.mark.parametrize("seed", range(6))
def test_breaks_against_every_division(seed):
    """The least cost of all divisions into segments of two points at least, by the full kernel matrix."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.integers(0, 4), 0.3, rng.integers(2, 6)) for _ in range(3)]).round(2)
    n, d = len(x), (x[:, None] - x[None, :]) ** 2
    middle = np.median(d[np.triu_indices(n, 1)])
    assert tx.middle_gap(x) == pytest.approx(middle, rel=1e-9)
    k = np.exp(-np.clip(d / middle, 1e-2, 1e2))
    for step, penalty in ((1, 0.3), (1, 1.0), (2, 0.5), (5, 3.0)):
        costs = {}
        for r in range(n // 2):
            for cut in combinations(range(step, n, step), r):
                ends = [0, *cut, n]
                if all(b - a >= 2 for a, b in zip(ends[:-1], ends[1:], strict=True)):
                    costs[cut] = sum(np.trace(k[a:b, a:b]) - k[a:b, a:b].sum() / (b - a) + penalty for a, b in zip(ends[:-1], ends[1:], strict=True))
        got = tuple(tx.breaks(x, 2, step, penalty))
        assert costs[got] == pytest.approx(min(costs.values()), abs=1e-9)


def test_change_points_by_month_and_short_series(spark):
    rows = [("a", D("2020-01-01") + dt.timedelta(days=i), float(i >= 450)) for i in range(900)] + [("b", D("2020-01-01"), 1.0), ("c", D("2020-01-01"), None)]
    s = spark.createDataFrame(rows, "series string, date date, value double")
    got = [(r.series, r.break_date) for r in tx.change_points(s, period="month").collect()]
    assert got == [("a", D("2021-04-01"))]
    assert tx.change_points(s.limit(0)).count() == 0


def test_html_text_nodes_are_joined_by_line_ends(spark):
    import html
    import re

    pages = ["<p>a</p><p>b &amp; c</p>", "<div>x<br>\n\n\n\n y</div><script>no</script>", "", None, "a<!-- no --><style>no</style>b &eacute; &#33;", "<p> one </p> <p>two</p>"]
    got = [r.t for r in spark.createDataFrame([(p,) for p in pages], "h string").select(tx.html_to_text("h").alias("t")).collect()]

    def plain(p):
        nodes = [html.unescape(x) for x in re.split(r"(?:<[^>]*>)+", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", p))]
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "\n".join(nodes))).strip()

    assert got == [None if p is None else plain(p) for p in pages]


def test_keywords_of_one_and_of_several_words(spark):
    docs = spark.createDataFrame([(1, "Of the cat, of-the cat's CAT über-cat cats"), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.theme): r.score for r in tx.keyword_scores(docs, {"a": ["cat", "of the"], "b": ["über"]}).collect()}
    assert got[1, "a"] == round(5 / 8, 6) and got[1, "b"] == round(1 / 8, 6) and got[2, "a"] == 0


def test_fits_meet_their_optimality_conditions(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ [1.5, 0.0, -0.7] + 0.3 + rng.normal(0, 0.4, 80)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    fit = lambda **k: [r.coefficient for r in md.fit_linear(rows, ["a", "b", "c"], "y", **k).collect()]
    z, t = x - x.mean(axis=0), y - y.mean()
    *w, intercept = fit(alpha=2.0, ridge=True)
    assert w == pytest.approx(np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ t), abs=1e-4) and intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-4)
    *w, _ = fit(alpha=0.2, l1=0.5)
    slope = z.T @ (t - z @ w) / 80 - 0.2 * 0.5 * np.array(w)
    for g, c in zip(slope, w, strict=True):
        assert abs(g - 0.1 * np.sign(c)) < 2e-3 if abs(c) > 1e-6 else abs(g) <= 0.1 + 2e-3


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 140


def test_tree_walk_forward_predicts_every_quarter_past_the_history(spark):
    from inspect import signature

    from ledgerline.operators import trees as tr

    rows = spark.createDataFrame([(f"E{e}", 8100 + q, float(q), float(q + e)) for e in range(4) for q in range(6)], "entity string, qidx int, x double, y double")
    for kind in ("random_forest", "gradient_boosting"):
        got = tr.tree_walk_forward(rows, ["x"], "y", kinds=(kind,), trees=2).collect()
        assert sorted((r.entity, r.qidx) for r in got) == [(f"E{e}", 8103 + q) for e in range(4) for q in range(3)]
    assert tr.tree_walk_forward(rows.where("qidx < 8103"), ["x"], "y").count() == 0
    assert signature(tr.tree_walk_forward).parameters["trees"].default == 100


def test_topics_of_documents_of_all_languages(spark, tmp_path):
    from ledgerline.plans import text_queries as tq

    rows = [(k, f"word{k % 3} other{k % 2} " * 10 + f"rest{k % 4}", ["en", "de", None][k % 3]) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    weights, _ = tq.topics(spark, str(tmp_path))
    assert {r.doc_id for r in weights.select("doc_id").distinct().collect()} == set(range(12))


@pytest.mark.parametrize(("master", "local"), [("local", True), ("local[8]", True), ("local-cluster[3,1,1024]", False), ("spark://host:7077", False)])
def test_shared_folder_without_a_setting(master, local):
    from types import SimpleNamespace

    from ledgerline.functions.workers import shared_folder

    held = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
    if local:
        assert shared_folder(session) == held[0]
    else:
        with pytest.raises(ValueError):
            shared_folder(session)
