"""Volatility and beta from running sums against the definition, window by window."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

from ledgerline.operators import market as ma

DAY0 = dt.date(2001, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def table(seed):
    rng = random.Random(seed)
    rows = []
    for t in ("A", "B", "BENCH"):
        for n in range(300):
            if rng.random() < 0.7:
                rows.append((t, day(n), rng.choice([0.0, None] + [round(rng.uniform(5, 20), 2)] * 12)))
    return [*rows, ("FLAT", day(1), 5.0), *(("FLAT", day(k), 5.0) for k in range(2, 60))]


def changes(pairs, f):
    return [f(a, b) if a else None for a, b in zip(pairs, pairs[1:])]


def test_windows_against_the_definition(spark):
    rows = table(2)
    prices = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    asked = [(t, day(n)) for t in ("A", "B", "FLAT", "NONE") for n in (-3, 0, 5, 40, 61, 62, 130, 252, 299, 340, 380, 900)]
    probes = spark.createDataFrame([*asked, asked[3]], "ticker string, as_of date")
    vol = {(r.ticker, r.as_of): r.volatility_60d for r in ma.volatility(probes, prices).collect()}
    bet = {(r.ticker, r.as_of): r.beta_252d for r in ma.beta(probes, prices, "BENCH").collect()}
    bench = {d: p for t, d, p in rows if t == "BENCH" and p is not None}
    assert ma.volatility(probes, prices).count() == len(asked) + 1
    for t, a in asked:
        own = sorted((d, p) for tt, d, p in rows if tt == t and p is not None)
        near = [p for d, p in own if a - dt.timedelta(days=60) <= d <= a]
        r = [x for x in changes(near, lambda x, y: math.log(y / x) if y else None) if x is not None]
        want = statistics.stdev(r) * math.sqrt(252) if len(near) >= 10 and len(r) >= 5 else None
        assert (vol[t, a] is None) == (want is None) and (want is None or abs(vol[t, a] - want) < 2e-6), (t, a)
        both = [(p, bench[d]) for d, p in own if d in bench and a - dt.timedelta(days=252) <= d <= a]
        xs, ys = changes([p for p, _ in both], lambda x, y: y / x - 1), changes([b for _, b in both], lambda x, y: y / x - 1)
        pairs = [(x, y) for x, y in zip(xs, ys, strict=True) if x is not None and y is not None]
        want = None
        if len(both) >= 30 and len(pairs) >= 30:
            mx, my = (statistics.fmean(v) for v in zip(*pairs, strict=True))
            want = sum((x - mx) * (y - my) for x, y in pairs) / sum((y - my) ** 2 for _, y in pairs)
        assert (bet[t, a] is None) == (want is None) and (want is None or abs(bet[t, a] - want) < 2e-6), (t, a)


def test_prices_meet_no_probe_in_a_join(spark):
    prices = spark.createDataFrame(table(3), "ticker string, date date, adj_close double")
    probes = spark.createDataFrame([("A", day(100))], "ticker string, as_of date")
    plan = ma.window_sums(probes, prices.selectExpr("ticker", "date", "adj_close as r"), ["r"], 60, at="as_of")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
