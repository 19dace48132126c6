"""Discounted cash flows, scenarios, grids, reverse solutions, peers and ratings. An entity is a row; grids are tidy rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import col, safe_div

#: Scenario, probability, revenue growth, margin at the start and the end, terminal growth.
SCENARIOS = [("bear", 0.25, 0.10, 0.30, 0.25, 0.025), ("base", 0.50, 0.20, 0.35, 0.30, 0.03), ("bull", 0.25, 0.30, 0.40, 0.35, 0.035)]
WACC, YEARS, MIN_SPREAD, TERMINAL_CAP = 0.10, 10, 0.005, 200.0


def scenario_table(spark, rows: Sequence[tuple] = SCENARIOS) -> DataFrame:
    return spark.createDataFrame(list(rows), "scenario string, probability double, revenue_cagr double, fcf_margin_start double, fcf_margin_terminal double, terminal_growth double")


def present_value(revenue, cagr, start, terminal, wacc, growth, years: int = YEARS) -> tuple[Column, Column]:
    """(sum of discounted flows, discounted terminal value), as an unrolled sum of `years` terms."""
    revenue, cagr, start, terminal, wacc, growth = (col(c) if isinstance(c, str | Column) else F.lit(float(c)) for c in (revenue, cagr, start, terminal, wacc, growth))
    flows = []
    for t in range(1, years + 1):
        share = (t - 1) / (years - 1) if years > 1 else 0.0
        flows.append(revenue * F.pow(1 + cagr, F.lit(t)) * (start + (terminal - start) * share))
    total = sum((f / F.pow(1 + wacc, F.lit(t)) for t, f in enumerate(flows, 1)), F.lit(0.0))
    spread, last = wacc - growth, flows[-1]
    cap = last * TERMINAL_CAP
    gordon = last * (1 + growth) / F.nullif(spread, F.lit(0.0))
    end = F.when(spread > MIN_SPREAD, gordon).when(spread <= 0, cap).otherwise(F.least(gordon, cap))
    return total, end / F.pow(1 + wacc, F.lit(years))


def dcf(rows: DataFrame, *, wacc: float | str = WACC, years: int = YEARS, digits: int = 4) -> DataFrame:
    """rows (base_revenue, net_cash, diluted_shares and a scenario's columns) with enterprise, equity and per-share value."""
    flows, end = present_value("base_revenue", "revenue_cagr", "fcf_margin_start", "fcf_margin_terminal", wacc, "terminal_growth", years)
    ev = flows + end
    return (
        rows.withColumn("enterprise_value", F.round(ev, digits)).withColumn("equity_value", F.round(ev + F.col("net_cash"), digits))
        .withColumn("per_share", F.round(F.when(F.col("diluted_shares") > 0, (ev + F.col("net_cash")) / F.col("diluted_shares")).otherwise(0.0), digits))
    )


def scenarios(inputs: DataFrame, table: DataFrame, **options) -> DataFrame:
    """DCF of every entity in every scenario; the scenario table has a few rows."""
    return dcf(inputs.crossJoin(F.broadcast(table)), **options)


def spread_over(inputs: DataFrame, **ranges: Sequence[float]) -> DataFrame:
    """Each row once for each combination of the given values."""
    for name, values in ranges.items():
        inputs = inputs.withColumn(name, F.explode(F.lit([float(v) for v in values])))
    return inputs


def sensitivity_grid(inputs: DataFrame, base: DataFrame, *, waccs: Sequence[float] = (0.08, 0.09, 0.10, 0.11, 0.12), growths: Sequence[float] = (0.02, 0.025, 0.03, 0.035, 0.04), digits: int = 4) -> DataFrame:
    rows = spread_over(inputs.crossJoin(F.broadcast(base.where("scenario = 'base'").drop("terminal_growth"))), wacc=waccs, terminal_growth=growths)
    return dcf(rows, wacc="wacc", digits=digits).select("entity", "wacc", "terminal_growth", "per_share")


def flat_dcf(cagr, margin, wacc: float = WACC, growth: float = 0.03, years: int = YEARS) -> Column:
    """Equity value a share at a flat margin."""
    flows, end = present_value("base_revenue", cagr, margin, margin, wacc, growth, years)
    return F.when(F.col("diluted_shares") > 0, (flows + end + F.col("net_cash")) / F.col("diluted_shares")).otherwise(0.0)


def reverse_dcf_grid(inputs: DataFrame, *, cagrs: Sequence[float] = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3), margins: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5), near: float = 0.1, digits: int = 4) -> DataFrame:
    """Growth times margin; cells within 10 % of the price are marked. Whether the price lies in the grid's range is told too."""
    w = Window.partitionBy("entity")
    grid = spread_over(inputs, cagr=cagrs, margin=margins).withColumn("per_share", F.round(flat_dcf("cagr", "margin"), digits))
    off = F.abs(safe_div(F.col("per_share") - F.col("price"), "price"))
    return grid.select(
        "entity", "cagr", "margin", "per_share", F.coalesce(off <= near, F.lit(False)).alias("highlight"),
        F.col("price").between(F.min("per_share").over(w), F.max("per_share").over(w)).alias("price_in_grid"),
    )


def implied_cagr(inputs: DataFrame, *, margin: float = 0.3, low: float = -0.5, high: float = 1.5, steps: int = 60, digits: int = 6) -> DataFrame:
    """The growth at which the DCF equals the price, by bisection within each row; null if [low, high] does not bracket it."""
    gap = lambda g: flat_dcf(g, F.lit(margin)) - F.col("price")

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = gap(mid) > 0
        return F.struct(F.when(above, s["lo"]).otherwise(mid).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    bracketed = (gap(F.lit(low)) <= 0) & (gap(F.lit(high)) >= 0) & (F.col("diluted_shares") > 0)
    return inputs.withColumn("implied_cagr", F.when(bracketed, F.round(found, digits)))


def implied_margin(inputs: DataFrame, *, cagr: float = 0.2, low: float = 0.01, high: float = 0.90, digits: int = 6) -> DataFrame:
    """The flat margin at which the DCF equals the price; the value is linear in it. Null outside [low, high]."""
    flows, end = present_value("base_revenue", F.lit(cagr), F.lit(1.0), F.lit(1.0), WACC, 0.03)
    m = safe_div(F.col("price") * F.col("diluted_shares") - F.col("net_cash"), flows + end)
    return inputs.withColumn("implied_margin", F.when(m.between(low, high) & (F.col("diluted_shares") > 0), F.round(m, digits)))


def plausibility(value: Column | str, low: float, high: float) -> Column:
    """within; above or below by at most 0.10; far; no convergence."""
    v = col(value)
    return (
        F.when(v.isNull(), "no_convergence").when(v.between(low, high), "within").when((v > high) & (v - high <= 0.10), "above").when((v < low) & (low - v <= 0.10), "below").otherwise("far")
    )


def peer_multiples(peers: DataFrame, *, digits: int = 6) -> DataFrame:
    cash = F.coalesce(*(F.col(c) for c in ("cash_and_securities", "total_cash") if c in peers.columns))
    ev = F.col("market_cap") + F.col("total_debt") - cash
    return (
        peers.withColumn("ev", F.round(ev, 4)).withColumn("ev_revenue", F.round(safe_div(ev, "revenue"), digits)).withColumn("ev_ebitda", F.round(safe_div(ev, "ebitda"), digits))
        .withColumn("pe", F.round(safe_div("market_cap", "net_income"), digits)).withColumn("fcf_yield", F.round(safe_div("free_cash_flow", "market_cap"), digits))
    )


def stale(source: Column | str, report_date: str, max_age_days: int = 90) -> Column:
    """Older than max_age_days on the report date, or without a date."""
    return F.coalesce(F.date_diff(F.lit(report_date).cast("date"), col(source)) > max_age_days, F.lit(True))


def peer_filter(multiples: DataFrame, tiers: DataFrame, *, report_date: str, max_age_days: int = 90) -> DataFrame:
    """Tier (context if unknown) and the first status that applies; multiples that a status spoils become null."""
    status = (
        F.when(stale("source_date", report_date, max_age_days), "stale").when(F.col("ev").isNull(), "missing_ev").when(F.col("ev") < 0, "negative_ev")
        .when(F.col("ebitda") <= 0, "negative_ebitda").when(F.col("net_income") <= 0, "negative_earnings").otherwise("ok")
    )
    out = multiples.join(tiers, "ticker", "left").withColumn("tier", F.coalesce("tier", F.lit("context"))).withColumn("status", status)
    gone = F.col("status").isin("stale", "missing_ev", "negative_ev")
    return (
        out.withColumn("ev_revenue", F.when(~gone, F.col("ev_revenue"))).withColumn("ev_ebitda", F.when(~gone & (F.col("ebitda") > 0), F.col("ev_ebitda")))
        .withColumn("pe", F.when((F.col("status") != "stale") & (F.col("net_income") > 0), F.col("pe")))
    )


def limited_sample(filtered: DataFrame, *, by: str, least: int = 3) -> DataFrame:
    n = F.count_if((F.col("tier") == "semi") & F.col("ev_revenue").isNotNull())
    return filtered.groupBy(by).agg(n.alias("n_usable"), (n < least).alias("limited"))


def clean_peer_table(multiples: DataFrame, tiers: DataFrame, *, report_date: str, tier: str = "core") -> DataFrame:
    """Peers of a tier with every reason against them."""
    reasons = F.array_compact(F.array(
        F.when(F.col("ev") < 0, "negative_ev"), F.when(F.col("ebitda") <= 0, "negative_ebitda"), F.when(F.col("net_income") <= 0, "negative_earnings"), F.when(stale("source_date", report_date), "stale")
    ))
    rows = multiples.join(tiers.where(F.col("tier") == tier), "ticker")
    return rows.withColumn("included", F.size(reasons) == 0).withColumn("reasons", F.concat_ws(";", reasons))


def sanity_checks(rated: DataFrame, grid: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Notes: value far from price, no grid cell near it, deep bear case, no sensitivity cell near it."""
    near = grid.groupBy("entity").agg(F.bool_or("highlight").alias("grid_hit"))
    range_ = sensitivity.groupBy("entity").agg(F.min("per_share").alias("low"), F.max("per_share").alias("high"))
    off = safe_div(F.col("expected_value") - F.col("price"), "price")
    notes = F.array_compact(F.array(
        F.when(F.abs(off) > 0.5, "divergence"), F.when(~F.col("grid_hit"), "no_grid_cell"), F.when(safe_div(F.col("bear") - F.col("price"), "price") < -0.4, "bear_downside"),
        F.when(~F.col("price").between(F.col("low"), F.col("high")), "sensitivity_miss"),
    ))
    return rated.join(near, "entity").join(range_, "entity").select("entity", F.concat_ws(";", notes).alias("notes"))


def recommend(valued: DataFrame, *, eligible: Column | None = None, digits: int = 6) -> DataFrame:
    """Expected value over scenarios and the proposal: Buy, Hold, Sell or Not Rated."""
    case = lambda s: F.max(F.when(F.col("scenario") == s, F.col("per_share")))
    wide = valued.groupBy("entity").agg(F.sum(F.col("probability") * F.col("per_share")).alias("ev"), case("bear").alias("bear"), case("base").alias("base"), case("bull").alias("bull"), F.first("price").alias("price"))
    up = {c: safe_div(F.col(c) - F.col("price"), "price") for c in ("ev", "base", "bear")}
    ok = F.lit(True) if eligible is None else eligible
    rating = F.when(~ok | up["ev"].isNull(), "Not Rated").when((up["ev"] >= 0.15) & (up["base"] >= 0.15) & (up["bear"] >= -0.25), "Buy").when(up["ev"] <= -0.20, "Sell").otherwise("Hold")
    return wide.select("entity", F.round("ev", 4).alias("expected_value"), F.round(up["ev"], digits).alias("upside"), "bear", "base", "bull", "price", rating.alias("rating"))


def final_rating(upside: Column | str, eligible: Column) -> Column:
    """Over 15 % Buy, under -20 % Sell, else Hold; Not Rated without a value or eligibility."""
    u = col(upside)
    return F.when(~eligible | u.isNull(), "Not Rated").when(u > 0.15, "Buy").when(u < -0.20, "Sell").otherwise("Hold")


def analyst_consensus(counts: DataFrame, *, entity: str = "entity", period: str = "period", digits: int = 4) -> DataFrame:
    """Mean recommendation (1 strong buy .. 5 strong sell), its change on the month before, net revisions."""
    n = F.col("strong_buy") + F.col("buy") + F.col("hold") + F.col("sell") + F.col("strong_sell")
    mean = safe_div(F.col("strong_buy") + 2 * F.col("buy") + 3 * F.col("hold") + 4 * F.col("sell") + 5 * F.col("strong_sell"), n)
    w = Window.partitionBy(entity).orderBy(period)
    before = F.when(F.lag(period).over(w) == F.col(period) - 1, F.lag(mean).over(w))
    return counts.select(entity, period, F.round(mean, digits).alias("recommendation_mean"), F.round(mean - before, digits).alias("delta"), (F.col("up") - F.col("down")).alias("net_revisions"))


def analyst_overlay(rows: DataFrame, *, prediction: str = "prediction", consensus: Sequence[str] = ("growth_next", "growth_current")) -> DataFrame:
    """Difference in points from the consensus: concur under 2, moderate under 5, else large; and its direction."""
    delta = (F.col(prediction) - F.coalesce(*consensus)) * 100
    size = F.when(delta.isNull(), "unavailable").when(F.abs(delta) < 2, "concur").when(F.abs(delta) < 5, "moderate").otherwise("large")
    return rows.withColumn("delta_pp", F.round(delta, 4)).withColumn("size", size).withColumn("direction", F.when(delta > 0, "above").when(delta < 0, "below").when(delta == 0, "equal"))
