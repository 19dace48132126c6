"""Ratios, growth and period metrics over the long fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import growth, quarter_index, safe_div

#: Metric: (formula over the pivoted facts, unit).
RATIOS = {
    "gross_margin": (lambda: safe_div("gross_profit", "revenue"), "ratio"),
    "operating_margin": (lambda: safe_div("operating_income", "revenue"), "ratio"),
    "net_margin": (lambda: safe_div("net_income", "revenue"), "ratio"),
    "roe": (lambda: safe_div("net_income", "shareholders_equity"), "ratio"),
    "roa": (lambda: safe_div("net_income", "total_assets"), "ratio"),
    "fcf": (lambda: F.col("operating_cash_flow") - F.col("capex"), "USD"),
    "fcf_margin": (lambda: safe_div(F.col("operating_cash_flow") - F.col("capex"), "revenue"), "ratio"),
    "debt_to_equity": (lambda: safe_div("total_debt", "shareholders_equity"), "ratio"),
    "current_ratio": (lambda: safe_div("current_assets", "current_liabilities"), "ratio"),
    "rd_pct_revenue": (lambda: safe_div("r_and_d", "revenue"), "ratio"),
    "sga_pct_revenue": (lambda: safe_div("sga", "revenue"), "ratio"),
    "diluted_eps": (lambda: F.col("diluted_eps"), "USD/shares"),
}
INPUTS = ["revenue", "gross_profit", "operating_income", "net_income", "shareholders_equity", "total_assets", "operating_cash_flow", "capex", "total_debt", "current_assets", "current_liabilities", "r_and_d", "sga", "diluted_eps"]
PASSED = ["revenue", "operating_income", "net_income", "operating_cash_flow", "capex", "total_assets", "total_debt", "cash_and_securities", "diluted_shares", "shareholders_equity", "gross_profit", "r_and_d"]
PERIOD = ["fiscal_year", "fiscal_period"]


def fact_pivot(facts: DataFrame, names: Sequence[str], *, entity: str = "entity") -> DataFrame:
    """One row for each period; a metric's first non-null value by filing date and accession."""
    first = F.min_by("value", F.struct("filing_date", "accession"))
    return facts.where("value is not null").groupBy(entity, *PERIOD).pivot("metric", list(names)).agg(first)


def ratios(facts: DataFrame, *, entity: str = "entity", digits: int = 6) -> DataFrame:
    """Twelve derived metrics, long; null on a missing input or a zero denominator."""
    first = lambda n: F.min_by(F.when(F.col("metric") == n, F.col("value")), F.when((F.col("metric") == n) & F.col("value").isNotNull(), F.struct("filing_date", "accession"))).alias(n)
    wide = facts.groupBy(entity, *PERIOD).agg(F.max("source_available_date").alias("source_available_date"), *(first(n) for n in INPUTS))
    made = wide.select(entity, *PERIOD, "source_available_date", *(F.round(f().cast("double"), digits).alias(f"m_{n}") for n, (f, _) in RATIOS.items()))
    unit = F.element_at(F.create_map(*[F.lit(x) for n, (_, u) in RATIOS.items() for x in (n, u)]), F.col("metric"))
    long = made.unpivot([entity, *PERIOD, "source_available_date"], [f"m_{n}" for n in RATIOS], "metric", "value").withColumn("metric", F.substring("metric", 3, 100))
    return long.select(entity, *PERIOD, "metric", "value", "source_available_date").withColumn("unit", unit)


def line_items(facts: DataFrame, names: Sequence[str] = tuple(PASSED), *, entity: str = "entity") -> DataFrame:
    return facts.where(F.col("metric").isin(*names)).select(entity, *PERIOD, "metric", "value", "unit", "source_available_date")


def yoy_growth(facts: DataFrame, names: Sequence[str] = ("revenue", "operating_income"), *, entity: str = "entity", contiguous: bool = True, digits: int = 6) -> DataFrame:
    """Growth of annual values on the year before; with contiguous=False on the previous year there is."""
    w = Window.partitionBy(entity, "metric").orderBy("fiscal_year")
    annual = facts.where((F.col("fp") == "FY") & F.col("metric").isin(*names))
    before, year = F.lag("value").over(w), F.lag("fiscal_year").over(w)
    if contiguous:
        before = F.when(year == F.col("fiscal_year") - 1, before)
    made = annual.withColumn("g", F.round(growth("value", before), digits))
    return made.where("g is not null").select(entity, *PERIOD, F.concat("metric", F.lit("_yoy")).alias("metric"), F.col("g").alias("value"), F.lit("ratio_yoy").alias("unit"), "source_available_date")


def segment_mix(segments: DataFrame, facts: DataFrame, *, entity: str = "entity", digits: int = 6) -> DataFrame:
    total = facts.where("metric = 'revenue'").select(entity, *PERIOD, F.col("value").alias("total"))
    return segments.join(total, [entity, *PERIOD]).withColumn("share", F.round(safe_div("value", "total"), digits)).where("share is not null").drop("total")


def ttm(quarterly: DataFrame, metric: str, *, entity: str = "entity", strict: bool = True, digits: int = 4) -> DataFrame:
    """Sum of the last four quarters; null unless there are four. strict: they must be four consecutive ones with values."""
    w = Window.partitionBy(entity).orderBy("qidx")
    four = w.rowsBetween(-3, 0)
    rows = quarterly.where((F.col("metric") == metric) & F.col("fiscal_period").rlike("-Q[1-4]$")).withColumn("qidx", quarter_index("fiscal_period"))
    n, span = F.count("*" if not strict else "value").over(four), F.col("qidx") - F.min("qidx").over(four)
    whole = (n == 4) & ((span == 3) if strict else F.lit(True))
    return rows.select(entity, "fiscal_period", F.when(whole, F.round(F.sum("value").over(four), digits)).alias("ttm"), n.alias("periods_used"))


def inflection_flags(metrics: DataFrame, *, entity: str = "entity", expanding: bool = False) -> DataFrame:
    """Ratios more than two sample deviations from the mean of their metric (three values at least, some spread)."""
    w = Window.partitionBy(entity, "metric")
    if expanding:
        w = w.orderBy("source_available_date", "fiscal_period").rowsBetween(Window.unboundedPreceding, 0)
    far = F.abs(F.col("value") - F.avg("value").over(w)) > 2 * F.stddev_samp("value").over(w)
    sure = (F.count("value").over(w) >= 3) & (F.stddev_samp("value").over(w) > 1e-12)
    return metrics.withColumn("is_inflection", F.when(F.col("unit").isin("ratio", "ratio_yoy"), F.coalesce(far & sure, F.lit(False))).otherwise(False))


def latest_annual_value(metrics: DataFrame, *, entity: str = "entity") -> DataFrame:
    """The latest non-null annual value of each metric, else the latest of any period."""
    rank = F.struct(F.col("fiscal_period").rlike(r"^FY\d{4}$"), F.col("fiscal_period"))
    return metrics.where("value is not null").groupBy(entity, "metric").agg(F.max_by("value", rank).alias("value"), F.max_by("fiscal_period", rank).alias("fiscal_period"))


def valuation_inputs(metrics: DataFrame, prices: DataFrame, *, entity: str = "entity", ticker: str = "ticker", price_date: str = "2001-12-31") -> DataFrame:
    """Base revenue, net cash (cash less debt), diluted shares over 0 and the last price over 0 on or before a date."""
    wide = latest_annual_value(metrics, entity=entity).groupBy(entity).pivot("metric", ["revenue", "cash_and_securities", "total_debt", "short_term_debt", "long_term_debt", "diluted_shares"]).agg(F.first("value"))
    debt = F.coalesce(F.nullif("total_debt", F.lit(0.0)), F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0)))
    last = prices.where((F.col("date") <= F.lit(price_date).cast("date")) & (F.col("adj_close") > 0)).groupBy(F.col(ticker).alias(entity)).agg(F.max_by("adj_close", "date").alias("price"))
    return wide.join(last, entity, "left").select(
        entity, F.col("revenue").alias("base_revenue"), F.round(F.coalesce("cash_and_securities", F.lit(0.0)) - debt, 4).alias("net_cash"),
        F.when(F.col("diluted_shares") > 0, F.col("diluted_shares")).alias("diluted_shares"), "price",
    )


def subject_peer_row(metrics: DataFrame, inputs: DataFrame, *, entity: str = "entity") -> DataFrame:
    """An entity in the shape of the peer table: EBITDA is operating income, market cap price times shares."""
    wide = latest_annual_value(metrics, entity=entity).groupBy(entity).pivot("metric", ["total_debt", "cash_and_securities", "operating_income", "net_income", "operating_cash_flow", "capex"]).agg(F.first("value"))
    return inputs.join(wide, entity).select(
        F.col(entity).alias("ticker"), F.round(F.col("price") * F.col("diluted_shares"), 4).alias("market_cap"), "total_debt", "cash_and_securities", F.col("base_revenue").alias("revenue"),
        F.col("operating_income").alias("ebitda"), "net_income", F.round(F.col("operating_cash_flow") - F.col("capex"), 4).alias("free_cash_flow"),
    )


def fcf_margin_reconcile(metrics: DataFrame, scenarios: DataFrame, *, entity: str = "entity", digits: int = 6) -> DataFrame:
    """Latest historical free-cash-flow margin against the base scenario's start and terminal margins."""
    base = F.broadcast(scenarios.where("scenario = 'base'").select("fcf_margin_start", "fcf_margin_terminal"))  # one row
    latest = latest_annual_value(metrics.where("metric = 'fcf_margin'"), entity=entity)
    return latest.crossJoin(base).select(entity, "fiscal_period", F.col("value").alias("historical"), "fcf_margin_start", "fcf_margin_terminal", F.round(F.col("value") - F.col("fcf_margin_start"), digits).alias("gap"))


def historical_table(metrics: DataFrame, *, entity: str = "entity") -> DataFrame:
    names = ["revenue", "net_income", "operating_cash_flow", "r_and_d", "gross_margin", "operating_margin"]
    annual = metrics.where(F.col("fiscal_period").rlike(r"^FY\d{4}$") & F.col("metric").isin(*names))
    return annual.groupBy(entity, "fiscal_year").pivot("metric", names).agg(F.first("value", ignorenulls=True))
