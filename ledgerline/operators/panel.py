"""The quarterly panel: true quarters from year-to-date figures, growth by label, attached features, targets, no look-ahead."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import fiscal_quarter, fiscal_year, growth, no_nan, quarter_index, quarter_label, safe_div
from ledgerline.operators.market import as_of_backward, as_of_forward

RATIO_NAMES = ("gross_margin", "operating_margin", "net_margin", "fcf_margin", "roe", "roa", "debt_to_equity", "current_ratio", "rd_pct_revenue", "sga_pct_revenue")
FLOW_NAMES = ("revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "capex", "r_and_d")


def skeleton(metrics: DataFrame, *, entity: str = "entity") -> DataFrame:
    """One row for each quarter with a revenue row; the latest available wins."""
    w = Window.partitionBy(entity, "fiscal_period").orderBy(F.desc_nulls_last("source_available_date"), F.desc("value"))
    rows = metrics.where((F.col("metric") == "revenue") & F.col("fiscal_period").rlike(r"^FY\d{4}-Q[1-4]$"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(entity, "fiscal_period", quarter_index("fiscal_period").alias("qidx"), F.col("source_available_date").alias("feature_available_date"))


def ytd_to_quarter(metrics: DataFrame, names: Sequence[str] = FLOW_NAMES, *, entity: str = "entity", tolerance: float = 0.01, digits: int = 4) -> DataFrame:
    """(entity, metric, fiscal_period, qidx, value, imputed): Q1 as filed, Qn less Qn-1, Q4 from the annual figure, else from YTD 4.

    All four labels of a year are given. If all four are there and do not sum to the annual figure within 1 %, the year is imputed.
    """
    rows = metrics.where(F.col("metric").isin(*names)).withColumn("fy", fiscal_year("fiscal_period")).withColumn("q", F.coalesce(fiscal_quarter("fiscal_period"), F.lit(0))).where("fy is not null")
    last = lambda q: F.max_by(F.when(F.col("q") == q, F.col("value")), F.when((F.col("q") == q) & F.col("value").isNotNull(), F.struct("source_available_date", "value")))
    wide = rows.groupBy(entity, "metric", "fy").agg(last(0).alias("fy_value"), *(last(q).alias(f"y{q}") for q in (1, 2, 3, 4)))
    q4 = F.coalesce(F.col("fy_value") - F.col("y3"), F.col("y4") - F.col("y3"))
    own = [F.col("y1"), F.col("y2") - F.col("y1"), F.col("y3") - F.col("y2"), q4]
    off = F.coalesce(F.abs(reduce(lambda a, b: a + b, own) - F.col("fy_value")) > tolerance * F.abs("fy_value"), F.lit(False))
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.round(v, digits).alias("value")) for k, v in enumerate(own)))
    out = wide.select(entity, "metric", "fy", off.alias("imputed"), F.explode(parts).alias("p")).withColumn("qidx", F.col("fy") * 4 + F.col("p.k"))
    return out.select(entity, "metric", quarter_label("qidx").alias("fiscal_period"), "qidx", F.col("p.value").alias("value"), "imputed")


def ratio_attach(panel: DataFrame, metrics: DataFrame, names: Sequence[str] = RATIO_NAMES, *, entity: str = "entity") -> DataFrame:
    rows = metrics.where(F.col("metric").isin(*names) & F.col("value").isNotNull())
    wide = rows.groupBy(entity, "fiscal_period").pivot("metric", list(names)).agg(F.max_by("value", F.struct("source_available_date", "value")))
    return panel.join(wide, [entity, "fiscal_period"], "left")


def at_offset(value: str, by: int, *, entity: str = "entity") -> Column:
    """value of the quarter `by` away, found by its index: a gap gives null. All offsets share one sort."""
    return F.first(value).over(Window.partitionBy(entity).orderBy("qidx").rangeBetween(by, by))


def qoq_yoy(panel: DataFrame, names: Sequence[str], *, entity: str = "entity", digits: int = 6) -> DataFrame:
    """Growth by |prior| on the quarter before and on the same quarter of the year before."""
    made = {f"{n}_{tag}": F.round(growth(n, at_offset(n, -back, entity=entity), absolute=True), digits) for back, tag in ((1, "qoq"), (4, "yoy")) for n in names}
    return panel.withColumns(made)


def intensity(panel: DataFrame, *, digits: int = 6) -> DataFrame:
    return panel.withColumn("rd_intensity", F.round(no_nan(safe_div("r_and_d", "revenue")), digits)).withColumn("capex_intensity", F.round(no_nan(safe_div("capex", "revenue")), digits))


def operating_leverage(panel: DataFrame, *, entity: str = "entity", digits: int = 6) -> DataFrame:
    income, sales = (F.col(n) - at_offset(n, -4, entity=entity) for n in ("operating_income", "revenue"))
    return panel.withColumn("operating_leverage", F.round(safe_div(income, sales), digits))


def attach_text_features(panel: DataFrame, features: DataFrame, names: Sequence[str], *, key: str = "accession") -> DataFrame:
    """nlp_<section>_<name> columns by accession, the last by filing date; nothing is carried on."""
    name = F.concat(F.lit("nlp_"), F.col("section"), F.lit("_"), F.col("feature_name"))
    wide = features.withColumn("__n", name).groupBy(key).pivot("__n", list(names)).agg(F.max_by("value", F.struct("filing_date", "value")))
    return panel.join(wide, key, "left")


def attach_market(panel: DataFrame, market: DataFrame, *, entity: str = "entity") -> DataFrame:
    rows = market.withColumnRenamed("as_of", "feature_available_date").withColumnRenamed("ticker", entity)
    return panel.join(rows, [entity, "feature_available_date"], "left")


def target_primary(panel: DataFrame, growth_column: str, *, entity: str = "entity") -> DataFrame:
    """The next quarter's growth and the day it is known; null unless that quarter is in the panel."""
    later = {"target_period": "fiscal_period", "target_value": growth_column, "target_available_date": "feature_available_date"}
    return panel.withColumns({new: at_offset(old, 1, entity=entity) for new, old in later.items()})


def target_secondary(panel: DataFrame, metrics: DataFrame, *, entity: str = "entity", metric: str = "revenue", digits: int = 6) -> DataFrame:
    """The next fiscal year's growth, (next - current) / current, with its label and the day it is known."""
    annual = metrics.where((F.col("metric") == metric) & F.col("fiscal_period").rlike(r"^FY\d{4}$")).groupBy(entity, fiscal_year("fiscal_period").alias("fy")).agg(
        F.max_by("value", "source_available_date").alias("v"), F.max("source_available_date").alias("d")
    )
    now = annual.select(entity, "fy", F.col("v").alias("__now"))
    then = annual.select(entity, (F.col("fy") - 1).alias("fy"), F.col("v").alias("__next"), F.col("d").alias("annual_target_date"))
    rows = panel.withColumn("fy", F.floor(F.col("qidx") / 4).cast("int")).join(now, [entity, "fy"], "left").join(then, [entity, "fy"], "left")
    return rows.withColumn("annual_target_period", F.concat(F.lit("FY"), (F.col("fy") + 1).cast("string"))).withColumn("annual_target", F.round(growth("__next", "__now"), digits)).drop("__now", "__next", "fy")


def target_tertiary(panel: DataFrame, prices: DataFrame, *, benchmark: str, ticker: str = "entity", at: str = "feature_available_date", days: int = 365) -> DataFrame:
    """1 if the forward return, last price up to the day to the first one a year on, strictly beats the benchmark's; else 0; null without a price."""
    out = panel.withColumn("__later", F.date_add(at, days)).withColumn("__bench", F.lit(benchmark))
    p = prices.withColumnRenamed("ticker", "__k")
    for leg, key in (("own", ticker), ("bench", "__bench")):
        out = out.withColumn("__k", F.col(key))
        out = as_of_backward(out, p, at=at, key="__k", out=f"__{leg}_from")
        out = as_of_forward(out, p, at="__later", key="__k", out=f"__{leg}_to").drop("__k")
    r = {leg: safe_div(F.nullif(f"__{leg}_to", F.lit(0.0)), f"__{leg}_from") for leg in ("own", "bench")}
    return out.withColumn("beats_benchmark", F.when(r["own"].isNotNull() & r["bench"].isNotNull(), (r["own"] > r["bench"]).cast("int"))).drop("__later", "__bench", *(f"__{a}_{b}" for a in ("own", "bench") for b in ("from", "to")))


def flag_lookahead(panel: DataFrame) -> DataFrame:
    """lookahead_violation: a target is set and was known when the features were."""
    bad = F.col("target_value").isNotNull() & (F.col("feature_available_date") >= F.col("target_available_date"))
    return panel.withColumn("lookahead_violation", F.coalesce(bad, F.lit(False)))


def fundamentals(metrics: DataFrame, names: Sequence[str] = FLOW_NAMES, *, entity: str = "entity") -> DataFrame:
    """Skeleton, true quarters, ratios, growth, intensity and leverage."""
    flows = ytd_to_quarter(metrics, names, entity=entity)
    wide = flows.groupBy(entity, "fiscal_period").pivot("metric", list(names)).agg(F.first("value"))
    imputed = flows.groupBy(entity, "fiscal_period").agg(F.bool_or("imputed").alias("imputed"))
    panel = skeleton(metrics, entity=entity).join(wide, [entity, "fiscal_period"], "left").join(imputed, [entity, "fiscal_period"], "left")
    panel = ratio_attach(panel, metrics, entity=entity)
    return operating_leverage(intensity(qoq_yoy(panel, ["revenue", "operating_income"], entity=entity)), entity=entity)


def build_panel(metrics: DataFrame, prices: DataFrame | None = None, *, benchmark: str | None = None, market: DataFrame | None = None, entity: str = "entity") -> DataFrame:
    panel = fundamentals(metrics, entity=entity)
    if market is not None:
        panel = attach_market(panel, market, entity=entity)
    panel = target_secondary(target_primary(panel, "revenue_yoy", entity=entity), metrics, entity=entity)
    if prices is not None:
        panel = target_tertiary(panel, prices, benchmark=benchmark, ticker=entity)
    return flag_lookahead(panel)
