"""Fact resolution: from nested filed facts to one trusted value for each entity, metric and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import duration_days, period_type
from ledgerline.functions.tables import small

#: XBRL concepts of each metric, the preferred one first.
CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"],
    "cogs": ["CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfRevenue", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss", "IncomeLossFromContinuingOperations"],
    "net_income": ["NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLoss"],
    "diluted_eps": ["EarningsPerShareDiluted"],
    "r_and_d": ["ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"],
    "sga": ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquireProductiveAssets", "PaymentsToAcquirePropertyPlantAndEquipment", "CapitalExpenditureDiscontinuedOperations"],
    "stock_based_compensation": ["ShareBasedCompensation", "AllocatedShareBasedCompensationExpense", "ShareBasedCompensationIncludingDiscontinuedOperations"],
    "cash_and_securities": ["CashCashEquivalentsAndShortTermInvestments", "CashAndCashEquivalentsAtCarryingValue"],
    "short_term_debt": ["ShortTermBorrowings", "ShortTermDebtCurrent", "DebtCurrent"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"],
    "total_debt": ["LongTermDebt", "DebtAndCapitalLeaseObligations", "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities", "Debt"],
    "total_assets": ["Assets"],
    "shareholders_equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "diluted_shares": ["WeightedAverageNumberOfDilutedSharesOutstanding", "CommonStockSharesOutstanding", "WeightedAverageNumberDilutedSharesOutstandingAdjustment"],
    "segment_revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"],
}
#: The preferred units, and the forms from the most to the least trusted.
UNITS = ("USD", "USD/shares", "shares")
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
PER_SHARE, SHARES = ("diluted_eps",), ("diluted_shares",)


def concept_map(spark, concepts: dict[str, Sequence[str]] = CONCEPTS) -> DataFrame:
    """(metric, concept, priority) as a table; it has one row for each concept named."""
    return spark.createDataFrame([(m, c, k) for m, cs in concepts.items() for k, c in enumerate(cs)], "metric string, concept string, priority int")


def form_rank(form: Column | str = "form_type") -> Column:
    form = F.col(form) if isinstance(form, str) else form
    rank = F.lit(99)
    for k, f in reversed(list(enumerate(FORMS))):
        rank = F.when(form == f, k).otherwise(rank)
    return rank


def unit_pick(facts: DataFrame, *, entity: str = "entity") -> DataFrame:
    """For each concept the facts of one unit: USD, else USD/shares, else shares, else the first by name."""
    rank = F.lit(len(UNITS))
    for k, u in reversed(list(enumerate(UNITS))):
        rank = F.when(F.col("unit") == u, k).otherwise(rank)
    best = facts.groupBy(entity, "concept").agg(F.min_by("unit", F.struct(rank, F.col("unit"))).alias("unit"))
    return facts.join(best, [entity, "concept", "unit"])


def metric_unit(metric: Column | str, unit: Column | str) -> Column:
    """The unit found, else the metric's usual one."""
    metric, unit = (F.col(c) if isinstance(c, str) else c for c in (metric, unit))
    return F.coalesce(unit, F.when(metric.isin(*PER_SHARE), "USD/shares").when(metric.isin(*SHARES), "shares").otherwise("USD"))


def concept_merge(facts: DataFrame, concepts: DataFrame, *, entity: str = "entity") -> DataFrame:
    """Facts of all of a metric's concepts; for one (fy, fp, start, end) the preferred concept's, then the latest filed."""
    w = Window.partitionBy(entity, "metric", "fy", "fp", "start", "end").orderBy("priority", F.desc_nulls_last("filed"), F.desc("accn"), F.desc("val"))
    return facts.join(small(concepts), "concept").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "priority")


def period_classify(facts: DataFrame, *, start: str = "period_start", end: str = "period_end") -> DataFrame:
    return facts.withColumn("duration_days", duration_days(start, end)).withColumn("period_type", period_type(start, "duration_days"))


def fiscal_year_ends(facts: DataFrame, published: DataFrame | None = None, *, entity: str = "entity") -> DataFrame:
    """(entity, fiscal_year, fy_end): the latest end among annual 10-K facts; published ends fill gaps only."""
    own = facts.where(F.col("form_type").isin("10-K", "10-K/A") & (F.col("period_type") == "annual")).groupBy(entity, "fiscal_year").agg(F.max("period_end").alias("fy_end"))
    if published is None:
        return own
    return own.join(published.withColumnRenamed("fy_end", "published_end"), [entity, "fiscal_year"], "full").select(entity, "fiscal_year", F.coalesce("fy_end", "published_end").alias("fy_end"))


def annual_select(facts: DataFrame, ends: DataFrame, *, entity: str = "entity", tolerance_days: int = 5, shortest: int = 340) -> DataFrame:
    """For each metric and fiscal year the annual fact that ends with the year, whatever year it is tagged with.

    Within five days of the year's end, 340 days or longer; 10-K forms before frame-tagged facts before others, then the
    latest filed, then the greatest accession. Annual facts that match no year are dropped; other facts pass unchanged
    with a null rank. facts needs period_type, duration_days and frame.
    """
    near = F.abs(F.date_diff(F.col("period_end"), F.col("fy_end"))) <= tolerance_days
    annual = facts.where(F.col("period_type") == "annual")
    rank = F.when(F.col("form_type").isin("10-K", "10-K/A"), 1).when(F.col("frame").isNotNull(), 2).otherwise(3)
    by = Window.partitionBy(entity, "metric", "to_year")
    first = by.orderBy("selection_rank", F.desc_nulls_last("filing_date"), F.desc("accession"), F.desc("value"))
    found = (
        annual.join(ends.withColumnRenamed("fiscal_year", "to_year"), entity)
        .where(near & (F.coalesce("duration_days", F.lit(0)) >= shortest))
        .withColumn("selection_rank", rank)
        .withColumn("same", F.count("*").over(Window.partitionBy(entity, "metric", "to_year", "selection_rank")))
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
    )
    reason = F.concat(F.element_at(F.array(F.lit("annual_form"), F.lit("frame"), F.lit("fallback")), F.col("selection_rank")), F.when(F.col("same") > 1, " (latest amendment)").otherwise(""))
    chosen = found.withColumn("fiscal_year", F.col("to_year")).withColumn("selection_reason", reason).drop("to_year", "fy_end", "same", "rn")
    rest = facts.where(F.col("period_type") != "annual").withColumn("selection_rank", F.lit(None).cast("int")).withColumn("selection_reason", F.lit(None).cast("string"))
    return chosen.unionByName(rest)


def amendment_resolve(facts: DataFrame, *, keys: Sequence[str], rank: str = "selection_rank") -> DataFrame:
    """Of facts of the least rank the latest filed; the reason says so if there was a choice."""
    best = Window.partitionBy(*keys).orderBy(rank, F.desc_nulls_last("filing_date"), F.desc("accession"))
    same = Window.partitionBy(*keys, rank)
    return (
        facts.withColumn("n", F.count("*").over(same)).withColumn("rn", F.row_number().over(best)).where("rn = 1")
        .withColumn("selection_reason", F.concat("selection_reason", F.when(F.col("n") > 1, " (latest amendment)").otherwise(""))).drop("n", "rn")
    )


def fact_dedup(facts: DataFrame, *, entity: str = "entity", period: str = "fp") -> DataFrame:
    """One row for each metric and period: form priority, latest end, latest filed, longest (year to date), value."""
    days = F.date_diff(F.col("period_end"), F.col("period_start"))
    w = Window.partitionBy(entity, "metric", "fiscal_year", period).orderBy(form_rank(), F.desc_nulls_last("period_end"), F.desc_nulls_last("filing_date"), F.desc_nulls_last(days), F.desc("value"), F.desc("accession"))
    return facts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def fallback_report(facts: DataFrame, concepts: DataFrame, *, entity: str = "entity") -> DataFrame:
    """(entity, metric, concept, kind): metrics without any concept, and those resolved by another than the preferred one."""
    names = F.broadcast(concepts.agg(F.collect_set("metric").alias("__names")))  # one row of the metrics named
    first = concepts.where("priority = 0").select("metric", F.col("concept").alias("preferred"))
    used = facts.select(entity, "metric", "concept").distinct()
    pairs = used.select(entity).distinct().crossJoin(names).select(entity, F.explode("__names").alias("metric"))
    missing = pairs.join(used, [entity, "metric"], "left_anti").select(entity, "metric", F.lit(None).cast("string").alias("concept"), F.lit("missing").alias("kind"))
    other = used.join(small(first), "metric").where("concept <> preferred").select(entity, "metric", "concept", F.lit("fallback").alias("kind"))
    return missing.unionByName(other)


def amount_after(text: Column | str, phrase: str) -> Column:
    """The first amount in brackets after a phrase, in millions, as a positive number of units."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(text, rf"(?is){phrase}.{{0,400}}?\(\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*\)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).cast("double") * 1e6


def missing_period_fill(facts: DataFrame, docs: DataFrame, *, have: str = "operating_cash_flow", want: str = "capex", phrase: str = "purchases? (?:of|related to) property", entity: str = "entity") -> DataFrame:
    """facts with rows of `want` for periods that have `have` only, read from the text of the filing that reported it."""
    keys = [entity, "fiscal_year", "fp"]
    open_ = facts.where(F.col("metric") == have).join(facts.where(F.col("metric") == want).select(*keys), keys, "left_anti")
    read = open_.join(docs.select("accession", "text"), "accession").withColumn("value", amount_after("text", phrase)).where("value is not null").drop("text")
    new = read.withColumn("metric", F.lit(want)).withColumn("selection_reason", F.lit("html_cash_flow_extraction"))
    return facts.withColumn("selection_reason", F.lit(None).cast("string")).unionByName(new) if "selection_reason" not in facts.columns else facts.unionByName(new)


def split_adjust(facts: DataFrame, splits: DataFrame, *, entity: str = "entity", shares: Sequence[str] = SHARES, per_share: Sequence[str] = PER_SHARE) -> DataFrame:
    """Share counts times, per-share figures by, the product of the ratios of later splits (ratio over 1); raw_value kept.

    Splits are summed up to one list for each entity, which is joined; no row is repeated.
    """
    lists = splits.where("ratio > 1").groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("split_date", "ratio"))).alias("splits"))
    factor = F.coalesce(F.aggregate(F.filter("splits", lambda s: s["split_date"] > F.col("period_end")), F.lit(1.0), lambda a, s: a * s["ratio"].cast("double")), F.lit(1.0))
    is_shares, is_per = F.col("metric").isin(*shares), F.col("metric").isin(*per_share)
    return (
        facts.join(lists, entity, "left").withColumn("raw_value", F.col("value")).withColumn("adjustment_factor", factor).drop("splits")
        .withColumn("value", F.when(is_shares, F.col("value") * F.col("adjustment_factor")).when(is_per, F.col("value") / F.col("adjustment_factor")).otherwise(F.col("value")))
        .withColumn("adjustment_basis", F.when((is_shares | is_per) & (F.col("adjustment_factor") != 1), "split_adjusted").otherwise("as_reported"))
        .withColumn("validation_basis", F.when(is_per, "raw_value").otherwise("value"))
    )


def coverage_summary(facts: DataFrame, n_metrics: int, *, entity: str = "entity") -> DataFrame:
    return facts.groupBy(entity).agg(
        F.countDistinct("metric").alias("metrics_found"), F.round(F.countDistinct("metric") * 100.0 / n_metrics, 4).alias("coverage_pct"),
        F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"), F.count("*").alias("n_facts"),
    )
