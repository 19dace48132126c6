"""Report-ready tables: data only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import col, fiscal_year
from ledgerline.operators.metrics import latest_annual_value
from ledgerline.operators.segments import segment_share

#: The order of key metrics in a report.
KEY_METRICS = ("revenue", "gross_margin", "operating_margin", "net_margin", "net_income", "fcf", "fcf_margin", "roe", "debt_to_equity", "current_ratio")
ANNUAL = r"^FY\d{4}$"


def key_metrics(metrics: DataFrame, names: Sequence[str] = KEY_METRICS, *, entity: str = "entity") -> DataFrame:
    place = F.array_position(F.lit(list(names)), F.col("metric")).cast("int")
    return latest_annual_value(metrics.where(F.col("metric").isin(*names)), entity=entity).withColumn("place", place)


def segment_summary(segments: DataFrame, *, entity: str = "entity") -> DataFrame:
    """The latest period's categories with their shares."""
    rows = segments.groupBy(entity, "fiscal_period", "normalized_category").agg(F.round(F.sum("value"), 4).alias("value"))
    last = rows.groupBy(entity).agg(F.max("fiscal_period").alias("fiscal_period"))
    return segment_share(rows.join(last, [entity, "fiscal_period"]), by=[entity])


def in_window(label: Column | str, first: int, last: int) -> Column:
    """Whether a fiscal label's year lies in a display window."""
    return F.coalesce(fiscal_year(label).between(first, last), F.lit(False))


def inflection_list(flagged: DataFrame, *, first: int = 2016, last: int = 2026, most: int = 10, entity: str = "entity") -> DataFrame:
    """An entity's first flagged rows in the window: a report's list, not a limit on the flags."""
    w = Window.partitionBy(entity).orderBy("fiscal_period", "metric")
    rows = flagged.where(F.col("is_inflection") & in_window("fiscal_period", first, last))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(entity, "fiscal_period", "metric", "value", "place")


def segment_mix(segments: DataFrame, categories: Sequence[str], *, entity: str = "entity", digits: int = 4) -> DataFrame:
    rows = segments.where(F.col("fiscal_period").rlike(ANNUAL))
    return rows.groupBy(entity, "fiscal_period").pivot("normalized_category", list(categories)).agg(F.round(F.sum("value"), digits))


def wide_series(metrics: DataFrame, names: Sequence[str], *, annual: bool, entity: str = "entity") -> DataFrame:
    rows = metrics.where(F.col("metric").isin(*names) & (F.col("fiscal_period").rlike(ANNUAL) if annual else F.col("fiscal_period").rlike("-Q[1-4]$")))
    return rows.groupBy(entity, "fiscal_period").pivot("metric", list(names)).agg(F.max("value"))


def fcf_series(metrics: DataFrame, *, entity: str = "entity") -> DataFrame:
    fcf = metrics.where("metric = 'fcf'").select(entity, "fiscal_period", F.col("value").alias("fcf"))
    return fcf.join(metrics.where("metric = 'fcf_margin'").select(entity, "fiscal_period", F.col("value").alias("fcf_margin")), [entity, "fiscal_period"], "left")


def theme_heatmap(scores: DataFrame, themes: Sequence[str], *, filing: str = "accession", digits: int = 6) -> DataFrame:
    return scores.groupBy(filing).pivot("theme", list(themes)).agg(F.round(F.avg("score"), digits))


def drift_series(similarity: DataFrame, *, entity: str = "entity", least: float = 0.0) -> DataFrame:
    return similarity.where(F.col("similarity") >= least).select(entity, "section", "filing_date", "similarity")


def peer_universe(peers: DataFrame, tiers: DataFrame, events: DataFrame) -> DataFrame:
    listed = events.groupBy("ticker").agg(F.array_sort(F.collect_list("event")).alias("events"))
    return peers.select("ticker").join(tiers, "ticker", "left").join(listed, "ticker", "left").select("ticker", F.coalesce("tier", F.lit("context")).alias("tier"), F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def scenario_values(valued: DataFrame, order: Sequence[str] = ("bear", "base", "bull")) -> DataFrame:
    return valued.select("entity", "scenario", "per_share", "probability", F.array_position(F.lit(list(order)), F.col("scenario")).cast("int").alias("place"))


def peer_comparison(filtered: DataFrame, *, least: int = 2) -> DataFrame:
    """Tickers with a multiple, if there are two of them at least."""
    rows = filtered.select("ticker", "ev_revenue", "pe").dropna(how="all", subset=["ev_revenue", "pe"])
    enough = rows.agg((F.count("*") >= least).alias("enough"))  # one row
    return rows.crossJoin(F.broadcast(enough)).where("enough").drop("enough")


def scorecard(components: DataFrame) -> DataFrame:
    """Numeric usable components as bars; the others listed with a reason."""
    number = F.expr("try_cast(value as double)")
    bar = (F.col("status") == "usable") & number.isNotNull()
    reason = F.when(bar, None).when(F.col("status") != "usable", F.col("status")).otherwise("non_numeric")
    return components.select("entity", "component", F.when(bar, number).alias("bar"), reason.alias("reason"))


def exhibit_status(segment: DataFrame, nlp: DataFrame, peers: DataFrame, *, entity: str = "entity") -> DataFrame:
    """(entity, exhibit, status) from the gates' rows; peers holds one n_usable for all."""
    a = segment.select(entity, F.lit("segment_mix").alias("exhibit"), F.when(F.col("renderable"), "active").otherwise("suppressed").alias("status"))
    b = nlp.select(entity, F.lit("theme_heatmap").alias("exhibit"), "status")
    c = segment.select(entity).crossJoin(F.broadcast(peers)).select(entity, F.lit("peer_multiples").alias("exhibit"), F.when(F.col("n_usable") >= 2, "active").otherwise("suppressed").alias("status"))
    return a.unionByName(b).unionByName(c)


def gate_rollup(checks: DataFrame, *, entity: str = "entity", ok: Column | str = "ok") -> DataFrame:
    return checks.groupBy(entity).agg(F.count("*").alias("checks_run"), F.count_if(col(ok)).alias("passed"), F.count_if(~col(ok)).alias("failed"))
