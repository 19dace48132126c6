"""Point-in-time controls, validation gates, freshness and document rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import col, safe_div
from ledgerline.functions.patterns import literal_counts
from ledgerline.functions.running import with_running_sums
from ledgerline.functions.tables import small

#: Metrics of the strict gate, and those that a valuation cannot do without.
CORE = ("revenue", "gross_profit", "operating_income", "net_income", "diluted_eps", "operating_cash_flow", "capex", "fcf", "total_assets", "total_debt", "cash_and_securities", "diluted_shares")
CRITICAL = ("revenue", "operating_cash_flow", "capex", "diluted_shares", "cash_and_securities", "total_debt")
ALIASES = {"fcf": ("free_cash_flow",), "cash_and_securities": ("cash", "total_cash"), "total_debt": ("debt", "long_term_debt"), "diluted_eps": ("eps_diluted", "eps")}


def as_of(df: DataFrame, date: str, *, available: str = "source_available_date") -> DataFrame:
    """Rows that could be known on a date. A table without the column is an error, not a pass."""
    if available not in df.columns:
        raise ValueError(f"{available} is not a column: availability cannot be checked")
    return df.where(F.col(available) <= F.lit(date).cast("date"))


def as_of_violations(tables: dict[str, DataFrame], date: str, *, available: dict[str, str] | None = None) -> DataFrame:
    """(table, violations): rows of each table that lie in the date's future."""
    out = None
    for name, df in tables.items():
        c = (available or {}).get(name, "source_available_date")
        n = df.agg(F.count_if(F.col(c) > F.lit(date).cast("date")).alias("violations")).select(F.lit(name).alias("table"), "violations")
        out = n if out is None else out.unionByName(n)
    return out


def compare_published(parsed: DataFrame, published: DataFrame, *, keys: Sequence[str] = ("entity", "metric", "fiscal_year"), tolerance_pct: float = 2.0, digits: int = 4) -> DataFrame:
    """pass, fail or missing of every published value; a published 0 fails."""
    diff = safe_div(F.abs(F.col("value") - F.col("published")), F.abs("published")) * 100
    rows = published.select(*keys, F.col("value").alias("published")).join(parsed.select(*keys, "value"), list(keys), "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.coalesce(diff <= tolerance_pct, F.lit(False)), "pass").otherwise("fail")
    return rows.withColumn("difference_pct", F.round(diff, digits)).withColumn("status", status)


def alias_table(spark: SparkSession) -> DataFrame:
    """(metric, alias, rank): a metric's own name first."""
    return spark.createDataFrame([(m, a, k) for m in CORE for k, a in enumerate((m, *ALIASES.get(m, ())))], "metric string, alias string, rank int")


def gate_validate(parsed: DataFrame, published: DataFrame, *, entity: str = "entity", tolerance_pct: float = 1.0, digits: int = 4) -> DataFrame:
    """Twelve core metrics of every published year; the first alias there is counts, on both sides; per-share figures as filed.

    A published 0 has a difference of 0 or 100. A failed or missing critical metric blocks.
    """
    spark = parsed.sparkSession
    names = F.broadcast(alias_table(spark))
    value = F.when(F.col("metric") == "diluted_eps", F.coalesce(*(F.col(c) for c in ("raw_value", "value") if c in parsed.columns))).otherwise(F.col("value"))
    own = parsed.withColumn("v", value).withColumnRenamed("metric", "alias").join(names, "alias").where("v is not null").groupBy(entity, "metric", "fiscal_year").agg(F.min_by("v", "rank").alias("parsed"))
    theirs = published.withColumnRenamed("metric", "alias").join(names, "alias").where("value is not null").groupBy(entity, "metric", "fiscal_year").agg(F.min_by("value", "rank").alias("published"))
    every = published.select(entity, "fiscal_year").distinct().withColumn("metric", F.explode(F.lit(list(CORE))))
    diff = F.when(F.col("published") == 0, F.when(F.col("parsed") == 0, 0.0).otherwise(100.0)).otherwise(safe_div(F.abs(F.col("parsed") - F.col("published")), F.abs("published")) * 100)
    rows = every.join(theirs, [entity, "metric", "fiscal_year"], "left").join(own, [entity, "metric", "fiscal_year"], "left").where("published is not null")
    status = F.when(F.col("parsed").isNull(), "missing").when(diff <= tolerance_pct, "pass").otherwise("fail")
    out = rows.withColumn("difference_pct", F.round(F.when(F.col("parsed").isNotNull(), diff), digits)).withColumn("status", status)
    critical = F.col("metric").isin(*CRITICAL)
    return out.withColumn("severity", F.when(F.col("status") == "pass", "none").when(critical, "critical").otherwise("warning")).withColumn("blocker", (F.col("status") != "pass") & critical)


def missing_critical(validated: DataFrame, *, entity: str = "entity") -> DataFrame:
    """Rows of status missing for critical metrics that the latest year lacks."""
    last = validated.groupBy(entity).agg(F.max("fiscal_year").alias("fiscal_year"))
    every = last.withColumn("metric", F.explode(F.lit(list(CRITICAL))))
    return every.join(validated.select(entity, "fiscal_year", "metric"), [entity, "fiscal_year", "metric"], "left_anti").withColumn("status", F.lit("missing")).withColumn("severity", F.lit("critical")).withColumn("blocker", F.lit(True))


def fy_selection_check(facts: DataFrame) -> DataFrame:
    """Annual-tagged facts whose period is not annual or an instant."""
    return facts.where((F.col("fp") == "FY") & ~F.coalesce("period_type", F.lit("")).isin("annual", "instant", "")).withColumn("severity", F.lit("critical"))


def coverage_gate(validated: DataFrame, *, entity: str = "entity", threshold: float = 90.0, years: int = 3) -> DataFrame:
    """Share of passes over the last three years; under 90 % blocks unless every miss is uncritical."""
    w = Window.partitionBy(entity).orderBy(F.desc("fiscal_year"))
    recent = validated.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= years)
    share = F.round(F.count_if(F.col("status") == "pass") * 100.0 / F.count("*"), 4)
    minor = F.bool_and((F.col("status") == "pass") | ~F.col("metric").isin(*CRITICAL))
    return recent.groupBy(entity).agg(share.alias("coverage_pct"), ((share < threshold) & ~minor).alias("blocked"))


def quality_status(validated: DataFrame, coverage: DataFrame, *, entity: str = "entity") -> DataFrame:
    rows = validated.groupBy(entity).agg(F.bool_or("blocker").alias("b"), F.bool_or(F.col("status") != "pass").alias("w")).join(coverage, entity)
    status = F.when(F.col("b") | F.col("blocked"), "DATA_BLOCKED").when(F.col("w"), "PASS_WITH_WARNINGS").otherwise("PASS")
    return rows.select(entity, status.alias("status"), (status == "DATA_BLOCKED").alias("blocks_recommendation"))


def validation_summary(validated: DataFrame, *, entity: str = "entity") -> DataFrame:
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "fail", "missing")}
    issue = F.when(F.col("blocker"), F.concat_ws(":", "metric", "fiscal_year", "status"))
    return validated.groupBy(entity).agg(
        *(c.alias(f"n_{s}") for s, c in n.items()), F.round(n["pass"] * 100.0 / F.count("*"), 4).alias("coverage_pct"), F.array_join(F.array_sort(F.collect_list(issue)), ";").alias("blocking")
    )


def canonical_truth(published: DataFrame, parsed: DataFrame, manual: DataFrame, *, keys: Sequence[str] = ("entity", "metric", "fiscal_year"), split_year: int = 2024, digits: int = 4) -> DataFrame:
    """A manual value, else the split-basis rule for per-share figures, else the parsed value at 2 %, else missing."""
    k = list(keys)
    rows = published.select(*k, F.col("value").alias("published")).join(parsed.select(*k, F.col("value").alias("parsed")), k, "left").join(manual.select(*k, "manual_value"), k, "left")
    diff = safe_div(F.abs(F.col("parsed") - F.col("published")), F.abs("published")) * 100
    status = (
        F.when(F.col("manual_value").isNotNull(), "manual").when(F.col("parsed").isNull(), "missing")
        .when((F.col("metric") == "diluted_eps") & (diff > 50) & (F.col("fiscal_year") <= split_year), "split_basis_mismatch").when(diff <= 2.0, "pass").otherwise("fail")
    )
    out = rows.withColumn("status", status).withColumn("value", F.coalesce("manual_value", "parsed")).withColumn("difference_pct", F.round(diff, digits))
    return out.withColumn("blocker", F.col("status").isin("missing", "fail") & F.col("metric").isin(*CRITICAL)).drop("manual_value")


def eligibility(statuses: DataFrame, kinds: DataFrame, data_status: DataFrame, *, entity: str = "entity") -> DataFrame:
    """Blocked by blocked data or by a blocking component that is BLOCKED or UNAVAILABLE; diagnostic ones never block."""
    bad = (F.col("kind") == "blocking") & F.col("status").isin("BLOCKED", "UNAVAILABLE")
    by = statuses.join(small(kinds), "component", "left").groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("component")))), ";").alias("blockers"))
    blocked = F.coalesce("blocks_recommendation", F.lit(True)) | (F.col("blockers") != "")
    return by.join(data_status, entity, "left").select(entity, (~blocked).alias("eligible"), "blockers")


def valuation_input_check(validated: DataFrame, data_status: DataFrame, *, entity: str = "entity") -> DataFrame:
    bad = F.col("metric").isin(*CRITICAL) & F.col("status").isin("fail", "missing") & (F.col("severity") == "critical")
    by = validated.groupBy(entity).agg(F.bool_or(bad).alias("bad"))
    return by.join(data_status, entity, "left").select(entity, F.when(F.col("bad") | F.col("blocks_recommendation"), "BLOCKED").otherwise("OK").alias("status"))


def federal_holidays(year: Column) -> Column:
    """US federal holidays of a year as observed, as an array of dates: fixed days, and the nth weekday of a month."""
    on = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))

    def observed(d: Column) -> Column:
        day = F.dayofweek(d)
        return F.when(day == 7, F.date_sub(d, 1)).when(day == 1, F.date_add(d, 1)).otherwise(d)

    nth = lambda m, name, n: F.date_add(F.next_day(F.date_sub(on(m, 1), 1), name), 7 * (n - 1))
    last_monday_of_may = F.date_sub(F.next_day(on(5, 31), "Mon"), 7)
    return F.array(
        observed(on(1, 1)), nth(1, "Mon", 3), nth(2, "Mon", 3), last_monday_of_may, F.when(year >= 2021, observed(on(6, 19))), observed(on(7, 4)), nth(9, "Mon", 1), nth(10, "Mon", 2), observed(on(11, 11)), nth(11, "Thu", 4), observed(on(12, 25))
    )


def business_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, business_index): how many business days there are up to each day; its size is the days between two dates."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    free = F.coalesce(F.array_contains(F.array_compact(federal_holidays(F.year("day"))), F.col("day")), F.lit(False)) | F.coalesce(F.array_contains(F.array_compact(federal_holidays(F.year("day") + 1)), F.col("day")), F.lit(False))
    works = F.when(F.dayofweek("day").isin(1, 7) | free, 0).otherwise(1)
    return with_running_sums(days.withColumn("works", works).withColumn("business_index", works), ["business_index"], order=["day"])


def trading_days_between(rows: DataFrame, calendar: DataFrame, start: str, end: str, *, out: str = "trading_days") -> DataFrame:
    """Business days of the inclusive range less 1, never under 0; 0 if start is not before end."""
    a = small(calendar.select(F.col("day").alias("__a"), (F.col("business_index") - F.col("works")).alias("__before")))
    b = small(calendar.select(F.col("day").alias("__b"), F.col("business_index").alias("__to")))
    n = F.when(F.col(start) >= F.col(end), 0).otherwise(F.greatest(F.col("__to") - F.col("__before") - 1, F.lit(0)))
    return rows.join(a, F.col(start) == F.col("__a"), "left").join(b, F.col(end) == F.col("__b"), "left").withColumn(out, n.cast("int")).drop("__a", "__before", "__b", "__to")


def price_freshness(prices: DataFrame, required: DataFrame, calendar: DataFrame, *, report_date: str, subject: str, max_age: int = 5, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(age in trading days of each required ticker, 99999 without prices; the overall status)."""
    last = prices.groupBy("ticker").agg(F.max("date").alias("last"))
    rows = required.join(last, "ticker", "left").withColumn("report", F.lit(report_date).cast("date"))
    ages = trading_days_between(rows, calendar, "last", "report", out="age").withColumn("age", F.when(F.col("last").isNull(), 99999).otherwise(F.col("age"))).withColumn("stale", F.col("age") > max_age)
    by = [group] if group else []
    all_gone, own = F.bool_and(F.col("age") == 99999), F.bool_or((F.col("ticker") == subject) & F.col("stale"))
    status = F.when(all_gone, "no_data").when(own, "blocked_subject_stale").when(F.bool_or("stale"), "partial").otherwise("fresh")
    return ages.drop("report"), ages.groupBy(*by).agg(status.alias("status"), F.count_if("stale").alias("n_stale"))


def peer_freshness(peers: DataFrame, tiers: DataFrame, *, report_date: str, max_age_days: int = 30, most: int = 3) -> DataFrame:
    age = F.date_diff(F.lit(report_date).cast("date"), F.col("source_date"))
    rows = peers.join(tiers, "ticker").withColumn("stale", F.coalesce(age > max_age_days, F.lit(True)))
    n = F.count_if((F.col("tier") == "core") & F.col("stale"))
    return rows.agg(F.count("*").alias("n_peers"), F.count_if("stale").alias("n_stale"), n.alias("n_stale_core"), F.when(n >= most, "stale_blocked").when(F.count_if("stale") > 0, "partial").otherwise("fresh").alias("status"))


def no_lookahead(panel: DataFrame, *, feature: str = "feature_available_date", prediction: str = "prediction_date", target: str = "target_available_date") -> DataFrame:
    """Rows whose features were not known at prediction, or whose target was."""
    return panel.where((F.col(feature) > F.col(prediction)) | (F.col(target) <= F.col(prediction)))


def extraction_quality(sections: DataFrame, *, filing: str = "accession", by: str = "entity", mda: int = 500, risk: int = 300) -> DataFrame:
    """usable, diagnostic_only if over half of the filings are poor, unavailable without filings."""
    size = lambda s: F.coalesce(F.max(F.when(F.col("section_name") == s, F.length("text"))), F.lit(0))
    filings = sections.groupBy(by, filing).agg(((size("mda") < mda) | (size("risk_factors") < risk)).alias("poor"))
    share = F.round(F.avg(F.col("poor").cast("double")), 6)
    return filings.groupBy(by).agg(F.count("*").alias("n_filings"), share.alias("poor_share"), F.when(share > 0.5, "diagnostic_only").otherwise("usable").alias("status"))


def section_coverage(sections: DataFrame, *, least: int = 500) -> DataFrame:
    warning = F.when(F.col("parse_status") == "missing", "missing").when(F.coalesce(F.length("text"), F.lit(0)) < least, "short").otherwise("ok")
    return sections.groupBy("section_name", "extraction_tier", warning.alias("warning")).agg(F.count("*").alias("n"))


def nlp_coverage(features: DataFrame, *, by: str = "entity", filing: str = "accession") -> DataFrame:
    """Filings with a keyword score over 0; usable with one and two similarities; under half of the filings only an appendix."""
    hit = (F.col("feature_type") == "keyword_score") & (F.col("value") > 0)
    pct = F.round(F.count_distinct(F.when(hit, F.col(filing))) * 100.0 / F.count_distinct(filing), 4)
    usable = F.bool_or(hit) & (F.count_if(F.col("feature_type") == "similarity") >= 2)
    return features.groupBy(by).agg(pct.alias("keyword_pct"), usable.alias("usable"), F.when(usable & (pct >= 50), "active").when(usable, "appendix").otherwise("suppressed").alias("status"))


def provenance_summary(log: DataFrame) -> DataFrame:
    """Calls, rows, cache hits and failures of each step, and of all (step null); test paths are left out."""
    real = log.where(~F.coalesce(F.col("path"), F.lit("")).contains("/tests/"))
    failed = F.coalesce(F.col("http_status") >= 400, F.lit(False)) | F.col("error").isNotNull()
    return real.rollup("step").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.round(F.avg(F.col("cached").cast("double")), 6).alias("cache_hit_rate"),
        F.count_if("cached").alias("n_cached"), F.count_if(~F.col("cached")).alias("n_live"), F.count_if(failed).alias("failures"),
    )


def retrieval_failures(log: DataFrame) -> DataFrame:
    failed = F.coalesce(F.col("http_status") >= 400, F.lit(False)) | F.col("error").isNotNull()
    return log.groupBy("step").agg(F.count_if(failed).alias("failures"), F.min(F.when(~F.col("cached"), F.col("timestamp"))).alias("first_live"))


def peer_attribution(peers: DataFrame, tiers: DataFrame, *, report_date: str) -> DataFrame:
    age = F.date_diff(F.lit(report_date).cast("date"), F.col("source_date"))
    reasons = F.array_compact(F.array(F.when(F.coalesce(age > 90, F.lit(True)), "stale"), F.when(F.col("market_cap").isNull(), "no_market_cap"), F.when(F.coalesce(F.col("net_income") <= 0, F.lit(True)), "no_earnings")))
    rows = peers.join(tiers, "ticker", "left").withColumn("tier", F.coalesce("tier", F.lit("context")))
    return rows.select("ticker", "tier", "source_date", age.alias("age_days"), (F.size(reasons) == 0).alias("included"), F.concat_ws(";", reasons).alias("reasons"))


def attribution_from_log(log: DataFrame, tiers: DataFrame, *, step: str = "fetch_peer_financials", most_days: int = 90) -> DataFrame:
    """What peer_attribution() says, as far as the provenance log alone tells it: one row for each retrieval of a peer.

    The log knows the date of the figures, their age in days, and when the market value was fetched; a peer whose age is
    not logged is included. Peers of no tier are of the tier other.
    """
    calls = log.where((F.col("step") == step) & F.col("ticker").isNotNull()).join(tiers, "ticker", "left")
    stale = F.coalesce(F.col("staleness_days") > most_days, F.lit(False))
    return calls.select(
        "ticker", F.coalesce("tier", F.lit("other")).alias("tier"), "source_date", F.to_date("timestamp").alias("market_date"), F.col("staleness_days").alias("age_days"), (~stale).alias("included"), F.when(stale, "stale").otherwise("").alias("reasons")
    )


def attribution_breakdown(attribution: DataFrame) -> DataFrame:
    """(tier, reason, peers): how many peers each reason excludes, by tier and over all (tier null); a peer counts once for each of its reasons."""
    rows = attribution.where(~F.col("included")).select("ticker", "tier", F.explode(F.split("reasons", ";")).alias("reason"))
    return rows.groupingSets([("tier", "reason"), ("reason",)], "tier", "reason").agg(F.count_distinct("ticker").alias("peers"))


def doc_policy_scan(docs: DataFrame, tokens: dict[str, str], patterns: dict[str, str] | None = None, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, rule, hits) of rules that a text meets; tokens: rule -> literal text, patterns: rule -> expression.

    All tokens are looked for in one pass; those of up to four letters and digits stand between word bounds. Only
    expressions cost a pass each.
    """
    counted = literal_counts(docs.select(doc, text), {r: [t] for r, t in tokens.items()}, text=text, bounded={t: is_short(t) for t in tokens.values()}, unicode_words=False)
    named = F.transform("counts", lambda c: F.struct(F.lit(list(tokens))[c["g"]].alias("rule"), c["n"].alias("hits"))) if tokens else F.array().cast("array<struct<rule:string,hits:int>>")
    matched = [F.struct(F.lit(r).alias("rule"), F.regexp_count(F.col(text), F.lit(p)).alias("hits")) for r, p in (patterns or {}).items()]
    every = F.concat(named, F.array(*matched)) if matched else named
    return counted.select(doc, F.inline(every)).where("hits > 0")


def is_short(token: str) -> bool:
    """Whether a token matches whole words only."""
    return len(token) <= 4 and token.isalnum()


def references_missing(a: DataFrame, b: DataFrame, pattern: str, *, key: str, text: str = "text") -> DataFrame:
    """References that a document cites and its counterpart does not."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(pattern), 0))
    both = a.select(key, F.col(text).alias("ta")).join(b.select(key, F.col(text).alias("tb")), key, "left")
    return both.select(key, F.array_sort(F.array_except(found("ta"), F.coalesce(found("tb"), F.array().cast("array<string>")))).alias("missing")).where(F.size("missing") > 0)
