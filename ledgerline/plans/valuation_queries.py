"""Queries of the valuation operators and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import marts as mt
from ledgerline.operators import metrics as mo
from ledgerline.operators import valuation as va
from ledgerline.plans.bindings import FACTS_SQL, PEERS_SQL, facts, peers, table
from ledgerline.plans.fact_queries import INPUTS_SQL, LATEST_SQL, RATIOS_SQL, YOY_SQL, inputs, metrics, nation_prices
from ledgerline.plans.gate_queries import MAPPED_SQL, TIERS_SQL, mapped, tiers
from ledgerline.plans.registered import Registry
from ledgerline.sources.readers import write_bucketed

R = Registry()

SCEN_SQL = "scen(scenario, probability, g, m0, m1, tg) as (values " + ", ".join(f"('{s}', cast({p} as double), cast({g} as double), cast({a} as double), cast({b} as double), cast({t} as double))" for s, p, g, a, b, t in va.SCENARIOS) + ")"


def dcf_sql(g: str, m0: str, m1: str, w: str, tg: str) -> str:
    """Per-share value over columns base_revenue, net_cash, diluted_shares, by a sum over years."""
    total = f"list_sum([base_revenue * pow(1 + {g}, t) * ({m0} + ({m1} - {m0}) * ((t - 1) / cast(9 as double))) / pow(1 + {w}, t) for t in range(1, 11)])"
    last = f"(base_revenue * pow(1 + {g}, 10) * {m1})"
    gordon = f"{last} * (1 + {tg}) / nullif({w} - {tg}, 0)"
    end = f"(case when {w} - {tg} > 0.005 then {gordon} when {w} - {tg} <= 0 then {last} * 200 else least({gordon}, {last} * 200) end / pow(1 + {w}, 10))"
    return f"({total} + {end})"


EV = dcf_sql("g", "m0", "m1", "cast(0.1 as double)", "tg")
VALUED_SQL = f"""{INPUTS_SQL}, {SCEN_SQL}, valued as (select entity, scenario, probability, price, round({EV}, 4) as enterprise_value, round({EV} + net_cash, 4) as equity_value,
  round(case when diluted_shares > 0 then ({EV} + net_cash) / diluted_shares else 0 end, 4) as per_share from inputs, scen)"""


def valued(spark, d):
    return va.scenarios(inputs(spark, d), va.scenario_table(spark))


@R.add("dcf", f"{VALUED_SQL} select entity, enterprise_value, equity_value, per_share from valued where scenario = 'base'")
def _(spark, d):
    base = va.scenario_table(spark).where("scenario = 'base'")
    return va.scenarios(inputs(spark, d), base).select("entity", "enterprise_value", "equity_value", "per_share")


@R.add("scenarios", f"{VALUED_SQL} select entity, scenario, probability, per_share from valued")
def _(spark, d):
    return valued(spark, d).select("entity", "scenario", "probability", "per_share")


@R.add("bucketed_ratios", f"{RATIOS_SQL} select entity, fiscal_year, fiscal_period, metric, value, source_available_date, unit from ratios")
def _(spark, d):
    """Ratios over the fact sink, which is bucketed by entity: nothing is shuffled to read it."""
    return mo.ratios(write_bucketed(facts(spark, d), "facts", by=["entity"], sort=["fiscal_year", "fiscal_period"]))


@R.add("bucketed_scenarios", f"{VALUED_SQL} select entity, scenario, probability, per_share from valued")
def _(spark, d):
    """Valuations over the sinks of metrics and prices, both bucketed by entity."""
    known = write_bucketed(metrics(spark, d), "metrics", by=["entity"], sort=["metric", "fiscal_period"])
    closes = write_bucketed(nation_prices(spark, d), "prices", by=["ticker"], sort=["date"])
    return va.scenarios(mo.valuation_inputs(known, closes), va.scenario_table(spark)).select("entity", "scenario", "probability", "per_share")


GRID_SQL = f"""sens as (select entity, wacc, tgx as terminal_growth, round(case when diluted_shares > 0 then ({dcf_sql('cast(0.2 as double)', 'cast(0.35 as double)', 'cast(0.3 as double)', 'wacc', 'tgx')} + net_cash) / diluted_shares else 0 end, 4) as per_share
  from inputs, (select cast(unnest([0.08, 0.09, 0.10, 0.11, 0.12]) as double) as wacc), (select cast(unnest([0.02, 0.025, 0.03, 0.035, 0.04]) as double) as tgx))"""


@R.add("sensitivity_grid", f"{INPUTS_SQL}, {GRID_SQL} select * from sens")
def _(spark, d):
    return va.sensitivity_grid(inputs(spark, d), va.scenario_table(spark))


FLAT = dcf_sql("cagr", "margin", "margin", "cast(0.1 as double)", "cast(0.03 as double)")
REVERSE_SQL = f"""cells as (select entity, price, cagr, margin, round(case when diluted_shares > 0 then ({FLAT} + net_cash) / diluted_shares else 0 end, 4) as per_share
  from inputs, (select cast(unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]) as double) as cagr), (select cast(unnest([0.1, 0.2, 0.3, 0.4, 0.5]) as double) as margin)),
rgrid as (select entity, cagr, margin, per_share, coalesce(abs((per_share - price) / nullif(price, 0)) <= 0.1, false) as highlight, price between min(per_share) over (partition by entity) and max(per_share) over (partition by entity) as price_in_grid from cells)"""


@R.add("reverse_dcf_grid", f"{INPUTS_SQL}, {REVERSE_SQL} select * from rgrid")
def _(spark, d):
    return va.reverse_dcf_grid(inputs(spark, d))


#: The bisection is checked by its defining property: the value at the root is the price.
def implied(spark, d):
    return va.implied_cagr(inputs(spark, d).withColumn("price", F.col("price") * 5))


GAP_SQL = dcf_sql("cast(GROWTH as double)", "cast(0.3 as double)", "cast(0.3 as double)", "cast(0.1 as double)", "cast(0.03 as double)")


@R.add("implied_cagr", f"""{INPUTS_SQL}, b as (select entity, price * 5 as price, diluted_shares, ({GAP_SQL.replace('GROWTH', '-0.5')} + net_cash) / diluted_shares - price * 5 as a, ({GAP_SQL.replace('GROWTH', '1.5')} + net_cash) / diluted_shares - price * 5 as z from inputs)
select entity, coalesce(a <= 0 and z >= 0, false) as solved, coalesce(a <= 0 and z >= 0, false) as root_meets_price from b""")
def _(spark, d):
    r = implied(spark, d)
    off = F.abs(va.flat_dcf("implied_cagr", F.lit(0.3)) / F.col("price") - 1) < 1e-4
    return r.select("entity", F.col("implied_cagr").isNotNull().alias("solved"), F.coalesce(off, F.lit(False)).alias("root_meets_price"))


MARGIN = dcf_sql("cast(0.2 as double)", "cast(1.0 as double)", "cast(1.0 as double)", "cast(0.1 as double)", "cast(0.03 as double)")


@R.add("implied_margin", f"{INPUTS_SQL}, m as (select entity, diluted_shares, (price * 20 * diluted_shares - net_cash) / nullif({MARGIN}, 0) as m from inputs) select entity, case when m between 0.01 and 0.9 and diluted_shares > 0 then round(m, 6) end as implied_margin from m")
def _(spark, d):
    return va.implied_margin(inputs(spark, d).withColumn("price", F.col("price") * 20)).select("entity", "implied_margin")


@R.add("plausibility", f"{LATEST_SQL} select entity, metric, value, case when value is null then 'no_convergence' when value between 0.35 and 0.45 then 'within' when value > 0.45 and value - 0.45 <= 0.1 then 'above' when value < 0.35 and 0.35 - value <= 0.1 then 'below' else 'far' end as label from latest where metric like '%margin'")
def _(spark, d):
    m = mo.latest_annual_value(metrics(spark, d)).where("metric like '%margin'")
    return m.select("entity", "metric", "value", va.plausibility("value", 0.35, 0.45).alias("label"))


MULT_SQL = f"""{PEERS_SQL}, mult as (select *, round(market_cap + total_debt - total_cash, 4) as ev, round((market_cap + total_debt - total_cash) / nullif(revenue, 0), 6) as ev_revenue, round((market_cap + total_debt - total_cash) / nullif(ebitda, 0), 6) as ev_ebitda, round(market_cap / nullif(net_income, 0), 6) as pe, round(free_cash_flow / nullif(market_cap, 0), 6) as fcf_yield from peers)"""
FILTER_SQL = f"""{MULT_SQL}, {TIERS_SQL}, fs as (select m.*, coalesce(tier, 'context') as tier, case when coalesce(date_diff('day', source_date, date '2001-12-31') > 90, true) then 'stale' when ev is null then 'missing_ev' when ev < 0 then 'negative_ev' when ebitda <= 0 then 'negative_ebitda' when net_income <= 0 then 'negative_earnings' else 'ok' end as status from mult m left join tiers using (ticker)),
filtered as (select ticker, region, tier, status, ev, case when status not in ('stale', 'missing_ev', 'negative_ev') then ev_revenue end as ev_revenue, case when status not in ('stale', 'missing_ev', 'negative_ev') and ebitda > 0 then ev_ebitda end as ev_ebitda, case when status <> 'stale' and net_income > 0 then pe end as pe from fs)"""


def multiples(spark, d):
    return va.peer_multiples(peers(spark, d))


def filtered(spark, d):
    return va.peer_filter(multiples(spark, d), tiers(spark, d), report_date="2001-12-31").select("ticker", "region", "tier", "status", "ev", "ev_revenue", "ev_ebitda", "pe")


@R.add("peer_multiples", f"{MULT_SQL} select ticker, ev, ev_revenue, ev_ebitda, pe, fcf_yield from mult")
def _(spark, d):
    return multiples(spark, d).select("ticker", "ev", "ev_revenue", "ev_ebitda", "pe", "fcf_yield")


@R.add("peer_filter", f"{FILTER_SQL} select * from filtered")
def _(spark, d):
    return filtered(spark, d)


@R.add("limited_sample", f"{FILTER_SQL} select region, count(*) filter (tier = 'semi' and ev_revenue is not null) as n_usable, count(*) filter (tier = 'semi' and ev_revenue is not null) < 3 as limited from filtered group by 1")
def _(spark, d):
    return va.limited_sample(filtered(spark, d), by="region")


@R.add("clean_peer_table", f"""{MULT_SQL}, {TIERS_SQL}, r as (select ticker, ev, concat_ws(';', case when ev < 0 then 'negative_ev' end, case when ebitda <= 0 then 'negative_ebitda' end, case when net_income <= 0 then 'negative_earnings' end, case when coalesce(date_diff('day', source_date, date '2001-12-31') > 90, true) then 'stale' end) as reasons from mult join tiers using (ticker) where tier = 'core')
select ticker, ev, reasons = '' as included, reasons from r""")
def _(spark, d):
    return va.clean_peer_table(multiples(spark, d), tiers(spark, d), report_date="2001-12-31").select("ticker", "ev", "included", "reasons")


RATED_SQL = f"""{VALUED_SQL}, wv as (select entity, sum(probability * per_share) as ev, max(case scenario when 'bear' then per_share end) as bear, max(case scenario when 'base' then per_share end) as base, max(case scenario when 'bull' then per_share end) as bull, any_value(price) as price from valued group by 1),
rated as (select entity, round(ev, 4) as expected_value, round((ev - price) / nullif(price, 0), 6) as upside, bear, base, bull, price, case when (ev - price) / nullif(price, 0) is null then 'Not Rated' when (ev - price) / price >= 0.15 and (base - price) / price >= 0.15 and (bear - price) / price >= -0.25 then 'Buy' when (ev - price) / price <= -0.2 then 'Sell' else 'Hold' end as rating from wv)"""


def rated(spark, d):
    return va.recommend(valued(spark, d))


@R.add("recommend", f"{RATED_SQL} select * from rated")
def _(spark, d):
    return rated(spark, d)


@R.add("sanity_checks", f"""{RATED_SQL}, {GRID_SQL}, {REVERSE_SQL}, h as (select entity, bool_or(highlight) as hit from rgrid group by 1), sr as (select entity, min(per_share) as lo, max(per_share) as hi from sens group by 1)
select entity, concat_ws(';', case when abs((expected_value - price) / nullif(price, 0)) > 0.5 then 'divergence' end, case when not hit then 'no_grid_cell' end, case when (bear - price) / nullif(price, 0) < -0.4 then 'bear_downside' end, case when not (price between lo and hi) then 'sensitivity_miss' end) as notes from rated join h using (entity) join sr using (entity)""")
def _(spark, d):
    i = inputs(spark, d)
    return va.sanity_checks(rated(spark, d), va.reverse_dcf_grid(i), va.sensitivity_grid(i, va.scenario_table(spark)))


@R.add("final_rating", f"{RATED_SQL} select entity, case when entity > 'NATION_5' or upside is null then 'Not Rated' when upside > 0.15 then 'Buy' when upside < -0.2 then 'Sell' else 'Hold' end as final_rating from rated")
def _(spark, d):
    return rated(spark, d).select("entity", va.final_rating("upside", F.col("entity") <= "NATION_5").alias("final_rating"))


COUNTS_SQL = """cnt as (select 'E' || (user_id % 25) as entity, cast(day(ts) as integer) as period, count(*) filter (event_type = 'purchase') as strong_buy, count(*) filter (event_type = 'signup') as buy, count(*) filter (event_type = 'view') as hold, count(*) filter (event_type = 'click') as sell, count(*) filter (event_type = 'error') as strong_sell, count(*) filter (value > 40) as up, count(*) filter (value < 20) as down from events group by all)"""


@R.add("analyst_consensus", f"""with {COUNTS_SQL}, m as (select *, (strong_buy + 2 * buy + 3 * hold + 4 * sell + 5 * strong_sell) * 1.0 / nullif(strong_buy + buy + hold + sell + strong_sell, 0) as m from cnt),
l as (select *, lag(m) over w as pm, lag(period) over w as pp from m window w as (partition by entity order by period)) select entity, period, round(m, 4) as recommendation_mean, round(case when pp = period - 1 then m - pm end, 4) as delta, up - down as net_revisions from l""")
def _(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    c = table(spark, d, "events").groupBy(F.expr("'E' || (user_id % 25)").alias("entity"), F.dayofmonth("ts").alias("period")).agg(
        n("purchase").alias("strong_buy"), n("signup").alias("buy"), n("view").alias("hold"), n("click").alias("sell"), n("error").alias("strong_sell"), F.count_if(F.col("value") > 40).alias("up"), F.count_if(F.col("value") < 20).alias("down")
    )
    return va.analyst_consensus(c)


@R.add("analyst_overlay", f"""{YOY_SQL}, o as (select entity, fiscal_period, value as prediction, case when fiscal_year % 2 = 0 then 0.01 end as growth_next, 0.03 as growth_current from yoy where metric = 'revenue_yoy'),
x as (select *, (prediction - coalesce(growth_next, growth_current)) * 100 as dl from o) select entity, fiscal_period, round(dl, 4) as delta_pp, case when dl is null then 'unavailable' when abs(dl) < 2 then 'concur' when abs(dl) < 5 then 'moderate' else 'large' end as size, case when dl > 0 then 'above' when dl < 0 then 'below' when dl = 0 then 'equal' end as direction from x""")
def _(spark, d):
    y = mo.yoy_growth(facts(spark, d)).where("metric = 'revenue_yoy'").withColumn("prediction", F.col("value"))
    y = y.withColumn("growth_next", F.when(F.col("fiscal_year") % 2 == 0, F.lit(0.01))).withColumn("growth_current", F.lit(0.03))
    return va.analyst_overlay(y).select("entity", "fiscal_period", "delta_pp", "size", "direction")


KEY_LIST = "[" + ", ".join(f"'{m}'" for m in mt.KEY_METRICS) + "]"


@R.add("key_metrics", f"{LATEST_SQL} select entity, metric, value, fiscal_period, cast(list_position({KEY_LIST}, metric) as integer) as place from latest where list_contains({KEY_LIST}, metric)")
def _(spark, d):
    return mt.key_metrics(metrics(spark, d))


@R.add("segment_summary", f"""{FACTS_SQL}, {MAPPED_SQL}, s as (select entity, fiscal_period, normalized_category, round(sum(value), 4) as value from mapped group by all)
select *, round(value / nullif(sum(value) over (partition by entity), 0), 6) as share from s where fiscal_period = (select max(fiscal_period) from s t where t.entity = s.entity)""")
def _(spark, d):
    return mt.segment_summary(mapped(spark, d)).select("entity", "fiscal_period", "normalized_category", "value", "share")


@R.add("inflection_list", f"""{RATIOS_SQL}, w as (select *, avg(value) over p as m, stddev_samp(value) over p as s, count(value) over p as n from metrics window p as (partition by entity, metric)),
f as (select entity, fiscal_period, metric, value, cast(row_number() over (partition by entity order by fiscal_period, metric) as integer) as place from w where unit in ('ratio', 'ratio_yoy') and abs(value - m) > 2 * s and n >= 3 and s > 1e-12 and fiscal_year between 1996 and 2000) select * from f where place <= 10""")
def _(spark, d):
    return mt.inflection_list(mo.inflection_flags(metrics(spark, d)), first=1996, last=2000)


CATS = ["compute_and_networking", "data_center", "gaming", "gpu", "oem_and_other", "other"]


@R.add("mart_segment_mix", f"{FACTS_SQL}, {MAPPED_SQL} select entity, fiscal_period, {', '.join(f'round(sum(value) filter (normalized_category = {c!r}), 4) as {c}' for c in CATS)} from mapped group by all")
def _(spark, d):
    return mt.segment_mix(mapped(spark, d), CATS)


MARGINS = ["gross_margin", "operating_margin", "net_margin"]


@R.add("mart_margins", f"{RATIOS_SQL} select entity, fiscal_period, {', '.join(f'max(value) filter (metric = {c!r}) as {c}' for c in MARGINS)} from ratios where fiscal_period like '%-Q%' group by all")
def _(spark, d):
    return mt.wide_series(metrics(spark, d), MARGINS, annual=False)


@R.add("mart_fcf", f"{RATIOS_SQL} select entity, fiscal_period, a.value as fcf, b.value as fcf_margin from ratios a left join ratios b using (entity, fiscal_period) where a.metric = 'fcf' and b.metric = 'fcf_margin'")
def _(spark, d):
    return mt.fcf_series(metrics(spark, d))


@R.add("mart_growth", f"{YOY_SQL} select entity, fiscal_period, max(value) filter (metric = 'revenue_yoy') as revenue_yoy from yoy group by all having max(value) filter (metric = 'revenue_yoy') is not null")
def _(spark, d):
    return mt.wide_series(mo.yoy_growth(facts(spark, d), ["revenue"]), ["revenue_yoy"], annual=True)


@R.add("display_window", f"{FACTS_SQL} select distinct fiscal_period, fiscal_year between 1996 and 1999 as shown from facts")
def _(spark, d):
    return facts(spark, d).select("fiscal_period").distinct().withColumn("shown", mt.in_window("fiscal_period", 1996, 1999))


@R.add("peer_universe", f"with {TIERS_SQL}, e as (select n_name as ticker, list_sort(list(s_name)) as events from supplier join nation on s_nationkey = n_nationkey where s_acctbal < 0 group by 1) select n_name as ticker, coalesce(tier, 'context') as tier, coalesce(events, []) as events from nation left join tiers on ticker = n_name left join e on e.ticker = n_name")
def _(spark, d):
    e = table(spark, d, "supplier").where("s_acctbal < 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("ticker"), F.col("s_name").alias("event"))
    return mt.peer_universe(table(spark, d, "nation").select(F.col("n_name").alias("ticker")), tiers(spark, d), e)


@R.add("mart_scenarios", f"{VALUED_SQL} select entity, scenario, per_share, probability, cast(list_position(['bear', 'base', 'bull'], scenario) as integer) as place from valued")
def _(spark, d):
    return mt.scenario_values(valued(spark, d))


@R.add("mart_peer_comparison", f"{FILTER_SQL} select ticker, ev_revenue, pe from filtered where (ev_revenue is not null or pe is not null) and (select count(*) from filtered where ev_revenue is not null or pe is not null) >= 2")
def _(spark, d):
    return mt.peer_comparison(filtered(spark, d))


SCORE_SQL = "comp as (select 'E' || user_id as entity, event_type as component, case when event_type = 'view' then 'n/a' else cast(cast(round(max(value), 2) as decimal(12, 2)) as varchar) end as value, case when event_type = 'error' then 'blocked' when user_id % 5 = 0 then 'diagnostic' else 'usable' end as status from events group by user_id, event_type)"


@R.add("mart_scorecard", f"with {SCORE_SQL} select entity, component, case when status = 'usable' then try_cast(value as double) end as bar, case when status = 'usable' and try_cast(value as double) is not null then null when status <> 'usable' then status else 'non_numeric' end as reason from comp")
def _(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 2).cast("decimal(12,2)").cast("string").alias("v"))
    return mt.scorecard(c.select(F.expr("'E' || user_id").alias("entity"), F.col("event_type").alias("component"), F.expr("case when event_type = 'view' then 'n/a' else v end").alias("value"), F.expr("case when event_type = 'error' then 'blocked' when user_id % 5 = 0 then 'diagnostic' else 'usable' end").alias("status")))


@R.add("exhibit_status", f"""{FILTER_SQL}, {FACTS_SQL.strip()[5:]}, {MAPPED_SQL}, sq as (select entity, not bool_and(normalized_category in ('other', 'unclassified')) as renderable from mapped group by 1)
select entity, 'segment_mix' as exhibit, case when renderable then 'active' else 'suppressed' end as status from sq union all select entity, 'theme_heatmap', case when entity < 'NATION_2' then 'active' else 'appendix' end from sq
union all select entity, 'peer_multiples', case when (select count(*) from filtered where ev_revenue is not null or pe is not null) >= 2 then 'active' else 'suppressed' end from sq""")
def _(spark, d):
    from ledgerline.operators.segments import segment_quality

    q = segment_quality(mapped(spark, d), facts(spark, d).where("metric = 'revenue' and fp = 'FY'"))
    nlp = q.select("entity", F.expr("case when entity < 'NATION_2' then 'active' else 'appendix' end").alias("status"))
    usable = filtered(spark, d).agg(F.count_if(F.col("ev_revenue").isNotNull() | F.col("pe").isNotNull()).alias("n_usable"))
    return mt.exhibit_status(q, nlp, usable)
