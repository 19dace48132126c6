"""Queries of the fact and metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import facts as fo
from ledgerline.operators import metrics as mo
from ledgerline.operators import validity as vd
from ledgerline.plans.bindings import FACTS_SQL, METRICS, facts, table
from ledgerline.plans.registered import Registry

R = Registry()

RATIO_EXPR = {
    "gross_margin": "gross_profit / nullif(revenue, 0)", "operating_margin": "operating_income / nullif(revenue, 0)", "net_margin": "net_income / nullif(revenue, 0)",
    "roe": "net_income / nullif(shareholders_equity, 0)", "roa": "net_income / nullif(total_assets, 0)", "fcf": "operating_cash_flow - capex",
    "fcf_margin": "(operating_cash_flow - capex) / nullif(revenue, 0)", "debt_to_equity": "total_debt / nullif(shareholders_equity, 0)",
    "current_ratio": "current_assets / nullif(current_liabilities, 0)", "rd_pct_revenue": "r_and_d / nullif(revenue, 0)", "sga_pct_revenue": "sga / nullif(revenue, 0)", "diluted_eps": "diluted_eps",
}
RATIOS_SQL = f"""{FACTS_SQL}, ratios as (
  select entity, fy as fiscal_year, fiscal_period, u.metric, round(u.value, 6) as value, filed as source_available_date,
         case u.metric when 'fcf' then 'USD' when 'diluted_eps' then 'USD/shares' else 'ratio' end as unit
  from kept, unnest([{", ".join(f"{{'metric': '{n}', 'value': cast({e} as double)}}" for n, e in RATIO_EXPR.items())}]) as t(u)
), metrics as (
  select entity, fiscal_year, fiscal_period, metric, value, unit, source_available_date from ratios where metric <> 'diluted_eps'
  union all select entity, fiscal_year, fiscal_period, metric, value, unit, source_available_date from facts where metric in ({", ".join(f"'{m}'" for m in mo.PASSED)})
)
"""


def metrics(spark, d):
    """Ratios and raw lines, the long metric table."""
    f = facts(spark, d)
    r = mo.ratios(f).where("metric <> 'diluted_eps'")
    return r.unionByName(mo.line_items(f))


#: Lines of orders as filings of one fact: the return flag gives the form, the shipment the filing date.
FILED_SQL = """
filed as (
  select 'S' || l_suppkey as entity, 'P' || (l_partkey % 7) as metric, cast(year(o_orderdate) as integer) as fiscal_year, 'Q' || quarter(o_orderdate) as fp,
         case when l_partkey % 11 = 0 then null else cast(o_orderdate as date) - 30 * l_linenumber end as period_start, cast(o_orderdate as date) as period_end,
         cast(l_shipdate as date) as filing_date, case when l_returnflag = 'A' then '10-K' when l_returnflag = 'N' and l_linestatus = 'O' then '10-K/A' when l_returnflag = 'N' then '10-Q' when l_linestatus = 'O' then '10-Q/A' else '8-K' end as form_type,
         l_extendedprice as value, l_orderkey || '-' || l_linenumber as accession, case when l_quantity > 40 then 'CY' end as frame
  from lineitem join orders on l_orderkey = o_orderkey
)"""


def filed(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    form = F.expr("case when l_returnflag = 'A' then '10-K' when l_returnflag = 'N' and l_linestatus = 'O' then '10-K/A' when l_returnflag = 'N' then '10-Q' when l_linestatus = 'O' then '10-Q/A' else '8-K' end")
    end = F.to_date("o_orderdate")
    return line.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("entity"), F.concat(F.lit("P"), F.col("l_partkey") % 7).alias("metric"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("fp"),
        F.when(F.col("l_partkey") % 11 != 0, F.date_sub(end, F.col("l_linenumber") * 30)).alias("period_start"), end.alias("period_end"), F.to_date("l_shipdate").alias("filing_date"),
        form.alias("form_type"), F.col("l_extendedprice").alias("value"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accession"), F.when(F.col("l_quantity") > 40, "CY").alias("frame"),
    )


@R.add("period_classify", f"""with {FILED_SQL}, c as (select *, date_diff('day', period_start, period_end) as dd from filed)
select case when period_start is null then 'instant' when dd between 350 and 380 then 'annual' when dd < 100 then 'quarterly' when dd between 100 and 339 then 'ytd' else 'other' end as period_type,
       count(*) as n, cast(min(dd) as integer) as shortest, cast(max(dd) as integer) as longest from c group by 1""")  # fmt: skip
def _(spark, d):
    c = fo.period_classify(filed(spark, d))
    return c.groupBy("period_type").agg(F.count("*").alias("n"), F.min("duration_days").alias("shortest"), F.max("duration_days").alias("longest"))


RANK_SQL = "case form_type when '10-K' then 0 when '10-K/A' then 1 when '10-Q' then 2 when '10-Q/A' then 3 else 99 end"


@R.add("fact_dedup", f"""with {FILED_SQL}, r as (
  select *, row_number() over (partition by entity, metric, fiscal_year, fp order by {RANK_SQL}, period_end desc nulls last, filing_date desc nulls last, date_diff('day', period_start, period_end) desc nulls last, value desc, accession desc) as rn from filed)
select entity, metric, fiscal_year, fp, value, form_type, filing_date, accession from r where rn = 1""")
def _(spark, d):
    return fo.fact_dedup(filed(spark, d)).select("entity", "metric", "fiscal_year", "fp", "value", "form_type", "filing_date", "accession")


@R.add("amendment_resolve", f"""with {FILED_SQL}, r as (
  select *, {RANK_SQL} as selection_rank, count(*) over (partition by entity, metric, fiscal_year, {RANK_SQL}) as n,
         row_number() over (partition by entity, metric, fiscal_year order by {RANK_SQL}, filing_date desc nulls last, accession desc) as rn from filed)
select entity, metric, fiscal_year, value, accession, form_type || case when n > 1 then ' (latest amendment)' else '' end as selection_reason from r where rn = 1""")
def _(spark, d):
    ranked = filed(spark, d).withColumn("selection_rank", fo.form_rank()).withColumn("selection_reason", F.col("form_type"))
    return fo.amendment_resolve(ranked, keys=["entity", "metric", "fiscal_year"]).select("entity", "metric", "fiscal_year", "value", "accession", "selection_reason")


AS_OF_DAYS = [f"{y}-{m:02}-15" for y in range(1996, 2002) for m in (3, 6, 9, 12)]
AS_OF_SQL = f"""ranked as (select *, {RANK_SQL} as selection_rank from filed), days as (select distinct entity, metric, fiscal_year, filing_date as day from filed),
seen as (select d.day, r.*, count(*) over (partition by d.entity, d.metric, d.fiscal_year, d.day, selection_rank) > 1 as several,
  row_number() over (partition by d.entity, d.metric, d.fiscal_year, d.day order by selection_rank, filing_date desc nulls last, accession desc) as rn
  from days d join ranked r on (r.entity, r.metric, r.fiscal_year) = (d.entity, d.metric, d.fiscal_year) and r.filing_date <= d.day)"""


def amendments(spark, d):
    """Every report's interval of validity for its entity, metric and fiscal year."""
    ranked = filed(spark, d).withColumn("selection_rank", fo.form_rank())
    return vd.validity(ranked, keys=["entity", "metric", "fiscal_year"], best=vd.amendment_order(), rank="selection_rank", available="filing_date")


@R.add("fact_validity", f"""with {FILED_SQL}, {AS_OF_SQL}, c as (select *, lag((accession, value, several)) over w as before from seen where rn = 1 window w as (partition by entity, metric, fiscal_year order by day))
select entity, metric, fiscal_year, accession, value, several, day as known_from, lead(day) over (partition by entity, metric, fiscal_year order by day) as known_to from c where (accession, value, several) is distinct from before""")
def _(spark, d):
    return amendments(spark, d).select("entity", "metric", "fiscal_year", "accession", "value", "several", "known_from", "known_to")


@R.add("facts_at_dates", f"""with {FILED_SQL}, dates as (select cast(unnest({AS_OF_DAYS}) as date) as as_of), seen as (
  select as_of, f.*, row_number() over (partition by as_of, entity, metric, fiscal_year order by {RANK_SQL}, filing_date desc nulls last, accession desc) as rn from dates join filed f on f.filing_date <= as_of)
select as_of, entity, metric, fiscal_year, accession, value from seen where rn = 1""")
def _(spark, d):
    """Facts resolved once, as they were known on each of many dates."""
    return vd.at_dates(amendments(spark, d), AS_OF_DAYS).select("as_of", "entity", "metric", "fiscal_year", "accession", "value")


#: Concepts: a metric's own name, or one of two stand-ins, as the discount of its line has it.
TAGGED_SQL = """
tagged as (
  select 'S' || l_suppkey as entity, ['Alpha', 'Beta', 'Gamma', 'Delta'][1 + cast(l_partkey % 4 as integer)] as concept, case when l_linenumber <= 2 then 'shares' when l_linenumber <= 4 then 'USD' else 'EUR' end as unit,
         cast(year(o_orderdate) as integer) as fy, 'Q' || quarter(o_orderdate) as fp, date_trunc('quarter', cast(o_orderdate as date)) as s, last_day(cast(o_orderdate as date)) as e,
         cast(l_shipdate as date) as filed, l_orderkey || '-' || l_linenumber as accn, l_extendedprice as val
  from lineitem join orders on l_orderkey = o_orderkey
), cmap(metric, concept, priority) as (values ('one', 'Alpha', 0), ('one', 'Beta', 1), ('two', 'Gamma', 0), ('two', 'Alpha', 1), ('three', 'Omega', 0))"""


def tagged(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("entity"), F.element_at(F.lit(["Alpha", "Beta", "Gamma", "Delta"]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("concept"),
        F.expr("case when l_linenumber <= 2 then 'shares' when l_linenumber <= 4 then 'USD' else 'EUR' end").alias("unit"), F.year("o_orderdate").alias("fy"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("fp"),
        F.trunc(F.to_date("o_orderdate"), "quarter").alias("start"), F.last_day("o_orderdate").alias("end"), F.to_date("l_shipdate").alias("filed"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accn"), F.col("l_extendedprice").alias("val"),
    )


def cmap(spark):
    return fo.concept_map(spark, {"one": ["Alpha", "Beta"], "two": ["Gamma", "Alpha"], "three": ["Omega"]})


@R.add("unit_pick", f"""with {TAGGED_SQL}, b as (
  select entity, concept, arg_min(unit, (case unit when 'USD' then 0 when 'USD/shares' then 1 when 'shares' then 2 else 3 end)) as unit from tagged group by all)
select entity, concept, unit, count(*) as n from tagged join b using (entity, concept, unit) group by all""")
def _(spark, d):
    return fo.unit_pick(tagged(spark, d)).groupBy("entity", "concept", "unit").agg(F.count("*").alias("n"))


@R.add("concept_merge", f"""with {TAGGED_SQL}, r as (
  select *, row_number() over (partition by entity, metric, fy, fp, s, e order by priority, filed desc nulls last, accn desc, val desc) as rn from tagged join cmap using (concept))
select entity, metric, fy, fp, concept, accn, val from r where rn = 1""")
def _(spark, d):
    return fo.concept_merge(tagged(spark, d), cmap(spark)).select("entity", "metric", "fy", "fp", "concept", "accn", "val")


@R.add("fallback_report", f"""with {TAGGED_SQL}, used as (select distinct entity, metric, concept from tagged join cmap using (concept)), names as (select distinct metric from cmap)
select entity, metric, cast(null as varchar) as concept, 'missing' as kind from (select distinct entity from used) en, names where not exists (select 1 from used u where u.entity = en.entity and u.metric = names.metric)
union all select entity, metric, u.concept, 'fallback' from used u join cmap m using (metric) where m.priority = 0 and m.concept <> u.concept""")
def _(spark, d):
    return fo.fallback_report(tagged(spark, d).join(cmap(spark), "concept"), cmap(spark))


@R.add("fiscal_year_ends", f"""{FACTS_SQL}, own as (select entity, fiscal_year, max(period_end) as e from facts where form_type in ('10-K', '10-K/A') and date_diff('day', period_start, period_end) between 350 and 380 group by all),
pub as (select distinct entity, y as fiscal_year, make_date(y, 12, 30) as p from facts, unnest([1999, 2001]) as t(y))
select entity, fiscal_year, coalesce(e, p) as fy_end from own full join pub using (entity, fiscal_year)""")
def _(spark, d):
    f = fo.period_classify(facts(spark, d))
    published = f.select("entity").distinct().withColumn("fiscal_year", F.explode(F.lit([1999, 2001]))).withColumn("fy_end", F.make_date("fiscal_year", F.lit(12), F.lit(30)))
    return fo.fiscal_year_ends(f, published)


#: Annual facts as filed, with comparatives of the year before under the same year's tag.
ANNUAL_SQL = """
tagged_annual as (
  select entity, metric, fiscal_year + k as fiscal_year, value, period_start, period_end, source_available_date + 200 * k as filing_date, case when k = 1 then '10-K/A' when value > 0 then form_type else '10-Q' end as form_type,
         accession || '-' || k as accession, case when fiscal_year % 2 = 0 then 'CY' end as frame, date_diff('day', period_start, period_end) as dd
  from facts, unnest([0, 1]) as t(k) where period_start is not null
)"""


@R.add("annual_select", f"""{FACTS_SQL}, {ANNUAL_SQL}, ends as (select entity, fiscal_year, max(period_end) as fy_end from tagged_annual where form_type in ('10-K', '10-K/A') and dd between 350 and 380 group by all),
c as (select a.* exclude (fiscal_year), e.fiscal_year, case when form_type in ('10-K', '10-K/A') then 1 when frame is not null then 2 else 3 end as rk
  from tagged_annual a join ends e on a.entity = e.entity and abs(date_diff('day', fy_end, period_end)) <= 5 where dd between 350 and 380),
r as (select *, count(*) over (partition by entity, metric, fiscal_year, rk) as n, row_number() over (partition by entity, metric, fiscal_year order by rk, filing_date desc nulls last, accession desc, value desc) as rn from c)
select entity, metric, fiscal_year, value, accession, cast(rk as integer) as selection_rank, ['annual_form', 'frame', 'fallback'][rk] || case when n > 1 then ' (latest amendment)' else '' end as selection_reason from r where rn = 1
union all select entity, metric, fiscal_year, value, accession, null, null from tagged_annual where not dd between 350 and 380""")
def _(spark, d):
    f = facts(spark, d).where("period_start is not null").withColumn("k", F.explode(F.lit([0, 1])))
    f = f.select(
        "entity", "metric", (F.col("fiscal_year") + F.col("k")).alias("fiscal_year"), "value", "period_start", "period_end", F.date_add("source_available_date", F.col("k") * 200).alias("filing_date"),
        F.expr("case when k = 1 then '10-K/A' when value > 0 then form_type else '10-Q' end").alias("form_type"), F.concat_ws("-", "accession", "k").alias("accession"), F.when(F.col("fiscal_year") % 2 == 0, "CY").alias("frame"),
    )
    f = fo.period_classify(f)
    return fo.annual_select(f, fo.fiscal_year_ends(f)).select("entity", "metric", "fiscal_year", "value", "accession", "selection_rank", "selection_reason")


@R.add("split_adjust", f"""{FACTS_SQL}, splits(split_date, ratio) as (values (date '1997-06-01', 2), (date '1999-03-01', 4), (date '2000-01-01', 1)),
f as (select f.*, coalesce((select product(ratio) from splits where ratio > 1 and split_date > f.period_end and f.entity < 'NATION_2'), 1.0) as k from facts f where metric in ('diluted_eps', 'diluted_shares', 'revenue'))
select entity, metric, fiscal_period, value as raw_value, cast(k as double) as adjustment_factor, round(case metric when 'diluted_shares' then value * k when 'diluted_eps' then value / k else value end, 8) as value,
       case when metric <> 'revenue' and k <> 1 then 'split_adjusted' else 'as_reported' end as adjustment_basis, case when metric = 'diluted_eps' then 'raw_value' else 'value' end as validation_basis from f""")
def _(spark, d):
    f = facts(spark, d).where("metric in ('diluted_eps', 'diluted_shares', 'revenue')")
    splits = f.where("entity < 'NATION_2'").select("entity").distinct().withColumn("s", F.explode(F.expr("array(struct(date'1997-06-01' as split_date, 2 as ratio), struct(date'1999-03-01' as split_date, 4 as ratio), struct(date'2000-01-01' as split_date, 1 as ratio))"))).select("entity", "s.*")
    out = fo.split_adjust(f, splits)
    return out.select("entity", "metric", "fiscal_period", "raw_value", "adjustment_factor", F.round("value", 8).alias("value"), "adjustment_basis", "validation_basis")


@R.add("coverage_summary", f"""{FACTS_SQL} select entity, count(distinct metric) as metrics_found, round(count(distinct metric) * 100.0 / 21, 4) as coverage_pct, min(fiscal_year) as first_fy, max(fiscal_year) as last_fy, count(*) as n_facts from facts group by 1""")
def _(spark, d):
    return fo.coverage_summary(facts(spark, d), len(fo.CONCEPTS))


PHRASE_SQL = r"(?is)the.{0,400}?\(\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*\)"


@R.add("missing_period_fill", f"""{FACTS_SQL}, f as (select * from facts where not (metric = 'capex' and fiscal_year % 2 = 0)), texts as (select accession, 'Cash used for the item (' || fiscal_year || ',' || lpad(cast(length(accession) as varchar), 3, '0') || ') in all' as text from facts where metric = 'revenue'),
open_ as (select a.* from f a where metric = 'operating_cash_flow' and not exists (select 1 from f b where b.metric = 'capex' and (a.entity, a.fiscal_year, a.fp) = (b.entity, b.fiscal_year, b.fp)))
select entity, fiscal_period, 'capex' as metric, cast(replace(nullif(regexp_extract(text, '{PHRASE_SQL}', 1), ''), ',', '') as double) * 1e6 as value, 'html_cash_flow_extraction' as selection_reason from open_ join texts using (accession)""")
def _(spark, d):
    f = facts(spark, d)
    docs = f.where("metric = 'revenue'").select("accession", F.concat(F.lit("Cash used for the item ("), F.col("fiscal_year"), F.lit(","), F.lpad(F.length("accession").cast("string"), 3, "0"), F.lit(") in all")).alias("text"))
    out = fo.missing_period_fill(f.where("not (metric = 'capex' and fiscal_year % 2 = 0)"), docs, phrase="the")
    return out.where("selection_reason is not null").select("entity", "fiscal_period", "metric", "value", "selection_reason")


@R.add("fact_pivot", f"{FACTS_SQL} select entity, fy as fiscal_year, fiscal_period, {', '.join(mo.INPUTS)} from kept")
def _(spark, d):
    return mo.fact_pivot(facts(spark, d), mo.INPUTS)


@R.add("ratios", f"{RATIOS_SQL} select * from ratios")
def _(spark, d):
    return mo.ratios(facts(spark, d))


@R.add("line_items_passthrough", f"{FACTS_SQL} select entity, fiscal_year, fiscal_period, metric, value, unit, source_available_date from facts where metric in ({', '.join(repr(m) for m in mo.PASSED)})")
def _(spark, d):
    return mo.line_items(facts(spark, d))


YOY_SQL = f"""{FACTS_SQL}, y as (select *, lag(value) over w as p, lag(fiscal_year) over w as py from facts where fp = 'FY' and metric in ('revenue', 'operating_income') window w as (partition by entity, metric order by fiscal_year)),
yoy as (select entity, fiscal_year, fiscal_period, metric || '_yoy' as metric, round((value - p) / nullif(p, 0), 6) as value, 'ratio_yoy' as unit, source_available_date from y where py = fiscal_year - 1 and (value - p) / nullif(p, 0) is not null)
"""


@R.add("yoy_growth", f"{YOY_SQL} select * from yoy")
def _(spark, d):
    return mo.yoy_growth(facts(spark, d))


@R.add("ttm", f"""{FACTS_SQL}, r as (select entity, 'FY' || fy || '-Q' || q as fiscal_period, fy * 4 + q - 1 as qidx, revenue from quarters)
select entity, fiscal_period, case when count(revenue) over w = 4 and qidx - min(qidx) over w = 3 then round(sum(revenue) over w, 4) end as ttm, count(revenue) over w as periods_used
from r window w as (partition by entity order by qidx rows between 3 preceding and current row)""")
def _(spark, d):
    from ledgerline.plans.bindings import quarters

    q = quarters(spark, d).select("entity", F.lit("revenue").alias("metric"), F.concat(F.lit("FY"), "fy", F.lit("-Q"), "q").alias("fiscal_period"), F.col("revenue").alias("value"))
    return mo.ttm(q, "revenue")


@R.add("inflection_flags", f"""{RATIOS_SQL}, w as (select *, avg(value) over p as m, stddev_samp(value) over p as s, count(value) over p as n from metrics window p as (partition by entity, metric))
select entity, fiscal_year, fiscal_period, metric, value, unit, source_available_date, case when unit in ('ratio', 'ratio_yoy') then coalesce(abs(value - m) > 2 * s and n >= 3 and s > 1e-12, false) else false end as is_inflection from w""")
def _(spark, d):
    return mo.inflection_flags(metrics(spark, d)).select("entity", "fiscal_year", "fiscal_period", "metric", "value", "unit", "source_available_date", "is_inflection")


LATEST_SQL = f"""{RATIOS_SQL}, latest as (
  select entity, metric, arg_max(value, (case when regexp_matches(fiscal_period, '^FY[0-9]{{4}}$') then '1' else '0' end) || fiscal_period) as value,
         arg_max(fiscal_period, (case when regexp_matches(fiscal_period, '^FY[0-9]{{4}}$') then '1' else '0' end) || fiscal_period) as fiscal_period
  from metrics where value is not null group by all)
"""


@R.add("latest_annual_value", f"{LATEST_SQL} select * from latest")
def _(spark, d):
    return mo.latest_annual_value(metrics(spark, d))


NATION_PRICES_SQL = "np as (select entity, fy, q, floor(cast(sum(cast(l_extendedprice / l_quantity as decimal(20, 8))) as double) / count(*) * 10000) / 10000.0 as adj_close, max(cast(l_shipdate as date)) as date from lines group by all)"
INPUTS_SQL = f"""{LATEST_SQL}, {NATION_PRICES_SQL}, lp as (select entity, arg_max(adj_close, date) as price from (select entity, date, max(adj_close) as adj_close from np group by all) where adj_close > 0 and date <= date '2001-12-31' group by 1),
inputs as (select entity, max(case metric when 'revenue' then value end) as base_revenue,
  round(coalesce(max(case metric when 'cash_and_securities' then value end), 0) - coalesce(nullif(max(case metric when 'total_debt' then value end), 0), 0), 4) as net_cash,
  max(case when metric = 'diluted_shares' and value > 0 then value end) as diluted_shares, any_value(price) as price from latest left join lp using (entity) group by 1)
"""


def nation_prices(spark, d):
    """One price for each nation and last shipment day of a quarter's orders."""
    from ledgerline.plans.bindings import lines

    p = lines(spark, d).groupBy("entity", "fy", "q").agg((F.floor(F.sum((F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(20,8)")).cast("double") / F.count("*") * 10000) / 10000.0).alias("adj_close"), F.max(F.to_date("l_shipdate")).alias("date"))
    return p.groupBy(F.col("entity").alias("ticker"), "date").agg(F.max("adj_close").alias("adj_close"))


def inputs(spark, d):
    return mo.valuation_inputs(metrics(spark, d), nation_prices(spark, d))


@R.add("valuation_inputs", f"{INPUTS_SQL} select * from inputs")
def _(spark, d):
    return inputs(spark, d)


@R.add("subject_peer_row", f"""{INPUTS_SQL}, w as (select entity, {', '.join(f"max(case metric when '{m}' then value end) as {m}" for m in ('total_debt', 'cash_and_securities', 'operating_income', 'net_income', 'operating_cash_flow', 'capex'))} from latest group by 1)
select entity as ticker, round(price * diluted_shares, 4) as market_cap, total_debt, cash_and_securities, base_revenue as revenue, operating_income as ebitda, net_income, round(operating_cash_flow - capex, 4) as free_cash_flow from inputs join w using (entity)""")
def _(spark, d):
    return mo.subject_peer_row(metrics(spark, d), inputs(spark, d))


@R.add("fcf_margin_reconcile", f"{LATEST_SQL} select entity, fiscal_period, value as historical, 0.35 as fcf_margin_start, 0.30 as fcf_margin_terminal, round(value - 0.35, 6) as gap from latest where metric = 'fcf_margin'")
def _(spark, d):
    from ledgerline.operators.valuation import scenario_table

    return mo.fcf_margin_reconcile(metrics(spark, d), scenario_table(spark))


HIST = ["revenue", "net_income", "operating_cash_flow", "r_and_d", "gross_margin", "operating_margin"]


@R.add("historical_table", f"""{RATIOS_SQL} select entity, fiscal_year, {', '.join(f"max(case metric when '{m}' then value end) as {m}" for m in HIST)} from metrics where regexp_matches(fiscal_period, '^FY[0-9]{{4}}$') group by all""")
def _(spark, d):
    return mo.historical_table(metrics(spark, d))


FLAGSHIP_SQL = f"""{LATEST_SQL}, y as (select *, lag(value) over w as p, lag(fiscal_year) over w as py from facts where fp = 'FY' and metric in ('revenue', 'operating_income') and source_available_date <= date '2000-12-31' window w as (partition by entity, metric order by fiscal_year)),
a as (select entity, metric, arg_max(value, (case when length(fiscal_period) = 6 then '1' else '0' end) || fiscal_period) as value from (
  select entity, metric, value, fiscal_period from ratios where metric <> 'diluted_eps' and source_available_date <= date '2000-12-31'
  union all select entity, metric || '_yoy', round((value - p) / nullif(p, 0), 6), fiscal_period from y where py = fiscal_year - 1) where value is not null group by all)
select entity, metric, value from a where metric in ('gross_margin', 'operating_margin', 'net_margin', 'fcf_margin', 'revenue_yoy', 'operating_income_yoy')"""


@R.add("latest_margins_as_of", FLAGSHIP_SQL)
def flagship(spark, d):
    """Latest annual margins and growth of each entity, as they could be known at the end of 2000."""
    from ledgerline.operators.gates import as_of

    f = as_of(facts(spark, d), "2000-12-31")
    r = mo.ratios(f).where("metric <> 'diluted_eps'").unionByName(mo.yoy_growth(f))
    names = ["gross_margin", "operating_margin", "net_margin", "fcf_margin", "revenue_yoy", "operating_income_yoy"]
    return mo.latest_annual_value(r).where(F.col("metric").isin(*names)).select("entity", "metric", "value")
