"""Queries of the market and panel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import market as ma
from ledgerline.operators import panel as pa
from ledgerline.plans.bindings import FACTS_SQL, PRICES_SQL, facts, prices, quarters, table
from ledgerline.plans.fact_queries import RATIOS_SQL, metrics, nation_prices
from ledgerline.plans.registered import Registry

R = Registry()
SECTOR, BROAD = "EUROPE", "ALL"
#: As-of dates: the middle and the end of every quarter of six years, and one invalid date.
PROBES_SQL = """
probes as (select distinct ticker, a as as_of from prices, (select make_date(cast(y as integer), m, dd) as a from range(1996, 2002) t(y), unnest([2, 5, 8, 11]) u(m), unnest([1, 15]) v(dd)))"""


def probes(spark, d):
    dates = F.expr("flatten(flatten(transform(sequence(1996, 2001), y -> transform(array(2, 5, 8, 11), m -> transform(array(1, 15), x -> make_date(y, m, x))))))")
    return prices(spark, d).select("ticker").distinct().withColumn("as_of", F.explode(dates))


SPARSE_SQL = f"{PRICES_SQL}, sparse as (select * from prices where date_diff('day', date '1995-01-01', date) % 9 in (0, 1, 4))"


def sparse(spark, d):
    return prices(spark, d).where("pmod(date_diff(date, date'1995-01-01'), 9) in (0, 1, 4)")


@R.add("locf", f"""{SPARSE_SQL}, n as (select *, lead(date) over (partition by ticker order by date) as nx from sparse)
select ticker, cast(g as date) as date, date as observed, adj_close, source_available_date from n, unnest(generate_series(date, greatest(date, least(date + 3, coalesce(nx - 1, date))), interval 1 day)) as t(g)""")
def _(spark, d):
    return ma.locf(sparse(spark, d)).select("ticker", "date", "observed", "adj_close", "source_available_date")


@R.add("price_clean", """with raw as (select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as date, case when l_linenumber % 5 = 0 then null else l_extendedprice end as adj_close, l_orderkey * 10 + l_linenumber as seq from lineitem)
select ticker, date, arg_max(adj_close, seq) as adj_close from raw where adj_close is not null group by all""")
def _(spark, d):
    raw = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.expr("case when l_linenumber % 5 = 0 then null else l_extendedprice end").alias("adj_close"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return ma.price_clean(raw)


@R.add("index_alias_resolve", f"""{PRICES_SQL}, a("index", ticker, rank) as (values ('semis', 'SOX', 0), ('semis', 'EUROPE', 1), ('semis', 'ASIA', 2), ('broad', 'SPX', 0), ('broad', 'ALL', 1), ('none', 'XXX', 0))
select "index", arg_min(ticker, rank) as ticker from a where ticker in (select ticker from prices) group by 1""")
def _(spark, d):
    a = spark.createDataFrame([("semis", "SOX", 0), ("semis", "EUROPE", 1), ("semis", "ASIA", 2), ("broad", "SPX", 0), ("broad", "ALL", 1), ("none", "XXX", 0)], "index string, ticker string, rank int")
    return ma.index_alias_resolve(prices(spark, d), a)


RETURNS_SQL = f"""{PRICES_SQL}, {PROBES_SQL}, ret as (
  select p.ticker, as_of, round(n.adj_close / nullif(s.adj_close, 0) - 1, 6) as return_3m, round(n.adj_close / nullif(l.adj_close, 0) - 1, 6) as return_12m
  from probes p asof left join prices n on p.ticker = n.ticker and p.as_of >= n.date
  asof left join prices s on p.ticker = s.ticker and p.as_of - 90 >= s.date asof left join prices l on p.ticker = l.ticker and p.as_of - 365 >= l.date)
"""


def returns(spark, d):
    return ma.trailing_returns(probes(spark, d), prices(spark, d), {"return_3m": ma.SHORT, "return_12m": ma.LONG})


@R.add("trailing_return", f"{RETURNS_SQL} select * from ret")
def _(spark, d):
    return returns(spark, d)


@R.add("excess_return", f"""{RETURNS_SQL} select a.ticker, a.as_of, round(a.return_3m - s.return_3m, 6) as excess_sector_3m, round(a.return_12m - s.return_12m, 6) as excess_sector_12m, round(a.return_3m - b.return_3m, 6) as excess_broad_3m, round(a.return_12m - b.return_12m, 6) as excess_broad_12m
from ret a left join ret s on s.ticker = 'EUROPE' and s.as_of = a.as_of left join ret b on b.ticker = 'ALL' and b.as_of = a.as_of""")
def _(spark, d):
    return ma.excess_returns(probes(spark, d), prices(spark, d), sector=SECTOR, broad=BROAD).select("ticker", "as_of", *(f"excess_{n}_{s}" for n in ("sector", "broad") for s in ("3m", "12m")))


@R.add("peer_spread", f"""{RETURNS_SQL} select o.as_of, round(o.return_12m - a.return_12m, 6) as "spread_ASIA", round(o.return_12m - m.return_12m, 6) as "spread_AMERICA"
from ret o left join ret a on a.ticker = 'ASIA' and a.as_of = o.as_of left join ret m on m.ticker = 'AMERICA' and m.as_of = o.as_of where o.ticker = 'AFRICA'""")
def _(spark, d):
    return ma.peer_spread(returns(spark, d), "AFRICA", ["ASIA", "AMERICA"])


VOL_SQL = """vol as (select ticker, as_of, case when count(*) >= 10 and count(r) >= 5 then round(stddev_samp(r) * sqrt(252.0), 6) end as volatility_60d from (
  select p.ticker, p.as_of, ln(x.adj_close / nullif(lag(x.adj_close) over (partition by p.ticker, p.as_of order by x.date), 0)) as r
  from probes p join prices x on x.ticker = p.ticker and x.date between p.as_of - 60 and p.as_of) group by all)"""
BETA_SQL = """bt as (select ticker, as_of, case when count(*) >= 30 and count(rx + ry) >= 30 then round(covar_samp(rx, ry) / nullif(var_samp(case when rx is not null then ry end), 0), 6) end as beta_252d from (
  select p.ticker, p.as_of, x.adj_close / nullif(lag(x.adj_close) over w, 0) - 1 as rx, b.adj_close / nullif(lag(b.adj_close) over w, 0) - 1 as ry
  from probes p join prices x on x.ticker = p.ticker and x.date between p.as_of - 252 and p.as_of join prices b on b.ticker = 'EUROPE' and b.date = x.date window w as (partition by p.ticker, p.as_of order by x.date)) group by all)"""


@R.add("volatility_60d", f"{PRICES_SQL}, {PROBES_SQL}, {VOL_SQL} select ticker, as_of, volatility_60d from probes left join vol using (ticker, as_of)")
def _(spark, d):
    return ma.volatility(probes(spark, d), prices(spark, d))


@R.add("beta_252d", f"{PRICES_SQL}, {PROBES_SQL}, {BETA_SQL} select ticker, as_of, beta_252d from probes left join bt using (ticker, as_of)")
def _(spark, d):
    return ma.beta(probes(spark, d), prices(spark, d), SECTOR)


@R.add("market_features", f"""{RETURNS_SQL}, {VOL_SQL}, {BETA_SQL} select a.ticker, a.as_of, a.return_3m, a.return_12m, round(a.return_3m - s.return_3m, 6) as excess_sector_3m, round(a.return_12m - s.return_12m, 6) as excess_sector_12m,
round(a.return_3m - b.return_3m, 6) as excess_broad_3m, round(a.return_12m - b.return_12m, 6) as excess_broad_12m, volatility_60d, beta_252d
from ret a left join ret s on s.ticker = 'EUROPE' and s.as_of = a.as_of left join ret b on b.ticker = 'ALL' and b.as_of = a.as_of left join vol v on v.ticker = a.ticker and v.as_of = a.as_of left join bt on bt.ticker = a.ticker and bt.as_of = a.as_of""")
def _(spark, d):
    return ma.market_features(probes(spark, d), prices(spark, d), sector=SECTOR, broad=BROAD)


@R.add("period_algebra", f"""{FACTS_SQL} select distinct fiscal_period, fy as y, case when fp = 'FY' then null else q end as quarter, fy * 4 + q - 1 as qidx,
'FY' || ((fy * 4 + q) // 4) || '-Q' || ((fy * 4 + q) % 4 + 1) as next_label, 'FY' || ((fy * 4 + q - 2) // 4) || '-Q' || ((fy * 4 + q - 2) % 4 + 1) as previous_label from kept""")
def _(spark, d):
    from ledgerline.functions import columns as c

    f = facts(spark, d).select("fiscal_period").distinct()
    return f.select("fiscal_period", c.fiscal_year("fiscal_period").alias("y"), c.fiscal_quarter("fiscal_period").alias("quarter"), c.quarter_index("fiscal_period").alias("qidx"), c.next_quarter("fiscal_period").alias("next_label"), c.previous_quarter("fiscal_period").alias("previous_label"))


SKELETON_SQL = "skel as (select entity, fiscal_period, fiscal_year * 4 + cast(right(fp, 1) as integer) - 1 as qidx, source_available_date as feature_available_date from facts where metric = 'revenue' and fp <> 'FY')"
FLOW_LIST = ", ".join(f"'{n}'" for n in pa.FLOW_NAMES)
QUARTER_SQL = f"""wideq as (select entity, metric, fiscal_year as fy, max(case fp when 'FY' then value end) as v0, max(case fp when 'Q1' then value end) as v1, max(case fp when 'Q2' then value end) as v2, max(case fp when 'Q3' then value end) as v3
  from facts where metric in ({FLOW_LIST}) group by all),
flows as (select entity, metric, 'FY' || fy || '-Q' || (k + 1) as fiscal_period, fy * 4 + k as qidx, round([v1, v2 - v1, v3 - v2, v0 - v3][k + 1], 4) as value, coalesce(abs(v1 + (v2 - v1) + (v3 - v2) + (v0 - v3) - v0) > 0.01 * abs(v0), false) as imputed
  from wideq, unnest([0, 1, 2, 3]) as t(k))"""


@R.add("panel_skeleton", f"{FACTS_SQL}, {SKELETON_SQL} select * from skel")
def _(spark, d):
    return pa.skeleton(facts(spark, d))


@R.add("ytd_to_quarter", f"{FACTS_SQL}, {QUARTER_SQL} select entity, metric, fiscal_period, qidx, value from flows")
def _(spark, d):
    return pa.ytd_to_quarter(facts(spark, d)).drop("imputed")


@R.add("sum_to_annual_check", f"""{FACTS_SQL}, g as (select * replace (case when fp = 'FY' and fiscal_year % 3 = 0 then value * 1.05 else value end as value) from facts where metric in ({FLOW_LIST})),
w as (select entity, metric, fiscal_year as fy, max(case fp when 'FY' then value end) as v0, max(case fp when 'Q4' then value end) as v4, max(case fp when 'Q3' then value end) as v3, max(case fp when 'Q1' then value end) as v1, max(case fp when 'Q2' then value end) as v2 from g group by all)
select entity, metric, fy as fiscal_year, coalesce(abs(v1 + (v2 - v1) + (v3 - v2) + (v0 - v3) - v0) > 0.01 * abs(v0), false) as imputed from w""")
def _(spark, d):
    g = facts(spark, d).withColumn("value", F.expr("case when fp = 'FY' and fiscal_year % 3 = 0 then value * 1.05 else value end"))
    return pa.ytd_to_quarter(g).groupBy("entity", "metric", F.floor(F.col("qidx") / 4).cast("int").alias("fiscal_year")).agg(F.bool_or("imputed").alias("imputed"))


RN = pa.RATIO_NAMES


@R.add("ratio_attach", f"""{RATIOS_SQL}, {SKELETON_SQL}, w as (select entity, fiscal_period, {', '.join(f"max(case metric when '{m}' then value end) as {m}" for m in RN)} from ratios group by all)
select skel.*, {', '.join(RN)} from skel left join w using (entity, fiscal_period)""")
def _(spark, d):
    return pa.ratio_attach(pa.skeleton(facts(spark, d)), metrics(spark, d))


def quarter_panel(spark, d):
    """True quarters as a panel, with a hole: the second quarter of years divisible by 3."""
    q = quarters(spark, d).where("not (q = 2 and fy % 3 = 0)")
    return q.select("entity", F.concat(F.lit("FY"), "fy", F.lit("-Q"), "q").alias("fiscal_period"), (F.col("fy") * 4 + F.col("q") - 1).alias("qidx"), F.col("filed").alias("feature_available_date"), "revenue", "operating_income", "r_and_d", "capex")


QP_SQL = "qp as (select entity, 'FY' || fy || '-Q' || q as fiscal_period, fy * 4 + q - 1 as qidx, filed as feature_available_date, revenue, operating_income, r_and_d, capex from quarters where not (q = 2 and fy % 3 = 0))"
GROWTH = ", ".join(f"round((a.{n} - {t}.{n}) / nullif(abs({t}.{n}), 0), 6) as {n}_{tag}" for t, tag in (("b", "qoq"), ("c", "yoy")) for n in ("revenue", "operating_income"))


@R.add("qoq_yoy", f"{FACTS_SQL}, {QP_SQL} select a.entity, a.fiscal_period, {GROWTH} from qp a left join qp b on a.entity = b.entity and b.qidx = a.qidx - 1 left join qp c on a.entity = c.entity and c.qidx = a.qidx - 4")
def _(spark, d):
    return pa.qoq_yoy(quarter_panel(spark, d), ["revenue", "operating_income"]).select("entity", "fiscal_period", "revenue_qoq", "operating_income_qoq", "revenue_yoy", "operating_income_yoy")


@R.add("intensity", f"{FACTS_SQL}, {QP_SQL} select entity, fiscal_period, round(r_and_d / nullif(revenue, 0), 6) as rd_intensity, round(capex / nullif(revenue, 0), 6) as capex_intensity from qp")
def _(spark, d):
    return pa.intensity(quarter_panel(spark, d)).select("entity", "fiscal_period", "rd_intensity", "capex_intensity")


@R.add("operating_leverage", f"{FACTS_SQL}, {QP_SQL} select a.entity, a.fiscal_period, round((a.operating_income - c.operating_income) / nullif(a.revenue - c.revenue, 0), 6) as operating_leverage from qp a left join qp c on a.entity = c.entity and c.qidx = a.qidx - 4")
def _(spark, d):
    return pa.operating_leverage(quarter_panel(spark, d)).select("entity", "fiscal_period", "operating_leverage")


TEXT_SQL = "tf as (select source as section, 'A' || (doc_id % 50) as accession, lang as feature_name, n_chars * 1.0 as value, date '2000-01-01' + cast(doc_id as integer) as filing_date from documents where source in ('src0', 'src1'))"


@R.add("attach_text_features", f"""with {TEXT_SQL}, p as (select 'A' || k as accession from range(60) t(k)), l as (select accession, section, feature_name, arg_max(value, filing_date) as value from tf group by all)
select accession, {', '.join(f"max(case when section = '{s}' and feature_name = '{g}' then value end) as nlp_{s}_{g}" for s in ('src0', 'src1') for g in ('en', 'de'))} from p left join l using (accession) group by 1""")
def _(spark, d):
    docs = table(spark, d, "documents").where("source in ('src0', 'src1')")
    tf = docs.select(F.col("source").alias("section"), F.concat(F.lit("A"), F.col("doc_id") % 50).alias("accession"), F.col("lang").alias("feature_name"), F.col("n_chars").cast("double").alias("value"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")).alias("filing_date"))
    p = spark.range(60).select(F.concat(F.lit("A"), F.col("id")).alias("accession"))
    return pa.attach_text_features(p, tf, [f"nlp_{s}_{g}" for s in ("src0", "src1") for g in ("en", "de")])


@R.add("attach_market", f"""{RETURNS_SQL}, dates as (select distinct ticker as entity, as_of as feature_available_date from probes union select distinct ticker, as_of + 1 from probes) select entity, feature_available_date, return_3m, return_12m from dates left join ret on ret.ticker = entity and as_of = feature_available_date""")
def _(spark, d):
    p = probes(spark, d).withColumnRenamed("ticker", "entity")
    dates = p.select("entity", F.col("as_of").alias("feature_available_date")).unionByName(p.select("entity", F.date_add("as_of", 1).alias("feature_available_date"))).distinct()
    return pa.attach_market(dates, returns(spark, d)).select("entity", "feature_available_date", "return_3m", "return_12m")


@R.add("target_primary", f"""{FACTS_SQL}, {QP_SQL}, g as (select a.*, round((a.revenue - c.revenue) / nullif(abs(c.revenue), 0), 6) as y from qp a left join qp c on a.entity = c.entity and c.qidx = a.qidx - 4)
select a.entity, a.fiscal_period, n.fiscal_period as target_period, n.y as target_value, n.feature_available_date as target_available_date from g a left join g n on n.entity = a.entity and n.qidx = a.qidx + 1""")
def _(spark, d):
    return pa.target_primary(pa.qoq_yoy(quarter_panel(spark, d), ["revenue"]), "revenue_yoy").select("entity", "fiscal_period", "target_period", "target_value", "target_available_date")


@R.add("target_secondary", f"""{FACTS_SQL}, {SKELETON_SQL}, an as (select entity, fiscal_year as fy, value as v, source_available_date as dt from facts where metric = 'revenue' and fp = 'FY')
select s.entity, s.fiscal_period, 'FY' || (qidx // 4 + 1) as annual_target_period, round((n.v - c.v) / nullif(c.v, 0), 6) as annual_target, n.dt as annual_target_date from skel s left join an c on c.entity = s.entity and c.fy = qidx // 4 left join an n on n.entity = s.entity and n.fy = qidx // 4 + 1""")
def _(spark, d):
    f = facts(spark, d)
    return pa.target_secondary(pa.skeleton(f), f).select("entity", "fiscal_period", "annual_target_period", "annual_target", "annual_target_date")


@R.add("target_tertiary", f"""{PRICES_SQL}, {PROBES_SQL}, legs as (select p.ticker, p.as_of, a.adj_close as a0, b.adj_close as a1, c.adj_close as b0, e.adj_close as b1 from probes p
asof left join prices a on a.ticker = p.ticker and p.as_of >= a.date asof left join prices b on b.ticker = p.ticker and p.as_of + 365 <= b.date
asof left join (select * from prices where ticker = 'ALL') c on p.as_of >= c.date asof left join (select * from prices where ticker = 'ALL') e on p.as_of + 365 <= e.date)
select ticker as entity, as_of as feature_available_date, cast(nullif(a1, 0) / nullif(a0, 0) > nullif(b1, 0) / nullif(b0, 0) as integer) as beats_benchmark from legs""")
def _(spark, d):
    p = probes(spark, d).select(F.col("ticker").alias("entity"), F.col("as_of").alias("feature_available_date"))
    return pa.target_tertiary(p, prices(spark, d), benchmark=BROAD)


PANEL_SQL = f"""{RATIOS_SQL}, {SKELETON_SQL}, {QUARTER_SQL}, wq as (select entity, fiscal_period, qidx, {', '.join(f"max(case metric when '{m}' then value end) as {m}" for m in pa.FLOW_NAMES)}, bool_or(imputed) as imputed from flows group by all),
b as (select s.entity, s.fiscal_period, s.qidx, s.feature_available_date, {', '.join(pa.FLOW_NAMES)}, imputed from skel s left join wq using (entity, fiscal_period)),
g as (select a.*, {', '.join(f"round((a.{n} - {t}.{n}) / nullif(abs({t}.{n}), 0), 6) as {n}_{tag}" for t, tag in (('x', 'qoq'), ('c', 'yoy')) for n in ('revenue', 'operating_income'))},
  round(a.r_and_d / nullif(a.revenue, 0), 6) as rd_intensity, round(a.capex / nullif(a.revenue, 0), 6) as capex_intensity, round((a.operating_income - c.operating_income) / nullif(a.revenue - c.revenue, 0), 6) as operating_leverage
  from b a left join b x on x.entity = a.entity and x.qidx = a.qidx - 1 left join b c on c.entity = a.entity and c.qidx = a.qidx - 4),
an as (select entity, fiscal_year as fy, value as v, source_available_date as dt from facts where metric = 'revenue' and fp = 'FY'),
panel as (select a.entity, a.fiscal_period, a.qidx, a.feature_available_date, a.revenue, a.revenue_yoy, a.operating_income_qoq, a.rd_intensity, a.capex_intensity, a.operating_leverage, m.gross_margin, n.fiscal_period as target_period, n.revenue_yoy as target_value, n.feature_available_date as target_available_date,
  round((an2.v - an1.v) / nullif(an1.v, 0), 6) as annual_target, coalesce(n.revenue_yoy is not null and a.feature_available_date >= n.feature_available_date, false) as lookahead_violation
  from g a left join g n on n.entity = a.entity and n.qidx = a.qidx + 1 left join (select entity, fiscal_period, value as gross_margin from ratios where metric = 'gross_margin') m on m.entity = a.entity and m.fiscal_period = a.fiscal_period
  left join an an1 on an1.entity = a.entity and an1.fy = a.qidx // 4 left join an an2 on an2.entity = a.entity and an2.fy = a.qidx // 4 + 1)
"""
PANEL_COLUMNS = ["entity", "fiscal_period", "qidx", "feature_available_date", "revenue", "revenue_yoy", "operating_income_qoq", "rd_intensity", "capex_intensity", "operating_leverage", "gross_margin", "target_period", "target_value", "target_available_date", "annual_target", "lookahead_violation"]


def panel(spark, d):
    return pa.build_panel(metrics(spark, d))


@R.add("build_panel", f"{PANEL_SQL} select * from panel")
def _(spark, d):
    return panel(spark, d).select(*PANEL_COLUMNS)


@R.add("no_lookahead_panel", f"{PANEL_SQL} select entity, count(*) as rows_checked, count(*) filter (lookahead_violation) as violations from panel group by 1")
def _(spark, d):
    return panel(spark, d).groupBy("entity").agg(F.count("*").alias("rows_checked"), F.count_if("lookahead_violation").alias("violations"))
