"""Queries of the segment and gate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import gates as ga
from ledgerline.operators import metrics as mo
from ledgerline.operators import segments as se
from ledgerline.operators import valuation as va
from ledgerline.plans.bindings import FACTS_SQL, PEERS_SQL, PRICES_SQL, facts, lines, peers, prices, table
from ledgerline.plans.fact_queries import RATIOS_SQL, metrics
from ledgerline.plans.registered import Registry
from ledgerline.sources.readers import provenance_from_lines

R = Registry()

#: Segments: market labels of the parts' types and brands.
SEGMENT_LABELS = ["Data Center ", "GAMING", "gpu", "Tegra Processor Business", "OEM & Other", "automotive parts", "Widgets", "Compute & Networking", "pro", "All Other lines"]
LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in SEGMENT_LABELS) + "]"
SEGMENTS_SQL = f"""segs as (
  select entity, fy as fiscal_year, 'FY' || fy as fiscal_period, {LABEL_SQL}[1 + cast(l_partkey % 10 as integer)] as original_label, round(sum(case when l_partkey % 97 = 0 then null else l_extendedprice * (1 - l_discount) end), 4) as value
  from lines group by all)"""
MAP_SQL = "lmap(key, category, place) as (values " + ", ".join(f"('{k}', '{c}', {i})" for i, (k, c) in enumerate(se.LABELS.items())) + ")"
MAPPED_SQL = f"""{SEGMENTS_SQL}, {MAP_SQL}, names as (select distinct original_label, lower(trim(original_label)) as c from segs),
best as (select original_label, c, arg_min(category, (case when c = key then 0 else 1000 end) + place) as category, arg_min(key, (case when c = key then 0 else 1000 end) + place) as key from names join lmap on c = key or contains(c, key) or (contains(key, c) and c <> '') group by all),
mapped as (select segs.*, coalesce(category, 'other') as normalized_category, case when key = c then '' when key is not null then 'partial match: ' || key else 'unmapped label' end as mapping_notes, case when fiscal_year % 3 = 0 then 'table_extraction' else 'xbrl_dimension' end as extraction_method from segs left join best using (original_label) where value is not null)"""


def segments(spark, d):
    label = F.element_at(F.lit(SEGMENT_LABELS), (F.col("l_partkey") % 10 + 1).cast("int"))
    value = F.round(F.sum(F.expr("case when l_partkey % 97 = 0 then null else l_extendedprice * (1 - l_discount) end")), 4)
    return lines(spark, d).groupBy("entity", F.col("fy").alias("fiscal_year"), label.alias("original_label")).agg(value.alias("value")).withColumn("fiscal_period", F.concat(F.lit("FY"), "fiscal_year"))


def mapped(spark, d):
    s = se.segments_from_facts(segments(spark, d), se.label_table(spark))
    return s.withColumn("extraction_method", F.expr("case when fiscal_year % 3 = 0 then 'table_extraction' else extraction_method end"))


@R.add("label_normalise", f"{FACTS_SQL}, {MAPPED_SQL} select distinct original_label, normalized_category, mapping_notes from mapped")
def _(spark, d):
    return se.label_normalise(segments(spark, d), se.label_table(spark)).select("original_label", "normalized_category", "mapping_notes").distinct()


@R.add("segments_from_facts", f"{FACTS_SQL}, {MAPPED_SQL} select entity, fiscal_year, original_label, value, normalized_category, 'xbrl_dimension' as extraction_method from mapped")
def _(spark, d):
    return se.segments_from_facts(segments(spark, d), se.label_table(spark)).select("entity", "fiscal_year", "original_label", "value", "normalized_category", "extraction_method")


@R.add("segments_from_text", f"""{FACTS_SQL}, {MAP_SQL}, {SEGMENTS_SQL} select entity, fiscal_year, fiscal_period, 'Gaming' as original_label, 'gaming' as normalized_category, cast(1000 + fiscal_year as double) as value from segs where original_label = 'GAMING' and fiscal_year % 2 = 1
union all select entity, fiscal_year, fiscal_period, 'Data Center', 'data_center', cast(length(entity) as double) * 100000 from segs where original_label = 'GAMING' and fiscal_year % 2 = 1""")
def _(spark, d):
    s = segments(spark, d).where("original_label = 'GAMING'")
    html = F.format_string("<table><tr><td>Gaming</td><td>$</td><td>%,d</td></tr><tr><td>Data Center</td><td>%,d</td></tr><tr><td>Weather</td><td>12</td></tr></table>", (F.col("fiscal_year") + 1000).cast("int"), (F.length("entity") * 100000).cast("int"))
    docs = s.select("entity", "fiscal_year", "fiscal_period", html.alias("text"))
    out = se.segments_from_text(docs, s.where("fiscal_year % 2 = 0"), se.label_table(spark))
    return out.select("entity", "fiscal_year", "fiscal_period", "original_label", "normalized_category", "value")


@R.add("segment_extraction_log", f"{FACTS_SQL}, {MAPPED_SQL} select fiscal_year, fiscal_period, extraction_method, count(*) as n, coalesce(list_sort(list_distinct(list(case when normalized_category = 'other' then original_label end))), []) as unmapped from mapped group by all")
def _(spark, d):
    return se.extraction_log(mapped(spark, d))


@R.add("segment_quality", f"""{FACTS_SQL}, {MAPPED_SQL}, rev as (select entity, fiscal_year, value * case when fiscal_year % 2 = 0 then 1.5 else 1 end as reported from facts where metric = 'revenue' and fp = 'FY'),
s as (select entity, fiscal_year, sum(value) as s, bool_and(normalized_category in ('other', 'unclassified')) as vague from mapped group by all)
select entity, not bool_and(vague) as renderable, coalesce(list_sort(list(fiscal_year) filter (abs((s - reported) / nullif(reported, 0)) > 0.05)), []) as warnings from s left join rev using (entity, fiscal_year) group by 1""")
def _(spark, d):
    rev = facts(spark, d).where("metric = 'revenue' and fp = 'FY'").withColumn("value", F.expr("value * case when fiscal_year % 2 = 0 then 1.5 else 1 end"))
    return se.segment_quality(mapped(spark, d), rev)


@R.add("segment_footnotes", f"""{FACTS_SQL}, {MAPPED_SQL} select entity, bool_or(normalized_category in ('compute_and_networking', 'graphics', 'gpu', 'tegra')) as has_reportable, bool_or(normalized_category in ('data_center', 'gaming', 'professional_visualization', 'automotive', 'oem_and_other')) as has_market,
coalesce(list_sort(list_distinct(list(case when extraction_method = 'table_extraction' then fiscal_year end))), []) as fallback_years from mapped group by 1""")
def _(spark, d):
    return se.segment_footnotes(mapped(spark, d))


@R.add("segment_mix", f"{FACTS_SQL}, {MAPPED_SQL} select m.entity, m.fiscal_year, original_label, round(m.value / nullif(f.value, 0), 6) as share from mapped m join facts f on f.metric = 'revenue' and f.entity = m.entity and f.fiscal_year = m.fiscal_year and f.fiscal_period = m.fiscal_period")
def _(spark, d):
    return mo.segment_mix(mapped(spark, d), facts(spark, d)).select("entity", "fiscal_year", "original_label", "share")


#: Published values: the annual facts, some of them off by a share that grows with the year, some 0, some missing; and the parsed ones.
PUBLISHED_SQL = """annual as (select entity, metric, fiscal_year, value from facts where fp = 'FY'),
pub as (select entity, case metric when 'cash_and_securities' then 'cash' else metric end as metric, fiscal_year, round(case when fiscal_year = 1997 and metric = 'capex' then 0 else value * (1 + case when length(metric) % 3 = 0 then (fiscal_year - 1995) * 0.004 else 0 end) end, 4) as value
  from annual where not (fiscal_year = 1998 and metric = 'net_income')),
parsed as (select entity, metric, fiscal_year, value from annual where not (metric = 'total_debt' and entity > 'NATION_5') union all
  select a.entity, 'fcf', a.fiscal_year, round(a.value - b.value, 4) from annual a join annual b using (entity, fiscal_year) where a.metric = 'operating_cash_flow' and b.metric = 'capex')"""


def annual(spark, d):
    return facts(spark, d).where("fp = 'FY'").select("entity", "metric", "fiscal_year", "value")


def published(spark, d):
    v = F.expr("case when fiscal_year = 1997 and metric = 'capex' then 0 else value * (1 + case when length(metric) % 3 = 0 then (fiscal_year - 1995) * 0.004D else 0 end) end")
    a = annual(spark, d).where("not (fiscal_year = 1998 and metric = 'net_income')")
    return a.select("entity", F.expr("case metric when 'cash_and_securities' then 'cash' else metric end").alias("metric"), "fiscal_year", F.round(v, 4).alias("value"))


def parsed(spark, d):
    a = annual(spark, d)
    own = a.where("not (metric = 'total_debt' and entity > 'NATION_5')")
    ocf, capex = (a.where(F.col("metric") == m).select("entity", "fiscal_year", F.col("value").alias(m)) for m in ("operating_cash_flow", "capex"))
    fcf = ocf.join(capex, ["entity", "fiscal_year"]).select("entity", F.lit("fcf").alias("metric"), "fiscal_year", F.round(F.col("operating_cash_flow") - F.col("capex"), 4).alias("value"))
    return own.unionByName(fcf)


@R.add("compare_published", f"""{FACTS_SQL}, {PUBLISHED_SQL} select entity, metric, fiscal_year, p.value as published, q.value as value, round(abs(q.value - p.value) / nullif(abs(p.value), 0) * 100, 4) as difference_pct,
case when q.value is null then 'missing' when coalesce(abs(q.value - p.value) / nullif(abs(p.value), 0) * 100 <= 2, false) then 'pass' else 'fail' end as status from pub p left join parsed q using (entity, metric, fiscal_year)""")
def _(spark, d):
    return ga.compare_published(parsed(spark, d), published(spark, d))


CORE_SQL = "[" + ", ".join(f"'{m}'" for m in ga.CORE) + "]"
CRIT_SQL = "(" + ", ".join(f"'{m}'" for m in ga.CRITICAL) + ")"
ALIAS_SQL = "al(metric, alias, rank) as (values " + ", ".join(f"('{m}', '{a}', {k})" for m in ga.CORE for k, a in enumerate((m, *ga.ALIASES.get(m, ())))) + ")"
VALIDATED_SQL = f"""{FACTS_SQL}, {PUBLISHED_SQL}, {ALIAS_SQL},
own as (select entity, al.metric, fiscal_year, arg_min(value, rank) as parsed from parsed join al on parsed.metric = alias where value is not null group by all),
theirs as (select entity, al.metric, fiscal_year, arg_min(value, rank) as published from pub join al on pub.metric = alias where value is not null group by all),
dv as (select *, case when published = 0 then case when parsed = 0 then 0.0 else 100.0 end else abs(parsed - published) / abs(published) * 100 end as df from theirs left join own using (entity, metric, fiscal_year)),
validated as (select entity, metric, fiscal_year, published, parsed, case when parsed is not null then round(df, 4) end as difference_pct, case when parsed is null then 'missing' when df <= 1 then 'pass' else 'fail' end as status,
  case when parsed is not null and df <= 1 then 'none' when metric in {CRIT_SQL} then 'critical' else 'warning' end as severity, not (parsed is not null and df <= 1) and metric in {CRIT_SQL} as blocker from dv)"""


def validated(spark, d):
    return ga.gate_validate(parsed(spark, d), published(spark, d)).select("entity", "metric", "fiscal_year", "published", "parsed", "difference_pct", "status", "severity", "blocker")


@R.add("gate_validate", f"{VALIDATED_SQL} select * from validated")
def _(spark, d):
    return validated(spark, d)


@R.add("missing_critical", f"""{VALIDATED_SQL}, v as (select * from validated where not (metric = 'capex' and entity < 'NATION_3')), l as (select entity, max(fiscal_year) as fiscal_year from v group by 1)
select entity, fiscal_year, m as metric, 'missing' as status, 'critical' as severity, true as blocker from l, unnest([{', '.join(f"'{m}'" for m in ga.CRITICAL)}]) as t(m) where not exists (select 1 from v where (v.entity, v.fiscal_year, v.metric) = (l.entity, l.fiscal_year, m))""")
def _(spark, d):
    return ga.missing_critical(validated(spark, d).where("not (metric = 'capex' and entity < 'NATION_3')"))


@R.add("fy_selection_check", f"{FACTS_SQL} select entity, metric, fiscal_period, 'critical' as severity from facts where fp = 'FY' and period_start is not null and date_diff('day', period_start + case when fiscal_year % 2 = 0 then 60 else 0 end, period_end) not between 350 and 380")
def _(spark, d):
    from ledgerline.operators.facts import period_classify

    f = facts(spark, d).withColumn("period_start", F.expr("date_add(period_start, case when fiscal_year % 2 = 0 then 60 else 0 end)"))
    return ga.fy_selection_check(period_classify(f)).select("entity", "metric", "fiscal_period", "severity")


COVERAGE_SQL = f"""{VALIDATED_SQL}, cov as (select entity, round(count(*) filter (status = 'pass') * 100.0 / count(*), 4) as coverage_pct, count(*) filter (status = 'pass') * 100.0 / count(*) < 90 and not bool_and(status = 'pass' or metric not in {CRIT_SQL}) as blocked
  from (select *, dense_rank() over (partition by entity order by fiscal_year desc) as r from validated) where r <= 3 group by 1)"""


@R.add("coverage_gate", f"{COVERAGE_SQL} select * from cov")
def _(spark, d):
    return ga.coverage_gate(validated(spark, d))


STATUS_SQL = f"""{COVERAGE_SQL}, st as (select entity, case when bool_or(blocker) or any_value(blocked) then 'DATA_BLOCKED' when bool_or(status <> 'pass') then 'PASS_WITH_WARNINGS' else 'PASS' end as status from validated join cov using (entity) group by 1),
stat as (select *, status = 'DATA_BLOCKED' as blocks_recommendation from st)"""


def status(spark, d):
    v = validated(spark, d)
    return ga.quality_status(v, ga.coverage_gate(v))


@R.add("quality_status", f"{STATUS_SQL} select * from stat")
def _(spark, d):
    return status(spark, d)


@R.add("validation_summary", f"""{VALIDATED_SQL} select entity, count(*) filter (status = 'pass') as n_pass, count(*) filter (status = 'fail') as n_fail, count(*) filter (status = 'missing') as n_missing, round(count(*) filter (status = 'pass') * 100.0 / count(*), 4) as coverage_pct,
coalesce(string_agg(metric || ':' || fiscal_year || ':' || status, ';' order by metric || ':' || fiscal_year || ':' || status) filter (blocker), '') as blocking from validated group by 1""")
def _(spark, d):
    return ga.validation_summary(validated(spark, d))


@R.add("canonical_truth_table", f"""{FACTS_SQL}, {PUBLISHED_SQL}, man as (select entity, metric, fiscal_year, value + 1 as manual_value from annual where metric = 'sga' and fiscal_year >= 1998),
q as (select entity, metric, fiscal_year, case when metric = 'diluted_eps' then value * 4 else value end as value from parsed),
j as (select entity, metric, fiscal_year, p.value as published, q.value as parsed, manual_value, abs(q.value - p.value) / nullif(abs(p.value), 0) * 100 as df from pub p left join q using (entity, metric, fiscal_year) left join man using (entity, metric, fiscal_year)),
s as (select *, case when manual_value is not null then 'manual' when parsed is null then 'missing' when metric = 'diluted_eps' and df > 50 and fiscal_year <= 2024 then 'split_basis_mismatch' when df <= 2 then 'pass' else 'fail' end as status from j)
select entity, metric, fiscal_year, published, parsed, status, coalesce(manual_value, parsed) as value, round(df, 4) as difference_pct, status in ('missing', 'fail') and metric in {CRIT_SQL} as blocker from s""")
def _(spark, d):
    manual = annual(spark, d).where("metric = 'sga' and fiscal_year >= 1998").withColumn("manual_value", F.col("value") + 1)
    p = parsed(spark, d).withColumn("value", F.expr("case when metric = 'diluted_eps' then value * 4 else value end"))
    return ga.canonical_truth(published(spark, d), p, manual)


@R.add("as_of_filter", f"{FACTS_SQL} select fiscal_year, count(*) as n, max(source_available_date) as latest from facts where source_available_date <= date '1999-06-30' group by 1")
def _(spark, d):
    return ga.as_of(facts(spark, d), "1999-06-30").groupBy("fiscal_year").agg(F.count("*").alias("n"), F.max("source_available_date").alias("latest"))


@R.add("as_of_violations", f"""{FACTS_SQL}, {PRICES_SQL.strip()[5:]} select 'facts' as "table", count(*) filter (source_available_date > date '1999-06-30') as violations from facts union all select 'prices', count(*) filter (source_available_date > date '1999-06-30') from prices""")
def _(spark, d):
    return ga.as_of_violations({"facts": facts(spark, d), "prices": prices(spark, d)}, "1999-06-30")


COMPONENTS_SQL = f"""kinds(component, kind) as (values ('facts', 'blocking'), ('prices', 'blocking'), ('text', 'diagnostic')), comps as (select distinct entity, component, ['OK', 'BLOCKED', 'UNAVAILABLE', 'OK'][1 + (length(component) + cast(right(entity, 1) as integer)) % 4] as status from facts, kinds)"""


@R.add("eligibility", f"""{STATUS_SQL}, {COMPONENTS_SQL}, b as (select entity, coalesce(string_agg(component, ';' order by component) filter (kind = 'blocking' and status in ('BLOCKED', 'UNAVAILABLE')), '') as blockers from comps join kinds using (component) group by 1)
select entity, not (coalesce(blocks_recommendation, true) or blockers <> '') as eligible, blockers from b left join stat using (entity)""")
def _(spark, d):
    kinds = spark.createDataFrame([("facts", "blocking"), ("prices", "blocking"), ("text", "diagnostic")], "component string, kind string")
    comps = facts(spark, d).select("entity").distinct().withColumn("component", F.explode(F.lit(["facts", "prices", "text"])))
    comps = comps.withColumn("status", F.element_at(F.lit(["OK", "BLOCKED", "UNAVAILABLE", "OK"]), F.expr("1 + (length(component) + cast(right(entity, 1) as int)) % 4")))
    return ga.eligibility(comps, kinds, status(spark, d))


@R.add("valuation_input_check", f"{STATUS_SQL} select entity, case when bool_or(metric in {CRIT_SQL} and v.status in ('fail', 'missing') and severity = 'critical') or any_value(blocks_recommendation) then 'BLOCKED' else 'OK' end as status from validated v left join stat using (entity) group by 1")
def _(spark, d):
    return ga.valuation_input_check(validated(spark, d), status(spark, d))


def calendar_sql(first: str, last: str) -> str:
    """Federal holidays by their rules, from the days themselves."""
    return f"""days as (select cast(g as date) as day from generate_series(date '{first}', date '{last}', interval 1 day) as t(g)), fixed as (
  select case dayofweek(h) when 6 then h - 1 when 0 then h + 1 else h end as h from (select make_date(y, m, dd) as h from range(1994, 2004) t(y), (values (1, 1), (7, 4), (11, 11), (12, 25)) u(m, dd) where y >= 1994) ),
moving as (select day as h from (select day, month(day) as m, dayofweek(day) as w, (day(day) - 1) // 7 + 1 as nth, day(day + 7) < day(day) as final from days) where (w = 1 and ((m = 1 and nth = 3) or (m = 2 and nth = 3) or (m = 9 and nth = 1) or (m = 10 and nth = 2) or (m = 5 and final))) or (w = 4 and m = 11 and nth = 4)),
cal as (select day, case when dayofweek(day) in (0, 6) or day in (select h from fixed) or day in (select h from moving) then 0 else 1 end as works from days)"""


@R.add("trading_days_between", f"""with r as (select o_orderkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + cast(o_custkey % 60 as integer) - 5 as e from orders), {calendar_sql('1994-12-01', '2002-01-31')},
c as (select day, works, sum(works) over (order by day) as i from cal) select o_orderkey, s, e, cast(case when s >= e then 0 else greatest(b.i - (a.i - a.works) - 1, 0) end as integer) as trading_days from r left join c a on a.day = s left join c b on b.day = e""")
def _(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 60 - 5).cast("int")).alias("e"))
    return ga.trading_days_between(r, ga.business_calendar(spark, "1994-12-01", "2002-01-31"), "s", "e")


FRESH_SQL = f"""{PRICES_SQL}, cut as (select * from prices where date <= date '2001-06-29' - cast(length(ticker) as integer)), req(ticker) as (values ('AFRICA'), ('MIDDLE EAST'), ('ASIA'), ('GONE')), {calendar_sql('1994-12-01', '2001-07-31')},
c as (select day, works, sum(works) over (order by day) as i from cal), l as (select ticker, max(date) as last from cut group by 1),
ages as (select ticker, last, cast(case when last is null then 99999 when last >= date '2001-06-29' then 0 else greatest((select i from c where day = date '2001-06-29') - (a.i - a.works) - 1, 0) end as integer) as age from req left join l using (ticker) left join c a on a.day = last)"""


def fresh(spark, d):
    req = spark.createDataFrame([("AFRICA",), ("MIDDLE EAST",), ("ASIA",), ("GONE",)], "ticker string")
    cut = prices(spark, d).where("date <= date_sub(date'2001-06-29', length(ticker))")
    return ga.price_freshness(cut, req, ga.business_calendar(spark, "1994-12-01", "2001-07-31"), report_date="2001-06-29", subject="AFRICA")


@R.add("price_freshness", f"{FRESH_SQL} select ticker, last, age, age > 5 as stale from ages")
def _(spark, d):
    return fresh(spark, d)[0]


@R.add("price_freshness_status", f"{FRESH_SQL} select case when bool_and(age = 99999) then 'no_data' when bool_or(ticker = 'AFRICA' and age > 5) then 'blocked_subject_stale' when bool_or(age > 5) then 'partial' else 'fresh' end as status, count(*) filter (age > 5) as n_stale from ages")
def _(spark, d):
    return fresh(spark, d)[1]


TIERS_SQL = "tiers as (select n_name as ticker, ['core', 'semi', 'context'][1 + n_regionkey % 3] as tier from nation where n_nationkey % 7 <> 0)"


def tiers(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("ticker"), F.element_at(F.lit(["core", "semi", "context"]), F.col("n_regionkey") % 3 + 1).alias("tier"))


@R.add("peer_freshness", f"""{PEERS_SQL}, {TIERS_SQL}, r as (select *, coalesce(date_diff('day', source_date, date '2001-12-31') > 30, true) as stale from peers join tiers using (ticker))
select count(*) as n_peers, count(*) filter (stale) as n_stale, count(*) filter (stale and tier = 'core') as n_stale_core, case when count(*) filter (stale and tier = 'core') >= 3 then 'stale_blocked' when count(*) filter (stale) > 0 then 'partial' else 'fresh' end as status from r""")
def _(spark, d):
    return ga.peer_freshness(peers(spark, d), tiers(spark, d), report_date="2001-12-31")


@R.add("no_lookahead_matrix", """select o_orderkey, cast(o_orderdate as date) as feature_available_date, cast(l_shipdate as date) as prediction_date, cast(o_orderdate as date) + 90 as target_available_date from orders join lineitem on o_orderkey = l_orderkey
where l_linenumber = 1 and (cast(o_orderdate as date) > cast(l_shipdate as date) or cast(o_orderdate as date) + 90 <= cast(l_shipdate as date))""")
def _(spark, d):
    m = table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    m = m.select("o_orderkey", F.to_date("o_orderdate").alias("feature_available_date"), F.to_date("l_shipdate").alias("prediction_date"), F.date_add(F.to_date("o_orderdate"), 90).alias("target_available_date"))
    return ga.no_lookahead(m)


SECS_SQL = "secs as (select source as entity, 'A' || (doc_id // 2) as accession, case when doc_id % 2 = 0 then 'mda' else 'risk_factors' end as section_name, text, case when doc_id % 17 = 0 then 'missing' else 'success' end as parse_status, case when n_chars > 2000 then 'item' else 'title' end as extraction_tier from documents)"


def secs(spark, d):
    return table(spark, d, "documents").select(
        F.col("source").alias("entity"), F.concat(F.lit("A"), F.floor(F.col("doc_id") / 2)).alias("accession"), F.expr("case when doc_id % 2 = 0 then 'mda' else 'risk_factors' end").alias("section_name"), "text",
        F.expr("case when doc_id % 17 = 0 then 'missing' else 'success' end").alias("parse_status"), F.expr("case when n_chars > 2000 then 'item' else 'title' end").alias("extraction_tier"),
    )


@R.add("extraction_quality", f"""with {SECS_SQL}, f as (select entity, accession, coalesce(max(case when section_name = 'mda' then length(text) end), 0) < 500 or coalesce(max(case when section_name = 'risk_factors' then length(text) end), 0) < 300 as poor from secs group by all)
select entity, count(*) as n_filings, round(avg(cast(poor as integer)), 6) as poor_share, case when avg(cast(poor as integer)) > 0.5 then 'diagnostic_only' else 'usable' end as status from f group by 1""")
def _(spark, d):
    return ga.extraction_quality(secs(spark, d))


@R.add("section_coverage_report", f"with {SECS_SQL} select section_name, extraction_tier, case when parse_status = 'missing' then 'missing' when coalesce(length(text), 0) < 500 then 'short' else 'ok' end as warning, count(*) as n from secs group by all")
def _(spark, d):
    return ga.section_coverage(secs(spark, d))


@R.add("nlp_coverage", """with f as (select 'E' || (user_id % 20) as entity, 'A' || (user_id % 200) as accession, case when event_type = 'view' then 'similarity' else 'keyword_score' end as feature_type, case when event_type = 'error' then 0 else value - 30 end as value from events),
a as (select entity, round(count(distinct case when feature_type = 'keyword_score' and value > 0 then accession end) * 100.0 / count(distinct accession), 4) as keyword_pct, bool_or(feature_type = 'keyword_score' and value > 0) and count(*) filter (feature_type = 'similarity') >= 2 as usable from f group by 1)
select *, case when usable and keyword_pct >= 50 then 'active' when usable then 'appendix' else 'suppressed' end as status from a""")
def _(spark, d):
    f = table(spark, d, "events").select(F.expr("'E' || (user_id % 20)").alias("entity"), F.expr("'A' || (user_id % 200)").alias("accession"), F.expr("case when event_type = 'view' then 'similarity' else 'keyword_score' end").alias("feature_type"), F.expr("case when event_type = 'error' then 0 else value - 30 end").alias("value"))
    return ga.nlp_coverage(f)


LOG_SQL = """log as (select event_type as step, ts as timestamp, case when event_type = 'error' then 500 when event_id % 31 = 0 then 404 else 200 end as http_status, case when event_id % 53 = 0 then 'timeout' end as error,
  cast(floor(value) as bigint) as rows, cast(json_extract_string(props, '$.k') as integer) % 2 = 0 as cached, case when event_id % 19 = 0 then '/x/tests/y' else '/x/data' end as path from events)"""


def log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("step"), F.col("ts").alias("timestamp"), F.expr("case when event_type = 'error' then 500 when event_id % 31 = 0 then 404 else 200 end").alias("http_status"), F.expr("case when event_id % 53 = 0 then 'timeout' end").alias("error"),
        F.floor("value").alias("rows"), (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("cached"), F.expr("case when event_id % 19 = 0 then '/x/tests/y' else '/x/data' end").alias("path"),
    )


@R.add("provenance_summary", f"with {LOG_SQL} select step, count(*) as calls, cast(sum(rows) as bigint) as rows, round(avg(cast(cached as integer)), 6) as cache_hit_rate, count(*) filter (cached) as n_cached, count(*) filter (not cached) as n_live, count(*) filter (http_status >= 400 or error is not null) as failures from log where not contains(path, '/tests/') group by rollup (step)")
def _(spark, d):
    return ga.provenance_summary(log(spark, d))


@R.add("retrieval_failures", f"with {LOG_SQL} select step, count(*) filter (http_status >= 400 or error is not null) as failures, min(timestamp) filter (not cached) as first_live from log group by 1")
def _(spark, d):
    return ga.retrieval_failures(log(spark, d))


@R.add("peer_attribution", f"""{PEERS_SQL}, {TIERS_SQL}, r as (select ticker, coalesce(tier, 'context') as tier, source_date, cast(date_diff('day', source_date, date '2001-12-31') as integer) as age_days, concat_ws(';', case when coalesce(date_diff('day', source_date, date '2001-12-31') > 90, true) then 'stale' end, case when market_cap is null then 'no_market_cap' end, case when coalesce(net_income <= 0, true) then 'no_earnings' end) as reasons from peers left join tiers using (ticker))
select ticker, tier, source_date, age_days, reasons = '' as included, reasons from r""")
def _(spark, d):
    return ga.peer_attribution(peers(spark, d), tiers(spark, d), report_date="2001-12-31")


PEER_LOG_SQL = """peer_log as (select 'NATION_' || (user_id % 30) as ticker, cast(ts as date) as market_date, cast(floor(value) as integer) as age_days, cast(date '2001-12-31' - cast(floor(value) as integer) as date) as source_date
  from events where event_type in ('view', 'click') and event_id % 10 <> 0 and event_id % 7 <> 0)"""
FROM_LOG_SQL = """from_log as (select ticker, coalesce(tier, 'other') as tier, source_date, market_date, age_days, age_days <= 90 as included, case when age_days > 90 then 'stale' else '' end as reasons from peer_log left join tiers using (ticker))"""


def peer_log(spark, d):
    """Events as lines of a provenance log: some are cut off, some tell no peer."""
    e = table(spark, d, "events")
    days = F.floor("value").cast("int")
    line = F.to_json(F.struct(
        F.when(F.col("event_type").isin("view", "click"), "fetch_peer_financials").otherwise("other").alias("step"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("NATION_"), F.col("user_id") % 30)).alias("ticker"), F.date_sub(F.lit("2001-12-31").cast("date"), days).alias("source_date"), days.alias("staleness_days"),
    ))
    return provenance_from_lines(e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")))


@R.add("peer_attribution_from_log", f"{PEERS_SQL}, {TIERS_SQL}, {PEER_LOG_SQL}, {FROM_LOG_SQL} select * from from_log")
def _(spark, d):
    return ga.attribution_from_log(peer_log(spark, d), tiers(spark, d))


@R.add("peer_attribution_breakdown", f"{PEERS_SQL}, {TIERS_SQL}, {PEER_LOG_SQL}, {FROM_LOG_SQL} select tier, reasons as reason, count(distinct ticker) as peers from from_log where not included group by grouping sets ((tier, reasons), (reasons))")
def _(spark, d):
    return ga.attribution_breakdown(ga.attribution_from_log(peer_log(spark, d), tiers(spark, d)))


@R.add("doc_policy_scan", r"""with rules(rule, pattern) as (values ('short_token', '\bthe\b'), ('phrase', 'of the'), ('marks', '\*\*\*'), ('years', 'FY20[0-9]{2}')) select doc_id, rule, len(regexp_extract_all(text, pattern)) as hits from documents, rules where regexp_matches(text, pattern)""")
def _(spark, d):
    return ga.doc_policy_scan(table(spark, d, "documents"), {"short_token": "the", "phrase": "of the", "marks": "***"}, {"years": "FY20[0-9]{2}"})


@R.add("references_missing", r"""with a as (select conv_id, text from conversations where turn = 0), b as (select conv_id, text from conversations where turn = 1),
e as (select a.conv_id, list_sort(list_filter(list_distinct(regexp_extract_all(a.text, '\bth[a-z]+')), lambda x: not list_contains(coalesce(regexp_extract_all(b.text, '\bth[a-z]+'), []), x))) as missing from a left join b using (conv_id)) select * from e where len(missing) > 0""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return ga.references_missing(c.where("turn = 0"), c.where("turn = 1"), r"\bth[a-z]+", key="conv_id")


@R.add("gate_rollup", f"{VALIDATED_SQL} select entity, count(*) as checks_run, count(*) filter (status = 'pass') as passed, count(*) filter (status <> 'pass') as failed from validated group by 1")
def _(spark, d):
    from ledgerline.operators.marts import gate_rollup

    return gate_rollup(validated(spark, d).withColumn("ok", F.col("status") == "pass"))
