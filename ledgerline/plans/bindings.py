"""Projections of the given tables into the canonical tables, in Spark and, for the oracle, in SQL.

facts: a nation is an entity; a year or quarter of order dates is a fiscal period; figures are available some
weeks after a period's end. Flows accumulate within a year (Q1..Q3 as filed) and stand whole in the annual row, which
exists for complete years only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: name: (SQL over one order line, whether it accumulates within the year, unit)
METRICS = {
    "revenue": ("l_extendedprice * (1 - l_discount)", True, "USD"),
    "gross_profit": ("case when l_returnflag <> 'R' then l_extendedprice * (1 - l_discount) else 0 end", True, "USD"),
    "operating_income": ("case when l_linestatus = 'F' then l_extendedprice * (1 - l_discount) else -l_extendedprice * l_discount end", True, "USD"),
    "net_income": ("l_extendedprice * l_tax", True, "USD"),
    "operating_cash_flow": ("case when l_returnflag = 'N' then l_extendedprice else 0 end", True, "USD"),
    "capex": ("l_extendedprice * l_discount", True, "USD"),
    "r_and_d": ("case when l_linenumber <= 3 then l_extendedprice * l_discount else 0 end", True, "USD"),
    "sga": ("case when l_linenumber <= 3 then l_extendedprice * l_tax else 0 end", True, "USD"),
    "diluted_eps": ("case when l_linenumber = 1 then l_tax else 0 end", True, "USD/shares"),
    "total_assets": ("l_extendedprice", False, "USD"),
    "shareholders_equity": ("case when l_quantity > 25 then l_extendedprice else 0 end", False, "USD"),
    "total_debt": ("case when l_quantity <= 10 then l_extendedprice else 0 end", False, "USD"),
    "cash_and_securities": ("case when l_quantity > 40 then l_extendedprice else 0 end", False, "USD"),
    "current_assets": ("case when l_linenumber <= 2 then l_extendedprice else 0 end", False, "USD"),
    "current_liabilities": ("case when l_linenumber = 1 then l_extendedprice else 0 end", False, "USD"),
    "diluted_shares": ("l_quantity", False, "shares"),
}
FLOWS = [m for m, (_, flow, _) in METRICS.items() if flow]
INSTANTS = [m for m, (_, flow, _) in METRICS.items() if not flow]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with entity, fy and q. Customers and nations are joined before lines, so that the largest table moves once."""
    owner = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    orders = table(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, sf_dir, "lineitem").join(
        orders.select("o_orderkey", "entity", F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("q")), F.col("l_orderkey") == F.col("o_orderkey")
    )


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity and quarter with the quarter's own figures."""
    sums = [F.round(F.sum(F.expr(e).cast("double")), 4).alias(m) for m, (e, _, _) in METRICS.items()]
    return lines(spark, sf_dir).groupBy("entity", "fy", "q").agg(*sums, F.date_add(F.last_day(F.make_date("fy", F.col("q") * 3, F.lit(1))), (F.count("*") % 40 + 20).cast("int")).alias("filed"))


def _long(df: DataFrame, label: Column, fp: Column) -> DataFrame:
    """Metric rows of a wide table with fy, start, end and filed."""
    unit = F.element_at(F.create_map(*[F.lit(x) for m, (_, _, u) in METRICS.items() for x in (m, u)]), F.col("metric"))
    rows = df.withColumn("fiscal_period", label).withColumn("fp", fp)
    flow = F.col("metric").isin(FLOWS)
    return rows.unpivot(["entity", "fy", "fiscal_period", "fp", "start", "end", "filed"], list(METRICS), "metric", "value").select(
        "entity", "metric", F.col("fy").alias("fiscal_year"), "fp", "fiscal_period", "value", unit.alias("unit"),
        F.when(F.col("fp") == "FY", "10-K").otherwise("10-Q").alias("form_type"),
        F.when(flow, F.col("start")).alias("period_start"), F.col("end").alias("period_end"),
        F.col("filed").alias("filing_date"), F.col("filed").alias("source_available_date"),
        F.concat_ws("-", "entity", "fiscal_period").alias("accession"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("entity", "fy").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    q = quarters(spark, sf_dir)
    ytd = q.select(
        "entity", "fy", "q", *(F.round(F.sum(m).over(w), 4).alias(m) for m in FLOWS), *INSTANTS,
        F.make_date("fy", F.lit(1), F.lit(1)).alias("start"), F.last_day(F.make_date("fy", F.col("q") * 3, F.lit(1))).alias("end"),
        F.max("filed").over(w).alias("filed"), F.count("*").over(w).alias("n"),
    )
    year, part = F.concat(F.lit("FY"), F.col("fy").cast("string")), F.concat(F.lit("Q"), F.col("q").cast("string"))
    annual = F.col("q") == 4
    return _long(ytd.where("q < 4 or n = 4"), F.when(annual, year).otherwise(F.concat_ws("-", year, part)), F.when(annual, "FY").otherwise(part))


def _sums(f) -> str:
    return ", ".join(f(m, *spec) for m, spec in METRICS.items())


FACTS_SQL = f"""
with lines as (
  select l.*, n_name as entity, year(o_orderdate) as fy, quarter(o_orderdate) as q
  from lineitem l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
), quarters as (
  select entity, cast(fy as integer) as fy, cast(q as integer) as q, {_sums(lambda m, e, flow, u: f"round(sum(cast({e} as double)), 4) as {m}")}, last_day(make_date(cast(fy as integer), cast(q * 3 as integer), 1)) + cast(20 + count(*) % 40 as integer) as filed
  from lines group by lines.entity, lines.fy, lines.q
), ytd as (
  select entity, fy, q, {_sums(lambda m, e, flow, u: f"round(sum({m}) over w, 4) as {m}" if flow else m)}, make_date(fy, 1, 1) as s, last_day(make_date(fy, q * 3, 1)) as e,
         max(filed) over w as filed, count(*) over w as n
  from quarters window w as (partition by entity, fy order by q rows between unbounded preceding and current row)
), kept as (
  select * exclude (n), case when q = 4 then 'FY' || fy else 'FY' || fy || '-Q' || q end as fiscal_period, case when q = 4 then 'FY' else 'Q' || q end as fp from ytd where q < 4 or n = 4
), facts as (
  select entity, metric, fy as fiscal_year, fp, fiscal_period, value,
         case metric when 'diluted_eps' then 'USD/shares' when 'diluted_shares' then 'shares' else 'USD' end as unit,
         case when fp = 'FY' then '10-K' else '10-Q' end as form_type,
         case when metric in ({", ".join(f"'{m}'" for m in FLOWS)}) then s end as period_start, e as period_end, filed as filing_date, filed as source_available_date,
         entity || '-' || fiscal_period as accession
  from (unpivot kept on {", ".join(METRICS)} into name metric value value)
)
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average unit prices of each supplier region (the tickers), and of all regions as the index ALL."""
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sold = table(spark, sf_dir, "lineitem").join(place.select("s_suppkey", F.col("r_name").alias("ticker")), F.col("l_suppkey") == F.col("s_suppkey"))
    unit = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(20,8)")  # summed exactly, in whatever order
    # a day's tickers are summed once; the index is a sum of those sums
    daily = sold.groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(F.sum(unit).alias("s"), F.count("*").alias("n"))
    every = daily.select(F.explode(F.array("ticker", F.lit("ALL"))).alias("ticker"), "date", "s", "n").groupBy("ticker", "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return every.select("date", "ticker", (F.floor(F.col("s").cast("double") / F.col("n") * 10000) / 10000.0).alias("adj_close"), F.col("date").alias("source_available_date"))


PRICES_SQL = """
with sold as (
  select r_name as ticker, cast(l_shipdate as date) as date, cast(l_extendedprice / l_quantity as decimal(20, 8)) as unit
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), daily as (select ticker, date, sum(unit) as s, count(*) as n from sold group by all),
prices as (
  select date, ticker, floor(cast(s as double) / n * 10000) / 10000.0 as adj_close, date as source_available_date
  from (select * from daily union all select 'ALL', date, sum(s), sum(n) from daily group by date) as t(ticker, date, s, n)
)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filing sections: the source is the entity, the language the section, the id the order of filing."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("entity"), F.col("lang").alias("section"), "doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")).alias("filing_date"), "text",
    )


SECTIONS_SQL = """
with sections as (
  select source as entity, lang as section, doc_id, 'D' || doc_id as accession, cast(date '2000-01-01' + cast(doc_id as integer) as date) as filing_date, text from documents
)
"""


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as listed companies: balances of their suppliers and customers as size, debt and earnings."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.round(F.sum("s_acctbal"), 2).alias("revenue"), F.round(F.sum(F.when(F.col("s_acctbal") < 4000, F.col("s_acctbal") - 1500)), 2).alias("ebitda"),
        F.round(F.sum(F.when(F.col("s_acctbal") < 2500, F.col("s_acctbal") - 1000)), 2).alias("net_income"), F.max("s_suppkey").alias("last"),
    )
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("market_cap"), F.round(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))), 2).alias("total_debt"),
        F.round(F.sum(F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") * 3)), 2).alias("total_cash"),
    )
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == s["k"], "left").join(c, F.col("n_nationkey") == c["k"], "left").select(
        F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("region"), "market_cap", "total_debt", "total_cash", "revenue", "ebitda", "net_income",
        F.round(F.col("net_income") * 2, 2).alias("free_cash_flow"), F.date_sub(F.lit("2001-12-31").cast("date"), F.pmod(F.col("last"), F.lit(180)).cast("int")).alias("source_date"),
    )


PEERS_SQL = """
with s as (
  select s_nationkey as k, round(sum(s_acctbal), 2) as revenue, round(sum(case when s_acctbal < 4000 then s_acctbal - 1500 end), 2) as ebitda,
         round(sum(case when s_acctbal < 2500 then s_acctbal - 1000 end), 2) as net_income, max(s_suppkey) as last from supplier group by 1
), c as (
  select c_nationkey as k, round(sum(greatest(c_acctbal, 0.0)), 2) as market_cap, round(sum(case when c_mktsegment = 'BUILDING' then c_acctbal end), 2) as total_debt,
         round(sum(case when c_mktsegment = 'MACHINERY' then c_acctbal * 3 end), 2) as total_cash from customer group by 1
), peers as (
  select n_name as ticker, n_regionkey as region, market_cap, total_debt, total_cash, revenue, ebitda, net_income, round(net_income * 2, 2) as free_cash_flow,
         cast(date '2001-12-31' - cast(last % 180 as integer) as date) as source_date
  from nation left join s on n_nationkey = s.k left join c on n_nationkey = c.k
)
"""
