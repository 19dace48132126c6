"""Sources and sinks: nested filings JSON, prices, peers, documents, logs and published values as canonical tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import col
from ledgerline.functions.workers import shared_folder
from ledgerline.operators.valuation import stale

ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS_SCHEMA = f"cik bigint, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<{ENTRY}>>>>>"
COLUMNS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
BLOCK = ", ".join(f"{c} array<string>" for c in COLUMNS)
FILINGS_SCHEMA = f"cik string, name string, tickers array<string>, filings struct<recent: struct<{BLOCK.replace(' array', ': array')}>, files: array<struct<name: string>>>"
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")


def facts_from_json(raw: DataFrame, *, json: str = "value", entity: str = "entity") -> DataFrame:
    """One row for each reported fact of documents of nested maps: taxonomy, concept, unit, entries. Bad JSON gives none."""
    doc = raw.select(F.from_json(F.col(json), FACTS_SCHEMA).alias("d"))
    by_taxonomy = doc.select(F.col("d.cik").cast("string").alias(entity), F.explode("d.facts").alias("taxonomy", "concepts"))
    by_concept = by_taxonomy.select(entity, "taxonomy", F.explode("concepts").alias("concept", "c"))
    by_unit = by_concept.select(entity, "taxonomy", "concept", F.explode("c.units").alias("unit", "entries"))
    rows = by_unit.select(entity, "taxonomy", "concept", "unit", F.inline("entries"))
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return rows.withColumns({"start": day("start"), "end": day("end"), "filed": day("filed")}).withColumn("source_available_date", F.col("filed"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return facts_from_json(spark.read.text(path, wholetext=True))


def filings_from_json(raw: DataFrame, pages: DataFrame | None = None, *, json: str = "value", path: str = "path", report_date: str, first_fy: int, last_fy: int, entity: str = "entity") -> DataFrame:
    """Parallel arrays to rows; allowed forms, known by the report date, in the window of fiscal years (kept if the period is no date).

    pages (path, json): older pages, whose arrays stand at the top. A page belongs to the company whose document names its
    file; a page that none names, and a named file that is not there, give no rows.
    """
    d = raw.select(F.from_json(F.col(json), FILINGS_SCHEMA).alias("d")).select(F.col("d.cik").alias(entity), "d.filings.*")
    blocks = d.select(entity, F.col("recent").alias("block"))
    if pages is not None:
        named = d.select(entity, F.explode("files.name").alias("__name")).where("__name is not null").distinct()
        own = pages.select(F.substring_index(path, "/", -1).alias("__name"), F.from_json(F.col(json), BLOCK).alias("block"))
        blocks = blocks.unionByName(named.join(own, "__name").select(entity, "block"))
    rows = blocks.select(entity, F.inline(F.arrays_zip(*(F.col(f"block.{c}").alias(c) for c in COLUMNS))))
    out = rows.select(
        entity, F.col("accessionNumber").alias("accession"), F.col("form").alias("form_type"), F.try_to_date("filingDate", "yyyy-MM-dd").alias("filing_date"), F.try_to_date("reportDate", "yyyy-MM-dd").alias("report_period"),
        F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col(entity), F.replace("accessionNumber", F.lit("-"), F.lit("")), "primaryDocument").alias("url"),
    ).withColumn("source_available_date", F.col("filing_date"))
    fy = F.year("report_period")
    inside = F.coalesce(fy.between(first_fy, last_fy) | (fy + 1).between(first_fy, last_fy), F.lit(True))
    return out.where(F.col("form_type").isin(*FORMS) & (F.col("source_available_date") <= F.lit(report_date).cast("date")) & inside)


def read_filings(spark: SparkSession, folder: str, *, report_date: str, first_fy: int, last_fy: int) -> DataFrame:
    """Filings of a folder of submissions: documents by company, CIK<number>.json, and the older pages that they name."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    page = F.substring_index("path", "/", -1).contains("-submissions-")
    return filings_from_json(files.where(~page), files.where(page), report_date=report_date, first_fy=first_fy, last_fy=last_fy)


def prices_table(raw: DataFrame, *, price_date: str) -> DataFrame:
    """Canonical prices up to a date; the price column may be adj_close or adjusted_close."""
    price = F.coalesce(*(F.col(c).cast("double") for c in ("adj_close", "adjusted_close") if c in raw.columns))
    day = F.to_date("date")
    rows = raw.select(day.alias("date"), "ticker", price.alias("adj_close"), F.coalesce(F.to_date("source_available_date"), day).alias("source_available_date"))
    return rows.where(F.col("date") <= F.lit(price_date).cast("date"))


def read_prices(spark: SparkSession, path: str, *, price_date: str) -> DataFrame:
    return prices_table(spark.read.csv(path, header=True), price_date=price_date)


def peers_table(raw: DataFrame, *, report_date: str, max_age_days: int = 90) -> DataFrame:
    """Peer snapshots with a staleness flag; older spellings of the columns are taken too."""
    either = lambda *names: F.coalesce(*(F.col(n) for n in names if n in raw.columns))
    day = F.try_to_date(F.col("source_date").cast("string"), "yyyy-MM-dd")
    return raw.select(
        "ticker", "market_cap", "total_debt", either("cash_and_securities", "total_cash").alias("total_cash"), "revenue", "ebitda", "net_income", either("free_cash_flow", "fcf").alias("free_cash_flow"),
        day.alias("source_date"), stale(day, report_date, max_age_days).alias("stale_ev"),
    )


def filing_docs(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """Filing mark-up with its metadata, by accession."""
    return documents.join(filings.select("accession", "form_type", "filing_date", "source_available_date"), "accession")


PROVENANCE = "step string, timestamp timestamp, http_status int, error string, rows bigint, cached boolean, path string, ticker string, source_date date, staleness_days int"


def provenance_from_lines(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Log events of JSON lines; malformed lines are left out."""
    schema = f"{PROVENANCE}, _bad string"
    return lines.select(F.from_json(F.col(line), schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).select("d.*").where(F.col("_bad").isNull() & F.col("step").isNotNull()).drop("_bad")


def reference_values(raw: DataFrame, *, json: str = "value", source: Column | str = "published") -> DataFrame:
    """(metric, fiscal_year, value, source) of maps FY -> metric -> value, flat or with nested metrics.<name>.value; keys from _ are notes."""
    named = F.lit(source) if isinstance(source, str) else source
    d = raw.select(F.from_json(F.col(json), "values map<string,string>").alias("d"), named.alias("source")).select("source", F.explode("d.values").alias("fy", "body"))
    flat = d.select("source", "fy", F.explode(F.from_json("body", "map<string,string>")).alias("metric", "v")).where(~F.col("metric").startswith("_") & (F.col("metric") != "metrics"))
    nested = d.select("source", "fy", F.explode(F.from_json("body", "metrics map<string,struct<value:double>>")["metrics"]).alias("metric", "v")).select("source", "fy", "metric", F.col("v.value").cast("string").alias("v"))
    year = F.expr("try_cast(substring(fy, 3) as int)")
    return flat.unionByName(nested).select("metric", year.alias("fiscal_year"), F.expr("try_cast(v as double)").alias("value"), "source").where("value is not null and fiscal_year is not null")


def manual_overrides(raw: DataFrame, *, json: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, metric, fiscal_year, manual_value, status) of a map with keys "metric,year"."""
    d = raw.select(*keep, F.explode(F.from_json(F.col(json), "map<string,struct<manual_value:double,status:string>>")).alias("k", "v"))
    part = F.split("k", ",")
    return d.select(*keep, part[0].alias("metric"), F.expr("try_cast(trim(element_at(split(k, ','), 2)) as int)").alias("fiscal_year"), "v.manual_value", "v.status")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Overwrites a Parquet table."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, name: str, *, by: Sequence[str], sort: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """df as a table of a new name in the shared folder, in buckets of `by`, each sorted by `by` and `sort`; the table read back.

    What joins or groups by these columns, and by others besides, reads it without a shuffle; the rows are shuffled once,
    here, and every bucket is one file. Tables that are to be joined need the same number of buckets, by default that of
    the session's shuffles.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"ledgerline_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *(F.col(f"`{c}`") for c in by))
    dealt.write.bucketBy(n, *by).sortBy(*by, *sort).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def analyst_latest(snapshots: DataFrame, *, keys: tuple[str, ...] = ("ticker", "period")) -> DataFrame:
    """The latest snapshot of each ticker and period."""
    rest = [c for c in snapshots.columns if c not in keys]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), "retrieval_date").alias("s")).select(*keys, "s.*")


def growth_estimates(latest: DataFrame, estimate: Column | str = "revenue_estimate") -> DataFrame:
    """Growth from the current to the next year's estimate."""
    e = col(estimate)
    pick = lambda p: F.max(F.when(F.col("period") == p, e))
    g = latest.groupBy("ticker").agg(pick("0y").alias("now"), pick("+1y").alias("next"))
    return g.select("ticker", F.round(F.try_divide(F.col("next") - F.col("now"), F.nullif("now", F.lit(0.0))), 6).alias("growth_next"))
