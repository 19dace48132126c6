"""All registered queries outside the training-data subpackage, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import fact_queries, gate_queries, market_queries, text_queries, valuation_queries

PARTS = (fact_queries.R, market_queries.R, gate_queries.R, valuation_queries.R, text_queries.R)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for part in PARTS for n, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for part in PARTS for n, s in part.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_queries.flagship(spark, sf_dir)
