"""Column functions shared by the operators: null-safe arithmetic, period classes, fiscal-label algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b; null if either is null or b is 0."""
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def growth(now: Column | str, before: Column | str, absolute: bool = False) -> Column:
    """(now - before) / before, or by |before|; null if one is missing or before is 0."""
    before = col(before)
    return safe_div(col(now) - before, F.abs(before) if absolute else before)


def no_nan(c: Column | str) -> Column:
    """Missing values are null, never NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def duration_days(start: Column | str, end: Column | str) -> Column:
    return F.date_diff(col(end), col(start))


def period_type(start: Column | str, days: Column | str) -> Column:
    """instant without a start; annual 350..380, quarterly under 100, ytd 100..339 days; other."""
    days = col(days)
    return (
        F.when(col(start).isNull(), "instant")
        .when(days.between(350, 380), "annual")
        .when(days < 100, "quarterly")
        .when(days.between(100, 339), "ytd")
        .otherwise("other")
    )


def fiscal_year(label: Column | str) -> Column:
    """Year of FY2024 or FY2024-Q3, null for other strings."""
    return F.nullif(F.regexp_extract(col(label), r"^FY(\d{4})(?:-Q[1-4])?$", 1), F.lit("")).cast("int")


def fiscal_quarter(label: Column | str) -> Column:
    """Quarter of FY2024-Q3; null for annual labels and other strings."""
    return F.nullif(F.regexp_extract(col(label), r"^FY\d{4}-Q([1-4])$", 1), F.lit("")).cast("int")


def quarter_index(label: Column | str) -> Column:
    """fy * 4 + (q - 1); an annual label stands for its fourth quarter."""
    year = fiscal_year(label)
    return (year * 4 + F.coalesce(fiscal_quarter(label), F.lit(4)) - 1).cast("int")


def quarter_label(index: Column | str) -> Column:
    index = col(index)
    return F.concat(F.lit("FY"), F.floor(index / 4).cast("string"), F.lit("-Q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def next_quarter(label: Column | str) -> Column:
    return quarter_label(quarter_index(label) + 1)


def previous_quarter(label: Column | str, back: int = 1) -> Column:
    return quarter_label(quarter_index(label) - back)
