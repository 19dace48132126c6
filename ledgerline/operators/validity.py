"""When a value was the valid one: facts resolved once for every date, as intervals [known_from, known_to).

Which of several reports of a figure is the best can only change on a day on which one becomes known. A day's best report
that is better than all of the days before begins an interval and ends the one before. Rows are dealt once, by key. Any
date is then a filter, and a table with dates of its own a join by key and interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amendment_order(rank: str = "selection_rank") -> list[Column]:
    """The order of amendment_resolve(), the greatest first: least rank, latest filed, greatest accession."""
    return [-F.col(rank), F.col("filing_date"), F.col("accession")]


def dedup_order(form_rank: Column) -> list[Column]:
    """The order of fact_dedup(), the greatest first: form, latest end, latest filed, longest, value, accession."""
    return [-form_rank, F.col("period_end"), F.col("filing_date"), F.date_diff(F.col("period_end"), F.col("period_start")), F.col("value"), F.col("accession")]


def validity(facts: DataFrame, *, keys: Sequence[str], best: Sequence[Column], rank: str | None = None, available: str = "source_available_date") -> DataFrame:
    """The winning rows of each key with known_from and known_to (null: to this day), and `several` if a rank is given.

    best: what a row wins by, the greatest first, nulls last; of rows equal in all of it either may win. several: whether
    by then more than one row had the winner's rank. Rows without a date of availability are never known.
    """
    known = facts.where(F.col(available).isNotNull()).repartition(*keys)  # what follows needs no other shuffle
    along = Window.partitionBy(*keys).orderBy("known_from")
    second = F.lit(None).cast("date")
    if rank is not None:
        of_rank = Window.partitionBy(*keys, rank).orderBy(available).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        second = F.nth_value(available, 2).over(of_rank)
    names = [f"__o{i}" for i in range(len(best))]
    rows = known.select("*", F.col(available).alias("known_from"), second.alias("__second"), *(b.alias(o) for b, o in zip(best, names, strict=True)))
    of_day = Window.partitionBy(*keys, "known_from").orderBy(*(F.col(o).desc_nulls_last() for o in names))
    days = rows.withColumn("__nth", F.row_number().over(of_day)).where("__nth = 1")  # the best of those of a day
    order = F.struct(*names)
    before = F.max(order).over(along.rowsBetween(Window.unboundedPreceding, -1))
    won = days.withColumn("__before", before).where(F.col("__before").isNull() | (order > F.col("__before"))).withColumn("known_to", F.lead("known_from").over(along))
    rest = [F.col(f"`{c}`") for c in facts.columns if c not in keys]
    if rank is None:
        return won.select(*keys, *rest, "known_from", "known_to")
    # an interval within which a second row of the winner's rank becomes known is cut there
    cut = (F.col("__second") > F.col("known_from")) & (F.col("known_to").isNull() | (F.col("__second") < F.col("known_to")))
    part = lambda a, z, several: F.struct(F.col(a).alias("a"), F.col(z).alias("z"), several.alias("several"))
    whole = part("known_from", "known_to", F.coalesce(F.col("__second") <= F.col("known_from"), F.lit(False)))
    parts = F.when(cut, F.array(part("known_from", "__second", F.lit(False)), part("__second", "known_to", F.lit(True)))).otherwise(F.array(whole))
    return won.select(*keys, *rest, F.explode(parts).alias("__p")).select(*keys, *rest, F.col("__p.a").alias("known_from"), F.col("__p.z").alias("known_to"), "__p.several")


def _within(day: Column) -> Column:
    return (F.col("known_from") <= day) & (F.col("known_to").isNull() | (day < F.col("known_to")))


def at_date(valid: DataFrame, date: str) -> DataFrame:
    """The rows as they were resolved on a date."""
    return valid.where(_within(F.lit(date).cast("date"))).drop("known_from", "known_to")


def at_dates(valid: DataFrame, dates: Sequence[str], *, out: str = "as_of") -> DataFrame:
    """The rows of each of a list of dates, which `out` names: an interval is repeated for the dates that lie in it."""
    every = F.array(*(F.lit(d).cast("date") for d in sorted(set(dates)))).cast("array<date>")
    met = F.filter(every, _within)
    return valid.withColumn(out, F.explode(met)).drop("known_from", "known_to")


def join_as_of(rows: DataFrame, valid: DataFrame, *, keys: Sequence[str], at: str) -> DataFrame:
    """rows with the values that were valid for their keys on their own date; rows without one keep nulls.

    An equi-join by key, of which each row meets one interval.
    """
    right = valid.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in valid.columns if c not in keys and c not in rows.columns))
    on = [rows[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    inside = (F.col("known_from") <= rows[at]) & (F.col("known_to").isNull() | (rows[at] < F.col("known_to")))
    return rows.join(right, [*on, inside], "left").drop(*(f"__{k}" for k in keys), "known_from", "known_to")
