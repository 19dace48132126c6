"""Daily prices: filling, cleaning, and as-of returns, volatility and beta. As-of joins are one union and one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import safe_div
from ledgerline.functions.tables import small

SHORT, LONG = 90, 365


def locf(prices: DataFrame, *, max_gap_days: int = 3, ticker: str = "ticker") -> DataFrame:
    """Every calendar day from a ticker's first to its last; up to three missing days carry the last row on."""
    w = Window.partitionBy(ticker).orderBy("date")
    upto = F.least(F.date_add("date", max_gap_days), F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")))
    return prices.withColumn("__to", F.greatest(upto, F.col("date"))).withColumn("observed", F.col("date")).withColumn("date", F.explode(F.sequence("observed", "__to"))).drop("__to")


def price_clean(prices: DataFrame, *, ticker: str = "ticker", order: str = "seq") -> DataFrame:
    """One non-null price for each ticker and day, the last one taken in."""
    return prices.where("adj_close is not null").groupBy(ticker, "date").agg(F.max_by("adj_close", order).alias("adj_close"))


def index_alias_resolve(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """(index, ticker): the first alias for which there are prices."""
    there = prices.select("ticker").distinct().join(small(aliases), "ticker")
    return there.groupBy("index").agg(F.min_by("ticker", "rank").alias("ticker"))


def as_of_backward(probes: DataFrame, prices: DataFrame, *, at: str, key: str = "ticker", value: str = "adj_close", out: str = "price") -> DataFrame:
    """probes with the last value on or before their date. One shuffle by key; no join."""
    w = Window.partitionBy(key).orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    left = prices.where(F.col(value).isNotNull()).select(F.col(key), F.col("date").alias("__t"), F.lit(0).alias("__probe"), F.col(value).alias("__v"), F.lit(None).cast(probes_type(probes)).alias("__row"))
    right = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(prices.schema[value].dataType).alias("__v"), F.struct(*probes.columns).alias("__row"))
    both = left.unionByName(right).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__probe = 1").select("__row.*", out)


def as_of_forward(probes: DataFrame, prices: DataFrame, *, at: str, key: str = "ticker", value: str = "adj_close", out: str = "price") -> DataFrame:
    """probes with the first value on or after their date."""
    w = Window.partitionBy(key).orderBy(F.desc("__t"), "__probe").rowsBetween(Window.unboundedPreceding, 0)
    left = prices.where(F.col(value).isNotNull()).select(F.col(key), F.col("date").alias("__t"), F.lit(0).alias("__probe"), F.col(value).alias("__v"), F.lit(None).cast(probes_type(probes)).alias("__row"))
    right = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(prices.schema[value].dataType).alias("__v"), F.struct(*probes.columns).alias("__row"))
    both = left.unionByName(right).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__probe = 1").select("__row.*", out)


def probes_type(probes: DataFrame):
    return probes.select(F.struct(*probes.columns).alias("r")).schema["r"].dataType


def trailing_returns(probes: DataFrame, prices: DataFrame, spans: dict[str, int], *, at: str = "as_of", digits: int = 6) -> DataFrame:
    """(ticker, at) once each, and for each name in spans the last price on or before the date over the last one so many
    calendar days earlier, less 1; null if one is missing or 0. All dates asked for meet the prices in one window.
    """
    back = F.explode(F.lit(sorted({0, *spans.values()}))).alias("__back")
    asked = probes.select("ticker", at).distinct().select("ticker", at, back).withColumn("__then", F.date_sub(at, F.col("__back")))
    known = as_of_backward(asked, prices, at="__then", out="__v")
    now = F.max(F.when(F.col("__back") == 0, F.col("__v")))
    made = [F.round(safe_div(now, F.max(F.when(F.col("__back") == days, F.col("__v")))) - 1, digits).alias(name) for name, days in spans.items()]
    return known.groupBy("ticker", at).agg(*made)


def trailing_return(probes: DataFrame, prices: DataFrame, days: int, *, out: str, at: str = "as_of", digits: int = 6) -> DataFrame:
    """probes with the return over `days` calendar days, as trailing_returns()."""
    return probes.join(trailing_returns(probes, prices, {out: days}, at=at, digits=digits), ["ticker", at], "left")


def excess_returns(probes: DataFrame, prices: DataFrame, *, sector: str, broad: str, at: str = "as_of", digits: int = 6) -> DataFrame:
    """One row for each ticker and valid date: returns, and what they exceed those of two indices by."""
    p = probes.where(F.col(at).isNotNull()).select("ticker", at).distinct().withColumn("__asked", F.lit(True))
    indices = p.select(at).distinct().select(F.explode(F.lit([sector, broad])).alias("ticker"), at, F.lit(False).alias("__asked"))
    every = p.unionByName(indices).groupBy("ticker", at).agg(F.max("__asked").alias("__asked"))
    rows = trailing_returns(every, prices, {"return_3m": SHORT, "return_12m": LONG}, at=at, digits=digits).join(every, ["ticker", at])
    day = Window.partitionBy(at)
    of = lambda index, c: F.max(F.when(F.col("ticker") == index, F.col(c))).over(day)
    made = [F.round(F.col(f"return_{s}") - of(index, f"return_{s}"), digits).alias(f"excess_{name}_{s}") for name, index in (("sector", sector), ("broad", broad)) for s in ("3m", "12m")]
    return rows.select("ticker", at, "return_3m", "return_12m", *made, "__asked").where("__asked").drop("__asked")


def window_sums(probes: DataFrame, rows: DataFrame, sums: Sequence[str], days: int, *, at: str) -> DataFrame:
    """(ticker, at, n, sums): over the rows of (ticker, date, sums) with a date from `days` days before a probe up to it, how
    many there are, and the sums of all but the first, whose change from the row before lies outside.

    Running sums are made once for each ticker and taken at both ends of a window by one as-of pass: no row is copied for
    a probe, however many windows it lies in.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    so_far = F.struct(F.row_number().over(w).cast("long").alias("n"), *(F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("double")).alias(c) for c in sums))
    running = rows.select("ticker", "date", so_far.alias("here"))
    after_last = F.col("here").withField("n", F.col("here.n") + 1)
    known = running.select("ticker", "date", F.struct("here", F.coalesce(F.lead("here").over(w), after_last).alias("next")).alias("__v"))
    ends = F.explode(F.lit([0, days + 1])).alias("__back")
    asked = probes.select("ticker", at).distinct().select("ticker", at, ends).withColumn("__then", F.date_sub(at, F.col("__back")))
    found = as_of_backward(asked, known, at="__then", value="__v", out="__v")
    pick = lambda back: F.max(F.when(F.col("__back") == back, F.col("__v")))
    both = found.groupBy("ticker", at).agg(pick(0)["here"].alias("last"), pick(days + 1)["next"].alias("first"))
    # without a row before the window it begins with the first row of all
    n = F.greatest(F.col("last.n") - F.coalesce("first.n", F.lit(1)) + 1, F.lit(0))
    return both.select("ticker", at, n.alias("n"), *((F.col(f"last.{c}") - F.coalesce(f"first.{c}", F.lit(0.0))).alias(c) for c in sums))


def _spread(square: Column, total: Column, n: Column) -> Column:
    """The sum of squares about the mean; what rounding leaves of nothing is nothing."""
    about = square - total * total / n
    return F.when(about > 1e-12 * square, about).otherwise(0.0)


def volatility(probes: DataFrame, prices: DataFrame, *, days: int = 60, least_prices: int = 10, least_returns: int = 5, at: str = "as_of", out: str = "volatility_60d", digits: int = 6) -> DataFrame:
    """Sample deviation of log returns between prices of the window, times the root of 252."""
    before = F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))
    changes = prices.where("adj_close is not null").withColumn("r", F.ln(safe_div("adj_close", before)))
    rows = changes.select("ticker", "date", F.col("r").isNotNull().cast("double").alias("k"), "r", (F.col("r") * F.col("r")).alias("rr"))
    sums = window_sums(probes, rows, ["k", "r", "rr"], days, at=at)
    deviation = F.sqrt(_spread(F.col("rr"), F.col("r"), F.col("k")) / (F.col("k") - 1)) * F.sqrt(F.lit(252.0))
    enough = (F.col("n") >= least_prices) & (F.col("k") >= max(least_returns, 2))
    return probes.join(sums.select("ticker", at, F.when(enough, F.round(deviation, digits)).alias(out)), ["ticker", at], "left")


def beta(probes: DataFrame, prices: DataFrame, benchmark: str, *, days: int = 252, least: int = 30, at: str = "as_of", out: str = "beta_252d", digits: int = 6) -> DataFrame:
    """Covariance with the benchmark's returns over their variance, over the days that both have."""
    bench = prices.where(F.col("ticker") == benchmark).select("date", F.col("adj_close").alias("b"))
    both = prices.where("adj_close is not null").join(bench.where("b is not null"), "date")
    w = Window.partitionBy("ticker").orderBy("date")
    change = lambda c: safe_div(c, F.lag(c).over(w)) - 1
    moved = both.select("ticker", "date", change("adj_close").alias("x"), change("b").alias("y"))
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    terms = {"k": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    sums = window_sums(probes, moved.select("ticker", "date", *(F.when(paired, t).alias(c) for c, t in terms.items())), list(terms), days, at=at)
    together = F.col("xy") - F.col("x") * F.col("y") / F.col("k")
    enough = (F.col("n") >= least) & (F.col("k") >= max(least, 2))
    made = F.round(safe_div(together, _spread(F.col("yy"), F.col("y"), F.col("k"))), digits)
    return probes.join(sums.select("ticker", at, F.when(enough, made).alias(out)), ["ticker", at], "left")


def market_features(probes: DataFrame, prices: DataFrame, *, sector: str, broad: str, at: str = "as_of", digits: int = 6) -> DataFrame:
    """One row for each ticker and valid date: returns, excess over two indices, volatility, beta."""
    out = excess_returns(probes, prices, sector=sector, broad=broad, at=at, digits=digits)
    asked = probes.where(F.col(at).isNotNull()).select("ticker", at).distinct()
    measured = beta(volatility(asked, prices, at=at), prices, sector, at=at)
    return out.join(measured, ["ticker", at], "left")


def peer_spread(returns: DataFrame, subject: str, peers: Sequence[str], *, at: str = "as_of", value: str = "return_12m", digits: int = 6) -> DataFrame:
    """The subject's return less each peer's, one column a peer."""
    own = returns.where(F.col("ticker") == subject).select(at, F.col(value).alias("own"))
    theirs = returns.where(F.col("ticker").isin(*peers)).groupBy(at).pivot("ticker", list(peers)).agg(F.first(value))
    return own.join(theirs, at, "left").select(at, *(F.round(F.col("own") - F.col(p), digits).alias(f"spread_{p}") for p in peers))
