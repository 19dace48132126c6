"""Modelling on panels: matrices, baselines, evaluation and walk-forward fits from expanding sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.running import with_running_sums
from ledgerline.functions.workers import ship


def metrics_wide(metrics: DataFrame, names: Sequence[str], *, entity: str = "entity") -> DataFrame:
    """One row for each period: first non-null values, first availability."""
    rows = metrics.where("value is not null")
    wide = rows.groupBy(entity, "fiscal_period").pivot("metric", list(names)).agg(F.min_by("value", F.struct("source_available_date", "value")))
    return wide.join(rows.groupBy(entity, "fiscal_period").agg(F.min("source_available_date").alias("source_available_date")), [entity, "fiscal_period"])


def text_wide(features: DataFrame, metrics: DataFrame, names: Sequence[str], *, entity: str = "entity") -> DataFrame:
    """Text features of the period that was filed on the same day, as nlp_<section>_<name>."""
    periods = metrics.groupBy(entity, F.col("source_available_date").alias("filing_date")).agg(F.min("fiscal_period").alias("fiscal_period"))
    name = F.concat(F.lit("nlp_"), F.col("section"), F.lit("_"), F.col("feature_name"))
    return features.join(periods, [entity, "filing_date"]).withColumn("__n", name).groupBy(entity, "fiscal_period").pivot("__n", list(names)).agg(F.round(F.avg("value"), 6))


def feature_target_matrix(wide: DataFrame, target: str, text: DataFrame | None = None, *, entity: str = "entity") -> DataFrame:
    """Rows in order of availability; the target is the next row's value, known on the next row's day."""
    rows = wide if text is None else wide.join(text, [entity, "fiscal_period"], "left")
    w = Window.partitionBy(entity).orderBy("source_available_date", "fiscal_period")
    return (
        rows.withColumn("feature_available_date", F.col("source_available_date")).withColumn("prediction_date", F.col("source_available_date"))
        .withColumn("target_value", F.lead(target).over(w)).withColumn("target_period", F.lead("fiscal_period").over(w)).withColumn("target_available_date", F.lead("source_available_date").over(w)).drop("source_available_date")
    )


def fit_linear(rows: DataFrame, features: Sequence[str], target: str, *, alpha: float = 0.1, l1: float = 0.5, ridge: bool = False, digits: int = 6) -> DataFrame:
    """(feature, coefficient) of a ridge (alpha) or elastic-net (alpha, l1) fit, nulls as 0; none under two rows.

    Sums of products, made in one pass, are all that the fit needs; they reach the driver, which solves the small system.
    """
    p = len(features)
    values = [*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features), F.col(target).cast("double")]
    clean = rows.where(F.col(target).isNotNull()).select(*(v.alias(f"x{i}") for i, v in enumerate(values)))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    found = clean.agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p + 1)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    spark, n = rows.sparkSession, found.n
    if n < 2 or not found[f"c{p}_{p}"]:
        return spark.createDataFrame([], "feature string, coefficient double")
    square = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        square[i, j] = square[j, i] = found[f"c{i}_{j}"] * n
    w = solve(square[:p, :p], square[:p, p], n, alpha=alpha, l1=l1, ridge=ridge, steps=2000)
    intercept = found[f"m{p}"] - sum(found[f"m{i}"] * w[i] for i in range(p))
    made = [*zip(features, w.tolist(), strict=True), ("intercept", float(intercept))]
    return spark.createDataFrame([(f, round(c, digits)) for f, c in made], "feature string, coefficient double")


def solve(gram: np.ndarray, xy: np.ndarray, n: int, *, alpha: float, l1: float, ridge: bool, steps: int = 200) -> np.ndarray:
    """Coefficients for centred sums of squares: ridge in closed form, elastic net by coordinate descent."""
    p = len(xy)
    if ridge:
        return np.linalg.solve(gram + alpha * np.eye(p), xy)
    w = np.zeros(p)
    for _ in range(steps):
        before = w.copy()
        for j in range(p):
            rho = (xy[j] - gram[j] @ w + gram[j, j] * w[j]) / n
            size = gram[j, j] / n + alpha * (1 - l1)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / size if size > 0 else 0.0
        if np.abs(w - before).max() < 1e-10:
            break
    return w


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, *, by: Sequence[str] = ("entity",), order: Sequence[str] = ("feature_available_date", "fiscal_period"), least: int = 3, alpha: float = 0.1, l1: float = 0.5, ridge: bool = False, digits: int = 6) -> DataFrame:
    """by, order, fold, prediction, actual: row i is predicted by a fit on all rows before it.

    Sums of products over expanding windows are all a fit needs; they are made by Spark, and each row's small system is
    solved in Arrow batches. No fold repeats a row.
    """
    rows = rows.where(F.col(target).isNotNull())
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    y = F.col(target).cast("double")
    w = Window.partitionBy(*by).orderBy(*order)
    p = len(x)
    names = [*(f"__x{i}" for i in range(p)), "__y"]
    base = rows.select(*by, *order, *(c.alias(n) for c, n in zip([*x, y], names, strict=True)), F.row_number().over(w).alias("fold"))
    ordered = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(n).over(ordered) for n in names] + [F.sum(F.col(names[i]) * F.col(names[j])).over(ordered) for i in range(p + 1) for j in range(i, p + 1)]
    made = base.withColumn("__s", F.array(*sums)).withColumn("__n", F.col("fold") - 1).where(F.col("__n") >= least).withColumn("__v", F.array(*names))
    ship(rows.sparkSession)
    predict = predictor(p, alpha, l1, ridge)
    return made.select(*by, *order, "fold", F.round(predict("__s", "__v", "__n"), digits).alias("prediction"), F.col("__y").alias("actual"))


def predictor(p: int, alpha: float, l1: float, ridge: bool):
    """A pandas UDF (sums and sums of products of p features and the target, a row's values, rows summed) -> prediction."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def predict(s: pd.Series, v: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, now, m in zip(s, v, n, strict=True):
            a, m = np.asarray(a, dtype=float), int(m)
            mean, square = a[: p + 1] / m, np.zeros((p + 1, p + 1))
            square[np.triu_indices(p + 1)] = a[p + 1 :]
            square = square + np.triu(square, 1).T - m * np.outer(mean, mean)
            c = solve(square[:p, :p], square[:p, p], m, alpha=alpha, l1=l1, ridge=ridge)
            out.append(mean[p] + (np.asarray(now, dtype=float)[:p] - mean[:p]) @ c)
        return pd.Series(out, dtype=float)

    return predict


def pooled_walk_forward(rows: DataFrame, features: Sequence[str], target: str, *, keys: Sequence[str] = ("entity", "fiscal_period"), at: str = "feature_available_date", least: int = 5, alpha: float = 0.1, l1: float = 0.5, ridge: bool = False, digits: int = 6) -> DataFrame:
    """keys, at, n_train, prediction, actual: every row is predicted by a fit on all entities' rows of earlier days.

    Sums of products are made by day first, then summed up along ranges of days; no window runs over all days.
    """
    rows, p = rows.where(F.col(target).isNotNull()), len(features)
    names = [*(f"__x{i}" for i in range(p)), "__y"]
    values = [*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features), F.col(target).cast("double")]
    base = rows.select(*keys, at, *(c.alias(n) for c, n in zip(values, names, strict=True)))
    parts = [*names, *(f"__p{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))]
    terms = [F.col(n) for n in names] + [F.col(names[i]) * F.col(names[j]) for i in range(p + 1) for j in range(i, p + 1)]
    days = base.groupBy(at).agg(F.count("*").alias("__c"), *(F.sum(t).alias(n) for t, n in zip(terms, parts, strict=True)))
    past = with_running_sums(days, ["__c", *parts], order=[at], before=True)
    known = past.select(at, F.col("__c").alias("n_train"), F.array(*parts).alias("__s"))
    ship(rows.sparkSession)
    made = base.join(known, at).where(F.col("n_train") >= least).withColumn("__v", F.array(*names))
    return made.select(*keys, at, "n_train", F.round(predictor(p, alpha, l1, ridge)("__s", "__v", "n_train"), digits).alias("prediction"), F.col("__y").alias("actual"))


def baselines(rows: DataFrame, target: str, *, by: Sequence[str] = ("entity",), order: Sequence[str] = ("feature_available_date", "fiscal_period"), digits: int = 6) -> DataFrame:
    """Last value, means of the last 4 and 3 values (two at least), and the linear trend of all earlier ones carried a step on."""
    w = Window.partitionBy(*by).orderBy(*order)
    i = F.row_number().over(w) - 1
    mean = lambda n: F.when((F.col("i") >= n) & (F.count(target).over(w.rowsBetween(-n, -1)) >= 2), F.avg(target).over(w.rowsBetween(-n, -1)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("i", i)
    at = F.when(F.col(target).isNotNull(), F.col("i").cast("double"))
    trend = F.regr_slope(F.col(target), at).over(past) * F.col("i") + F.regr_intercept(F.col(target), at).over(past)
    return out.select(
        *by, *order, F.col(target).alias("actual"), F.lag(target).over(w).alias("last_value"), F.round(mean(4), digits).alias("mean_4"), F.round(mean(3), digits).alias("mean_3"), F.round(trend, digits).alias("linear_trend")
    )


def evaluate(rows: DataFrame, models: Sequence[str], *, by: Sequence[str] = ("entity",), order: Sequence[str] = ("feature_available_date", "fiscal_period"), digits: int = 6) -> DataFrame:
    """by, model, n, mae, rmse (round 6), directional_accuracy (round 4): share of equal signs of first differences."""
    long = rows.unpivot([*by, *order, "actual"], list(models), "model", "prediction").where("prediction is not null and actual is not null")
    w = Window.partitionBy(*by, "model").orderBy(*order)
    change = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    e = F.col("prediction") - F.col("actual")
    marked = long.withColumn("same", (change("prediction") == change("actual")).cast("double"))
    return marked.groupBy(*by, "model").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), digits).alias("mae"), F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"), F.round(F.avg("same"), 4).alias("directional_accuracy"))


def model_quality(scores: DataFrame, coefficients: DataFrame, model: str, *, by: Sequence[str] = ("entity",)) -> DataFrame:
    """degenerate if no coefficient reaches 0.001, diagnostic if the model is worse than every baseline, else usable."""
    size = coefficients.where("feature <> 'intercept'").groupBy(*by).agg(F.max(F.abs("coefficient")).alias("largest"))
    best = scores.groupBy(*by).agg(F.max(F.when(F.col("model") == model, F.col("mae"))).alias("own"), F.max(F.when(F.col("model") != model, F.col("mae"))).alias("worst"))
    status = F.when(F.coalesce(F.col("largest") < 0.001, F.lit(True)), "degenerate").when(F.col("own") > F.col("worst"), "diagnostic").otherwise("usable")
    return best.join(size, list(by), "left").select(*by, status.alias("status"))


def leaderboard(scores: DataFrame, coefficients: DataFrame | None = None, *, by: Sequence[str] = ("entity",)) -> DataFrame:
    """scores with each model's place by error; coefficients (by, model, feature, coefficient) add a row for each of a
    model's coefficients with its place by size. Models without coefficients have one row.
    """
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("mae", "model")))
    if coefficients is None:
        return ranked
    size = Window.partitionBy(*by, "model").orderBy(F.desc(F.abs("coefficient")), "feature")
    sorted_ = coefficients.select(*by, "model", "feature", "coefficient", F.row_number().over(size).alias("coefficient_place"))
    return ranked.join(sorted_, [*by, "model"], "left")


def trend_coefficients(rows: DataFrame, target: str, *, by: Sequence[str] = ("entity",), order: Sequence[str] = ("feature_available_date", "fiscal_period"), digits: int = 6) -> DataFrame:
    """(by, model, feature, coefficient) of the linear trend over all rows with a target: its slope and intercept."""
    at = rows.withColumn("__i", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("double")).where(F.col(target).isNotNull())
    fits = at.groupBy(*by).agg(F.regr_slope(target, "__i").alias("slope"), F.regr_intercept(target, "__i").alias("intercept"))
    long = fits.unpivot(list(by), ["slope", "intercept"], "feature", "coefficient").where("coefficient is not null")
    return long.select(*by, F.lit("linear_trend").alias("model"), "feature", F.round("coefficient", digits).alias("coefficient"))


def peer_panel_info(peers: DataFrame, features: Sequence[str], target: str, *, ticker: str = "ticker", least: int = 10) -> DataFrame:
    """(ticker, n_rows, included, reason): all features null, then too short a history, then no target."""
    empty = F.bool_and(F.coalesce(*(F.col(f).cast("double") for f in features)).isNull())
    rows = peers.groupBy(ticker).agg(F.count("*").alias("n_rows"), empty.alias("e"), F.count(target).alias("t"))
    reason = F.when(F.col("e"), "all_null").when(F.col("n_rows") < least, "history").when(F.col("t") == 0, "no_target")
    return rows.select(ticker, "n_rows", reason.isNull().alias("included"), reason.alias("reason"))


def peer_panel(peers: DataFrame, features: Sequence[str], target: str, *, ticker: str = "ticker", least: int = 10) -> DataFrame:
    chosen = peer_panel_info(peers, features, target, ticker=ticker, least=least).where("included").select(ticker)
    return peers.join(chosen, ticker, "left_semi")


def column_coverage(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, present, coverage) of the declared columns; columns that the panel lacks count 0."""
    there = [c for c in columns if c in panel.columns]
    wide = panel.agg(F.count("*").alias("__n"), *(F.count(c).alias(c) for c in there))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(c in there).alias("present"), F.round(F.try_divide(F.col(c) if c in there else F.lit(0), F.col("__n")), 6).alias("coverage")) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")
