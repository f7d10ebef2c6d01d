"""Detectors, intervals and forecasts over each commodity's series, in batch and as streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.functions import series, trend
from graintide.plans.relational import r
from graintide.shared import folder
from graintide.streaming import events, online

#: Days of each commodity, standardised over its whole series; t counts days.
Z_DAYS = "SELECT commodity, arrival_date - DATE '1990-01-01' AS gone, (price - AVG(price) OVER (PARTITION BY commodity)) / NULLIF(STDDEV_POP(price) OVER (PARTITION BY commodity), 0) AS value, CAST(0 AS DOUBLE) AS guess FROM daily"


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.run(spark, sf_dir, Z_DAYS)
    return rows.select("commodity", F.extract(F.lit("DAY"), "gone").cast("long").alias("t"), "value", "guess")


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with the day before as the guess."""
    rows = views.run(spark, sf_dir, "SELECT commodity, arrival_date, price AS value, LAG(price) OVER (PARTITION BY commodity ORDER BY arrival_date) AS guess FROM daily")
    return rows.filter("guess IS NOT NULL").select("commodity", F.datediff("arrival_date", F.lit("1990-01-01").cast("date")).cast("long").alias("t"), "value", "guess")


def _streamed(spark: SparkSession, rows: DataFrame, rule: str, parts: int = 4) -> DataFrame:
    """The rule over rows that arrive in files, oldest first."""
    path = folder(spark, "arriving")
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    for k in range(parts):
        cut = [low + (high + 1 - low) * i // parts for i in (k, k + 1)]
        rows.filter((F.col("t") >= cut[0]) & (F.col("t") < cut[1])).coalesce(1).write.mode("append").parquet(path)
    return events.run_available(spark, online.stream(online.arriving(spark, path), rule), "append").select("commodity", "t", "one", "two", "three")


def _recursive(start: str, step: str, out: str, where: str = "TRUE") -> str:
    """DuckDB text: a fold over each commodity's days."""
    body = f"WITH z AS ({Z_DAYS}), s AS (SELECT commodity, CAST(gone AS BIGINT) AS t, value, ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY gone) AS i FROM z), e AS (SELECT commodity, i, t, {start} FROM s WHERE i = 1 UNION ALL SELECT s.commodity, s.i, s.t, {step} FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1) SELECT commodity, t, {out} FROM e WHERE {where}"
    return views.cte(body).replace("WITH ", "WITH RECURSIVE ", 1)


def _side(sign: str, total: str, least: str) -> tuple[str, str, str]:
    """Sum, least sum and alarm of one side after a value, sums starting anew after an alarm."""
    grown = f"({total} {sign} s.value - 0.005)"
    low = f"LEAST({least}, {grown})"
    return grown, low, f"({grown} - {low} > 25)"


def _page_hinkley_sql() -> str:
    parts = {"start": [], "step": []}
    for name, sign in (("up", "+"), ("down", "-")):
        for at, (total, least) in (("start", ("0", "0")), ("step", (f"e.{name}", f"e.{name}_least"))):
            grown, low, alarm = _side(sign, total, least)
            parts[at] += [f"CASE WHEN {alarm} THEN 0 ELSE {grown} END AS {name}", f"CASE WHEN {alarm} THEN 0 ELSE {low} END AS {name}_least", f"{alarm} AS {name}_alarm"]
    start = ", ".join(parts["start"]).replace("s.value", "value")
    return _recursive(start, ", ".join(parts["step"]), "CASE WHEN up_alarm AND down_alarm THEN 'both' WHEN up_alarm THEN 'up' ELSE 'down' END AS direction", "up_alarm OR down_alarm")


_EWMA_SQL = _recursive("value AS mean", "0.2 * s.value + 0.8 * e.mean", f"{r('mean')} AS ewma, ABS(mean) > 1 AS beyond")


def _alarms(found: DataFrame) -> DataFrame:
    both = (F.col("one") > 0) & (F.col("two") > 0)
    return found.filter("one > 0 OR two > 0").select("commodity", "t", F.when(both, "both").when(F.col("one") > 0, "up").otherwise("down").alias("direction"))


def _means(found: DataFrame) -> DataFrame:
    return found.select("commodity", "t", F.expr(r("one")).alias("ewma"), (F.col("two") > 0).alias("beyond"))


@registry.register("page_hinkley", _page_hinkley_sql())
def page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a commodity's mean is found to have moved up or down."""
    return _alarms(online.batch(_standard(spark, sf_dir), "page_hinkley"))


@registry.register("stream_page_hinkley", _page_hinkley_sql())
def stream_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as the days arrive."""
    return _alarms(_streamed(spark, _standard(spark, sf_dir), "page_hinkley"))


@registry.register("stream_ewma", _EWMA_SQL)
def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted means and whether they are beyond three deviations, as the days arrive."""
    return _means(_streamed(spark, _standard(spark, sf_dir), "ewma"))


def _coverage(found: DataFrame, rows: DataFrame) -> DataFrame:
    both = found.join(rows, ["commodity", "t"]).filter("NOT isnan(one)")
    inside = F.when(F.col("value").between(F.col("one"), F.col("two")), 1.0).otherwise(0.0)
    return both.groupBy("commodity").agg(F.count("*").alias("n_intervals"), F.round(F.avg(inside), 4).alias("coverage"), F.round(F.avg(F.col("two") - F.col("one")), 4).alias("mean_width"), F.round(F.max_by("three", "t"), 4).alias("last_alpha"))


@registry.register("adaptive_conformal")
def adaptive_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and width of intervals whose level follows what they missed (persistence as the guess)."""
    rows = _residuals(spark, sf_dir)
    return _coverage(online.batch(rows, "adaptive_conformal"), rows)


@registry.register("stream_adaptive_conformal")
def stream_adaptive_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as the days arrive."""
    rows = _residuals(spark, sf_dir)
    return _coverage(_streamed(spark, rows, "adaptive_conformal"), rows)


#: Months of a forecast, and deviations of an interval on either side.
AHEAD, Z = 6, 1.96
MONTHS = "SELECT commodity, year, month, avg_price FROM national"
_FORECAST = "commodity string, method string, parameter double, ahead int, month date, forecast double, low double, high double"


def _ahead(pdf: pd.DataFrame, k: int) -> list:
    last = pd.Timestamp(int(pdf["year"].iloc[-1]), int(pdf["month"].iloc[-1]), 1)
    return [(last + pd.DateOffset(months=i)).date() for i in range(1, k + 1)]


def _table(key: str, method: str, parameter: float, days: list, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"commodity": key, "method": method, "parameter": parameter, "ahead": np.arange(1, len(days) + 1), "month": days, "forecast": np.round(guess, 4), "low": np.round(low, 4), "high": np.round(high, 4)})


def holt_months(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Level and trend smoothing; the level's weight is the best of a grid by one-step errors."""
    pdf = pdf.sort_values(["year", "month"])
    y = pdf["avg_price"].to_numpy()
    grid = np.arange(1, 100) / 100
    alpha = min(grid, key=lambda a: float(((series.holt(y, a)[0] - y) ** 2).sum()))
    guesses, out = series.holt(y, alpha, ahead=AHEAD)
    half = Z * np.std(y - guesses)
    return _table(key[0], "holt", alpha, _ahead(pdf, AHEAD), out, out - half, out + half)


def seasonal_months(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Log-linear trend with yearly waves, multiplicative in the price; interval from the residuals."""
    pdf = pdf.sort_values(["year", "month"])
    y, t = np.log(pdf["avg_price"].to_numpy()), (12 * pdf["year"] + pdf["month"]).to_numpy().astype(float)
    waves = 3 if len(y) >= 24 else 0
    fit = np.linalg.lstsq(series.seasonal_design(t - t[0], t % 12, waves), y, rcond=None)[0]
    later = t[-1] + np.arange(1, AHEAD + 1)
    guess = series.seasonal_design(later - t[0], later % 12, waves) @ fit
    half = Z * np.std(y - series.seasonal_design(t - t[0], t % 12, waves) @ fit)
    return _table(key[0], "seasonal", float(waves), _ahead(pdf, AHEAD), np.exp(guess), np.exp(guess - half), np.exp(guess + half))


@registry.register("holt_forecast")
def holt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months ahead by smoothing."""
    return views.run(spark, sf_dir, MONTHS).groupBy("commodity").applyInPandas(holt_months, _FORECAST)


@registry.register("seasonal_trend_forecast")
def seasonal_trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months ahead by trend and season."""
    return views.run(spark, sf_dir, MONTHS).groupBy("commodity").applyInPandas(seasonal_months, _FORECAST)


_SPAN = "SELECT commodity, MIN(arrival_date) AS low, MAX(arrival_date) AS high FROM daily GROUP BY 1"


@registry.register("daily_grid", views.cte(f"WITH span AS ({_SPAN}), days AS (SELECT commodity, CAST(UNNEST(generate_series(CAST(low AS TIMESTAMP), CAST(high AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span) SELECT g.commodity, g.day, {r('d.price')} AS price FROM days g LEFT JOIN daily d ON d.commodity = g.commodity AND d.arrival_date = g.day"))
def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a commodity's first and last, its mean price or null."""
    days = views.run(spark, sf_dir, _SPAN).select("commodity", F.explode(F.sequence("low", "high")).alias("day"))
    priced = spark.sql(views.cte("SELECT commodity, arrival_date AS day, price FROM daily"))
    return days.join(priced, ["commodity", "day"], "left").select("commodity", "day", F.expr(r("price")).alias("price"))


_TREND = "commodity string, day date, level double, slope double, level_sd double, n_days int, obs_sd double, level_step double, slope_step double, log_likelihood double"


def _gridded(pdf: pd.DataFrame) -> tuple[pd.DatetimeIndex, np.ndarray]:
    """Every day from the first to the last, and its price or NaN."""
    own = pdf.assign(day=pd.to_datetime(pdf["day"])).groupby("day")["price"].mean()
    days = pd.date_range(own.index.min(), own.index.max())
    return days, own.reindex(days).to_numpy(float)


def kalman_days(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Smoothed level and slope of a series with gaps; nothing below 30 observed days or without variation."""
    days, y = _gridded(pdf)
    fit = trend.fitted(y)
    if fit is None:
        return pd.DataFrame(columns=[c.split()[0] for c in _TREND.split(", ")])
    return pd.DataFrame({"commodity": key[0], "day": days.date, "level": fit.states[:, 0], "slope": fit.states[:, 1], "level_sd": np.sqrt(np.maximum(fit.covs[:, 0, 0], 0)), "n_days": int((~np.isnan(y)).sum()), "obs_sd": fit.obs, "level_step": fit.level, "slope_step": fit.slope, "log_likelihood": fit.fit})


def _last_days(spark: SparkSession, sf_dir: str, most: int = 210) -> DataFrame:
    """The last observed days of each commodity."""
    newest = Window.partitionBy("commodity").orderBy(F.desc("day"))
    days = views.run(spark, sf_dir, "SELECT commodity, arrival_date AS day, price FROM daily WHERE price IS NOT NULL")
    return days.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most).drop("back")


@registry.register("kalman_trend")
def kalman_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and slope of the last 210 observed days, smoothed, at the likeliest deviations."""
    rounded = [F.round(c, 4).alias(c) for c in ("level", "slope", "level_sd")]
    return _last_days(spark, sf_dir).groupBy("commodity").applyInPandas(kalman_days, _TREND).select("commodity", "day", *rounded, "n_days", *[F.round(c, 6).alias(c) for c in ("obs_sd", "level_step", "slope_step")], F.round("log_likelihood", 2).alias("log_likelihood"))


_NOWCAST = "commodity string, day date, month_end date, days_remaining int, observed_days int, days_in_month int, completion_pct double, nowcast double, level double, slope double, low double, high double, n_days int"


def nowcast_days(key: tuple, pdf: pd.DataFrame, confidence: float = 0.9) -> pd.DataFrame:
    """Level and slope carried to the end of the last day's month, and how much of that month is reported."""
    days, y = _gridded(pdf)
    fit = trend.fitted(y)
    if fit is None:
        return pd.DataFrame(columns=[c.split()[0] for c in _NOWCAST.split(", ")])
    day = days[-1]
    end = day + pd.offsets.MonthEnd(0)
    guess, low, high = trend.projected(fit, (end - day).days, confidence)
    seen = int((~np.isnan(y[(days.year == day.year) & (days.month == day.month)])).sum())
    level, slope = fit.states[-1]
    row = (key[0], day.date(), end.date(), (end - day).days, seen, end.day, 100.0 * seen / end.day, guess, level, slope, low, high, len(y))
    return pd.DataFrame([row], columns=[c.split()[0] for c in _NOWCAST.split(", ")])


@registry.register("nowcast_month_end")
def nowcast_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price at the end of the last day's month with a band of 90 %."""
    rounded = {c: F.round(c, 4) for c in ("nowcast", "level", "slope", "low", "high")}
    return _last_days(spark, sf_dir).groupBy("commodity").applyInPandas(lambda key, pdf: nowcast_days(key, pdf), _NOWCAST).withColumns(rounded | {"completion_pct": F.round("completion_pct", 1)})
