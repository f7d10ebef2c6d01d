"""Tails beyond a threshold by maximum likelihood, for all keys at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import ranks, registry, views
from graintide.plans.forecasting import BACK
from graintide.shared import keep

#: Points of a search round, rounds, and where the first one searches; keys whose state is broadcast.
POINTS, ROUNDS, LOW, HIGH, SMALL = 40, 5, -6.0, 10.0, 200_000


def pareto_tails(excess: DataFrame, keys: Sequence[str], least: int = 25) -> DataFrame:
    """keys, k, shape, scale, log_likelihood, at_edge: the generalised Pareto law of each key's positive x at the greatest likelihood.

    With t = shape / scale, the likeliest shape at a given t is the mean of ln(1 + t x), so one number
    is searched: u, where t = (e^u - 1) / max(x), which keeps every 1 + t x above zero.  A round takes one mean a
    point and key over the rows and narrows to the best point's neighbours.  ``at_edge`` marks keys whose
    likelihood still grows at the search's end (a scale near the greatest x); keys of fewer than ``least`` rows have no row.
    """
    keys = list(keys)
    rows = keep(excess.select(*keys, F.col("x").cast("double").alias("x")).filter("x > 0"), "excess")
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max("x").alias("most"), F.avg("x").alias("mean")).filter(F.col("k") >= least)
    state = keep(state.withColumns({"low": F.lit(LOW), "high": F.lit(HIGH)}), "search")
    small = state.count() <= SMALL
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
    for _ in range(ROUNDS):
        place = [f"(low + (high - low) * {j / POINTS!r})" for j in range(POINTS + 1)]
        side = (F.broadcast(state) if small else state).alias("s")
        joined = rows.alias("r").join(side, same or F.lit(True)).select(*[F.col(f"r.{c}").alias(c) for c in keys], "x", "k", "most", "mean", "low", "high")
        means = joined.groupBy(*keys, "k", "most", "mean", "low", "high").agg(*[F.avg(F.expr(f"log1p((exp({u}) - 1) / most * x)")).alias(f"_{j}") for j, u in enumerate(place)])
        fits = []
        for j, u in enumerate(place):
            t = f"(exp({u}) - 1) / most"
            fit = f"CASE WHEN abs({u}) < 1e-7 THEN -ln(mean) - 1 ELSE -ln(_{j} / ({t})) - _{j} - 1 END"
            fits.append(F.struct(F.expr(fit).alias("fit"), F.lit(-j).alias("less"), F.expr(u).alias("u"), F.expr(f"CASE WHEN abs({u}) < 1e-7 THEN 0D ELSE _{j} END").alias("shape"), F.expr(f"CASE WHEN abs({u}) < 1e-7 THEN mean ELSE _{j} / ({t}) END").alias("scale")))
        best = means.withColumn("best", F.array_max(F.array(*fits)))
        step = "(high - low) / " + repr(float(POINTS))
        state = keep(best.select(*keys, "k", "most", "mean", "best", F.expr(f"greatest({LOW}D, best.u - {step})").alias("low"), F.expr(f"least({HIGH}D, best.u + {step})").alias("high")), "search")
    edge = (F.col("best.u") <= LOW + 1e-3) | (F.col("best.u") >= HIGH - 1e-3)
    return state.select(*keys, "k", F.col("best.shape").alias("shape"), F.col("best.scale").alias("scale"), (F.col("best.fit") * F.col("k")).alias("log_likelihood"), edge.alias("at_edge"))


def tails(losses: DataFrame, keys: Sequence[str], share: float = 0.9, least_losses: int = 60, least: int = 25) -> DataFrame:
    """keys, n, threshold and the tail's law: losses (keys, loss) beyond their quantile ``share``; too few losses, or too few beyond, give no row."""
    keys = list(keys)
    losses = keep(losses.select(*keys, "loss").filter("loss IS NOT NULL AND NOT isnan(loss)"), "losses")
    edges = keep(ranks.quantiles(losses, keys, "loss", {"threshold": share}).filter(F.col("n") >= least_losses), "thresholds")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in keys]
    beyond = losses.alias("l").join(edges.alias("e"), [*same, F.col("loss") > F.col("threshold")]).select(*[F.col(f"l.{c}").alias(c) for c in keys], (F.col("loss") - F.col("threshold")).alias("x"))
    fits = pareto_tails(beyond, keys, least)
    return edges.alias("l").join(fits.alias("e"), same or F.lit(True)).select("l.*", "k", "shape", "scale", "log_likelihood", "at_edge")


def beyond_sample(fits: DataFrame, confidence: float = 0.99) -> DataFrame:
    """fits with var and es at the confidence; null where the threshold lies above it or a shape of 1 and more has no mean."""
    if not 0.5 < confidence < 1:
        raise ValueError("confidence must lie between 0.5 and 1")
    ratio = f"({1 - confidence!r} / (k / CAST(n AS DOUBLE)))"
    var = f"CASE WHEN {ratio} >= 1 OR shape >= 1 THEN NULL WHEN abs(shape) < 1e-6 THEN threshold - scale * ln({ratio}) ELSE threshold + scale / shape * (power({ratio}, -shape) - 1) END"
    return fits.withColumn("var", F.expr(var)).withColumn("es", F.expr("(var + scale - shape * threshold) / (1 - shape)"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily losses of each commodity's last 730 days."""
    return views.run(spark, sf_dir, f"SELECT commodity, -(price / before - 1) AS loss FROM ({BACK}) t WHERE before > 0 AND price > 0 AND back <= 730")


def _rounded(*names: str) -> list:
    return [F.round(c, 4).alias(c) for c in names]


@registry.register("gpd_maximum_likelihood")
def gpd_maximum_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and scale of each commodity's losses beyond their 90 % quantile."""
    found = tails(_losses(spark, sf_dir), ["commodity"])
    return found.select("commodity", "n", F.col("k").alias("n_beyond"), *_rounded("threshold", "shape", "scale"), F.round("log_likelihood", 2).alias("log_likelihood"), "at_edge")


@registry.register("evt_var_es_likelihood")
def evt_var_es_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss that one day in a hundred exceeds, and the mean loss beyond it."""
    found = beyond_sample(tails(_losses(spark, sf_dir), ["commodity"]))
    return found.filter("var IS NOT NULL").select("commodity", F.round("var", 4).alias("var99"), F.round("es", 4).alias("es99"))
