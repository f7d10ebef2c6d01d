"""Procurement advice of each district from a jump at the threshold, its cross-check, the spike risk and a price forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.plans import causal, estimators, learning  # noqa: F401  (estimators registers the jump)

#: Risk taken where none is known, least risks of the levels, change in per cent that counts as a trend.
UNKNOWN_RISK, HIGH, MODERATE, TREND = 50.0, 70.0, 40.0, 5.0
#: What to do at each level where prices jump under a deficit, and where that isn't shown; the reason in words.
ACTIONS = {
    ("HIGH", True): ("LOCK_PROCUREMENT", "Lock in purchases before the expected rise."),
    ("HIGH", False): ("MONITOR", "The cause is uncertain; look at prices every week."),
    ("MODERATE", True): ("CONSIDER_EARLY_PROCUREMENT", "Buying a part early would hedge against a rise."),
    ("MODERATE", False): ("WATCH", "Look again next week."),
    ("LOW", True): ("NO_ACTION_NEEDED", "Nothing needs to be bought early."),
    ("LOW", False): ("NO_ACTION_NEEDED", "Nothing needs to be bought early."),
}


def advice(rows: DataFrame, corrected: bool = True) -> DataFrame:
    """rows (commodity, district, rdd_effect, fe_effect, risk_score, current_price, forecast_price) with trend, evidence, confidence, level, action and text.

    ``rdd_effect`` is the price at normal rain less that under a deficit, so a deficit raises prices where it is
    negative; ``corrected=False`` reads a positive effect as a rise.  Any figure may be null: it's no evidence then, an unknown risk
    counts as moderate, a forecast without a positive current price is no forecast, and an unknown district is the whole region.
    """
    rise = -F.col("rdd_effect") if corrected else F.col("rdd_effect")
    trend = F.when(F.col("current_price") > 0, (F.col("forecast_price") - F.col("current_price")) * 100 / F.col("current_price"))
    out = rows.withColumn("deficit_effect", rise).withColumn("trend_pct", trend)
    known = sum((F.col(c).isNotNull().cast("int") for c in ("rdd_effect", "fe_effect", "risk_score", "trend_pct")), F.lit(0))
    risk = F.coalesce("risk_score", F.lit(UNKNOWN_RISK))
    out = out.withColumn("evidence", known).withColumn("level", F.when(risk >= HIGH, "HIGH").when(risk >= MODERATE, "MODERATE").otherwise("LOW"))
    out = out.withColumn("confidence", F.when(F.col("evidence") >= 3, "high").when(F.col("evidence") == 2, "moderate").otherwise("low"))
    jumps = F.coalesce(F.col("deficit_effect") > 0, F.lit(False))

    def chosen(part: int) -> Column:
        found = F.lit(None).cast("string")
        for (level, jump), words in ACTIONS.items():
            found = F.when((F.col("level") == level) & (jumps == F.lit(jump)), words[part]).otherwise(found)
        return found

    agree = F.signum("fe_effect") * F.signum("deficit_effect") > 0
    check = F.when(F.col("fe_effect").isNull(), "").when(agree, ", which fixed effects confirm").otherwise(", which fixed effects don't confirm")
    cause = F.concat(F.when(jumps, "Prices rise by ").otherwise("Prices fall by "), F.format_string("%.0f", F.abs("deficit_effect")), F.lit(" where rain crosses into deficit"), check, F.lit("."))
    course = F.when(F.col("trend_pct") > TREND, "up").when(F.col("trend_pct") < -TREND, "down").otherwise("level")
    ahead = F.concat(F.lit("The forecast is "), course, F.format_string(": %.0f after %.0f (%+.0f%%).", "forecast_price", "current_price", "trend_pct"))
    first = F.concat(F.col("level"), F.format_string(" risk (%.0f%%) for ", risk), F.coalesce("commodity", F.lit("the commodity")), F.lit(" in "), F.coalesce("district", F.lit("the region")), F.lit("."))
    text = F.concat_ws(" ", first, F.when(F.col("deficit_effect").isNotNull(), cause), F.when(F.col("trend_pct").isNotNull(), ahead), chosen(1))
    return out.withColumn("action", chosen(0)).withColumn("text", text)


@registry.register("district_advice")
def district_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for every district whose risk is known; commodities without one have a row for the whole region."""
    names = views.run(spark, sf_dir, "SELECT commodity, MAX_BY(avg_price, year * 12 + month) AS current_price FROM national GROUP BY 1")
    jump = registry.queries()["rdd_local_linear"](spark, sf_dir).select("commodity", F.col("effect").alias("rdd_effect"))
    effects = causal.fixed_effects_query(spark, sf_dir).select("commodity", F.col("coefficient").alias("fe_effect"))
    ahead = learning.lag_regression_forecast(spark, sf_dir).groupBy(F.col("key").alias("commodity")).agg(F.max_by("forecast", "step").alias("forecast_price"))
    risk = learning.spike_risk_score(spark, sf_dir).select("commodity", "state", "district", "risk_score")
    out = names
    for part in (jump, effects, ahead, risk):
        out = out.join(part, "commodity", "left")
    rounded = {c: F.round(c, 2) for c in ("current_price", "forecast_price", "trend_pct")}
    return advice(out).withColumns(rounded)
