"""Reports that need order statistics or rows before each row, over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import ranks, registry, slices, views
from graintide.plans.monitoring import FEATURES
from graintide.plans.relational import r, whole
from graintide.shared import keep


def _p(share: float, column: str) -> str:
    return f"percentile_cont({share}) WITHIN GROUP (ORDER BY {column})"


_STACKED = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, order_date FROM sales" for c in FEATURES)
#: The same reports with whole groups in one task, as the oracle has them.
PLAIN = {
    "rolling_price_trend": f"SELECT state, district, commodity, arrival_date, src_order, src_line, src_part, {r('AVG(modal_price) OVER w')} AS rolling_avg, {r('MIN(modal_price) OVER w')} AS rolling_min, {r('MAX(modal_price) OVER w')} AS rolling_max, COUNT(*) OVER w AS n FROM prices WINDOW w AS (PARTITION BY state, district, commodity ORDER BY arrival_date, modal_price, src_order, src_line, src_part ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "regional_margin": f"WITH g AS (SELECT region, segment, COUNT(*) AS n, AVG(profit_margin) AS margin, MEDIAN(profit_margin) AS mid, SUM(profit) AS profit, SUM(sales) AS sales, AVG(is_loss * 100e0) AS loss_pct FROM sales GROUP BY 1, 2) SELECT region, segment, n, {r('margin')} AS margin, {r('mid')} AS median_margin, {r('profit')} AS profit, {r('loss_pct')} AS loss_pct, RANK() OVER (ORDER BY {r('margin', 6)} DESC) AS margin_rank, {r('margin - AVG(margin) OVER ()')} AS against_overall, CASE WHEN margin - AVG(margin) OVER () > 5 THEN 'Above Target' WHEN margin - AVG(margin) OVER () >= -5 THEN 'At Target' ELSE 'Below Target' END AS performance_tier FROM g",
    "discount_tier_analysis": f"WITH t AS (SELECT discount_tier, COUNT(*) AS n, AVG(profit_margin) AS margin, MEDIAN(profit_margin) AS mid, SUM(profit) AS profit FROM sales GROUP BY 1) SELECT discount_tier, n, {r('n * 100e0 / SUM(n) OVER ()')} AS share_pct, {r('margin')} AS margin, {r('mid')} AS median_margin, CASE WHEN margin >= 15 THEN 'Healthy' WHEN margin >= 0 THEN 'At Risk' ELSE 'Loss' END AS health FROM t",
    "outlier_audit_iqr": f"WITH q AS (SELECT category, {_p(0.25, 'sales')} AS q1, {_p(0.75, 'sales')} AS q3 FROM sales GROUP BY 1) SELECT s.category, COUNT(*) AS n, {r('MIN(q.q3 + 1.5e0 * (q.q3 - q.q1))')} AS upper_bound, SUM(CASE WHEN s.sales > q.q3 + 1.5e0 * (q.q3 - q.q1) THEN 1 ELSE 0 END) AS n_beyond, {r('AVG(s.is_loss * 1e0)')} AS loss_share, SUM(CASE WHEN s.sub_category IS NULL THEN 1 ELSE 0 END) AS missing_sub_category FROM sales s JOIN q ON q.category = s.category GROUP BY 1",
    "feature_baseline_stats": f"WITH f AS ({_STACKED}) SELECT feature, COUNT(x) AS n, {r('AVG(x)')} AS mean, {r('STDDEV_SAMP(x)')} AS sd, {r('MIN(x)')} AS least, {r('MAX(x)')} AS most, {r(_p(0.05, 'x'))} AS p5, {r(_p(0.25, 'x'))} AS p25, {r(_p(0.5, 'x'))} AS p50, {r(_p(0.75, 'x'))} AS p75, {r(_p(0.95, 'x'))} AS p95 FROM f GROUP BY 1",
}


def _oracle(key: str) -> str:
    return views.cte(whole(PLAIN[key]))


def _shown(**cells: str):
    return [F.expr(r(x)).alias(c) for c, x in cells.items()]


_PLACE = ("state", "district", "commodity")


@registry.register("rolling_price_trend", _oracle("rolling_price_trend"))
def rolling_price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest price of each row and the 29 before it in its district and commodity."""
    rows = views.run(spark, sf_dir, "SELECT state, district, commodity, arrival_date, src_order, src_line, src_part, modal_price FROM prices")
    price = "modal_price"
    cells = {"mean": lambda w: F.avg(price).over(w), "least": lambda w: F.min(price).over(w), "most": lambda w: F.max(price).over(w), "n": lambda w: F.count(F.lit(1)).over(w)}
    out = slices.rolling(rows, _PLACE, ["arrival_date", price, "src_order", "src_line", "src_part"], 29, cells)
    return out.select(*_PLACE, "arrival_date", "src_order", "src_line", "src_part", *_shown(rolling_avg="mean", rolling_min="least", rolling_max="most"), "n")


@registry.register("regional_margin", _oracle("regional_margin"))
def regional_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of each region and segment, with ranks."""
    rows = keep(views.run(spark, sf_dir, "SELECT region, segment, profit_margin, profit, sales, is_loss FROM sales"), "sales")
    sums = rows.groupBy("region", "segment").agg(F.count("*").alias("n"), F.avg("profit_margin").alias("margin"), F.sum("profit").alias("profit"), F.avg(F.col("is_loss") * 100).alias("loss_pct"))
    both = sums.join(ranks.median(rows, ["region", "segment"], "profit_margin", "mid").drop("n"), ["region", "segment"])
    return both.selectExpr("region", "segment", "n", f"{r('margin')} AS margin", f"{r('mid')} AS median_margin", f"{r('profit')} AS profit", f"{r('loss_pct')} AS loss_pct", f"RANK() OVER (ORDER BY {r('margin', 6)} DESC) AS margin_rank", f"{r('margin - AVG(margin) OVER ()')} AS against_overall", "CASE WHEN margin - AVG(margin) OVER () > 5 THEN 'Above Target' WHEN margin - AVG(margin) OVER () >= -5 THEN 'At Target' ELSE 'Below Target' END AS performance_tier")


@registry.register("discount_tier_analysis", _oracle("discount_tier_analysis"))
def discount_tier_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share, margin and health of each discount tier."""
    rows = keep(views.run(spark, sf_dir, "SELECT discount_tier, profit_margin FROM sales"), "sales")
    sums = rows.groupBy("discount_tier").agg(F.count("*").alias("n"), F.avg("profit_margin").alias("margin"))
    both = sums.join(ranks.median(rows, ["discount_tier"], "profit_margin", "mid").drop("n"), "discount_tier")
    return both.selectExpr("discount_tier", "n", f"{r('n * 100e0 / SUM(n) OVER ()')} AS share_pct", f"{r('margin')} AS margin", f"{r('mid')} AS median_margin", "CASE WHEN margin >= 15 THEN 'Healthy' WHEN margin >= 0 THEN 'At Risk' ELSE 'Loss' END AS health")


@registry.register("outlier_audit_iqr", _oracle("outlier_audit_iqr"))
def outlier_audit_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the upper quartile fence of their category."""
    rows = keep(views.run(spark, sf_dir, "SELECT category, sales, is_loss, sub_category FROM sales"), "sales")
    fences = ranks.quantiles(rows, ["category"], "sales", {"q1": 0.25, "q3": 0.75}).selectExpr("category", "q3 + 1.5e0 * (q3 - q1) AS fence")
    out = rows.join(fences, "category").groupBy("category").agg(F.count("*").alias("n"), F.max("fence").alias("fence"), F.count_if(F.col("sales") > F.col("fence")).alias("n_beyond"), F.avg("is_loss").alias("loss"), F.count_if(F.col("sub_category").isNull()).alias("missing_sub_category"))
    return out.select("category", "n", *_shown(upper_bound="fence"), "n_beyond", *_shown(loss_share="loss"), "missing_sub_category")


@registry.register("feature_baseline_stats", _oracle("feature_baseline_stats"))
def feature_baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and percentiles of each numeric column of the orders, which are read once."""
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in FEATURES)
    rows = keep(views.run(spark, sf_dir, f"SELECT stack({len(FEATURES)}, {stack}) AS (feature, x) FROM sales"), "features")
    sums = rows.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    both = sums.join(ranks.quantiles(rows, ["feature"], "x", shares).drop("n"), "feature")
    return both.select("feature", "n", *_shown(**{c: c for c in ("mean", "sd", "least", "most", *shares)}))
