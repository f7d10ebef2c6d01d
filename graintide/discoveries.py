"""False-discovery control over stored estimates, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An effect nearer to zero is a collapsed fit, not a hypothesis.
LEAST = 1e-6


def _degenerate(effect: Column) -> Column:
    beyond = F.isnan(effect) | (F.abs(effect) == float("inf")) | (F.abs(effect) < LEAST)
    return effect.isNull() | F.coalesce(beyond, F.lit(True))


def newest(estimates: DataFrame, key: str = "commodity") -> DataFrame:
    """The last computed estimate of each key that has a p-value; of one time the greatest id.  A null key is a key."""
    usable = estimates.filter("p_value IS NOT NULL AND NOT isnan(p_value)")
    cells = [c for c in estimates.columns if c != key]
    return usable.groupBy(key).agg(F.max_by(F.struct(*cells), F.struct("computed_at", "id")).alias("row")).select(key, "row.*")


def entries(estimates: DataFrame, alpha: float = 0.05, key: str = "commodity") -> DataFrame:
    """One row a key: its newest estimate, whether it is degenerate, q-value, and significance before and after control.

    estimates: key, effect, p_value, n_left, n_right, computed_at, id.  Degenerate estimates are no
    hypotheses: they have no q-value and no significance.  Ties of p share the place order of their keys.
    """
    rows = newest(estimates, key).withColumn("degenerate", _degenerate(F.col("effect")))
    # one window over the keys: a row a commodity
    up = Window.partitionBy("degenerate").orderBy("p_value", key)
    ranked = rows.withColumns({"_place": F.row_number().over(up), "_tests": F.count("*").over(Window.partitionBy("degenerate"))})
    raw = F.col("p_value") * F.col("_tests") / F.col("_place")
    least = F.min(raw).over(Window.partitionBy("degenerate").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0))
    held = ranked.withColumn("q_value", F.when(~F.col("degenerate"), F.least(F.lit(1.0), least)))
    flag = lambda c: F.when(~F.col("degenerate"), F.col(c) < alpha)
    return held.select(key, "effect", "p_value", "n_left", "n_right", "degenerate", "q_value", flag("p_value").alias("significant_raw"), flag("q_value").alias("significant_fdr"))


def summary(found: DataFrame, alpha: float = 0.05, key: str = "commodity") -> DataFrame:
    """One row over ``entries``: hypotheses, those significant before and after, false ones to expect, degenerate ones and survivors by name."""
    own = ~F.col("degenerate")
    names = lambda where: F.array_join(F.array_sort(F.collect_list(F.when(where, F.col(key)))), ", ")
    return found.agg(
        F.count_if(own).alias("n_hypotheses"),
        F.count_if("significant_raw").alias("n_significant_raw"),
        F.count_if("significant_fdr").alias("n_significant_fdr"),
        F.count_if("degenerate").alias("n_degenerate"),
        (F.count_if(own) * F.lit(alpha)).alias("expected_false"),
        names(F.col("degenerate")).alias("degenerate"),
        names(F.col("significant_fdr")).alias("survivors"),
    )
