"""Queries as functions of DataFrames and parameters.

``run`` evaluates any query that is one text over the caller's own tables: give ``prices``
(or ``daily``, ``monthly``, ``panel``, ``national``), ``rainfall`` and ``district_map``, or ``sales``,
filtered by commodity and dates as one likes; views that aren't given are made of those that are.
The others take the parameters of their family.  Results aren't rounded there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide import registry, slices, views
from graintide.plans import estimators
from graintide.plans.relational import whole

FIT = "commodity, label, bw AS bandwidth, kernel, poly AS order, n_left, n_right, effect, se AS std_error, t AS t_stat, p AS p_value"


def names() -> list[str]:
    """Keys that ``run`` takes."""
    registry.queries()
    return sorted(registry.texts)


def run(key: str, today: str | None = None, **given: DataFrame) -> DataFrame:
    """The query over the given views; ``today`` (yyyy-mm-dd) stands in place of its fixed day."""
    registry.queries()
    if key not in registry.texts:
        raise KeyError(f"{key} is not a text over views")
    if not given:
        raise ValueError("no table is given")
    unknown = set(given) - set(views.VIEWS)
    if unknown:
        raise ValueError(f"unknown views: {', '.join(sorted(unknown))}")
    sql, kept = registry.texts[key]
    if today is not None:
        fixed = [d for d in ("DATE '2001-06-30'", "DATE '2001-11-04'") if d in sql]
        if not fixed:
            raise ValueError(f"{key} has no fixed day")
        for d in fixed:
            sql = sql.replace(d, f"DATE '{today}'")
    return views.over(next(iter(given.values())).sparkSession, sql, given, kept)


def _fits(points: DataFrame, bandwidths: Sequence[int], kernels: Sequence[str], orders: Sequence[int]) -> DataFrame:
    """Effects at each point set's own cutoff c: points are commodity, label, x, y, c."""
    if not bandwidths or not kernels or not orders or min(bandwidths) <= 0 or set(orders) - {0, 1, 2} or set(kernels) - set(estimators.KERNELS):
        raise ValueError("bandwidths must be positive, orders 0 to 2, kernels triangular, uniform or epanechnikov")
    sql = f"WITH {estimators.tables(list(bandwidths), list(kernels), tuple(orders), points='SELECT * FROM {points}')} SELECT {FIT} FROM fit"
    return points.sparkSession.sql(whole(sql), points=points)


def _points(df: DataFrame, label: Column, cutoff: Column, x: str, y: str, by: str | None) -> DataFrame:
    """Rows with both numbers as points; ``by`` names the series, one series where it is None."""
    series = F.lit("all") if by is None else F.col(by).cast("string")
    rows = df.select(series.alias("commodity"), label.alias("label"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), cutoff.cast("double").alias("c"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def rdd_local(df: DataFrame, cutoff: float = -19.0, bandwidth: int = 20, kernel: str = "triangular", order: int = 1, x: str = "departure_pct", y: str = "avg_price", by: str | None = "commodity") -> DataFrame:
    """Jump of y where x crosses the cutoff, by series; the bandwidth is a share (in per cent) of the span of x.

    Fewer than five points on a side, or no spread, give no row.
    """
    return _fits(_points(df, F.lit("jump"), F.lit(cutoff), x, y, by), [bandwidth], [kernel], [order])


def rdd_specifications(df: DataFrame, cutoff: float = -19.0, bandwidths: Sequence[int] = (10, 15, 20, 25, 30), kernels: Sequence[str] = ("triangular", "uniform", "epanechnikov"), orders: Sequence[int] = (1, 2), x: str = "departure_pct", y: str = "avg_price", by: str | None = "commodity") -> DataFrame:
    """The jump under every bandwidth, kernel and order, from one pass over the points."""
    return _fits(_points(df, F.lit("jump"), F.lit(cutoff), x, y, by), bandwidths, kernels, orders)


def rdd_placebo(df: DataFrame, cutoffs: Sequence[float], cutoff: float = -19.0, apart: float = 2.0, bandwidth: int = 20, kernel: str = "triangular", x: str = "departure_pct", y: str = "avg_price", by: str | None = "commodity") -> DataFrame:
    """Jumps at other cutoffs, more than ``apart`` from the true one, where none should be; ``label`` is the cutoff."""
    others = [c for c in cutoffs if abs(c - cutoff) > apart]
    if not others:
        raise ValueError("no cutoff is far enough from the true one")
    each = df.withColumn("_c", F.explode(F.array(*[F.lit(float(c)) for c in others])))
    return _fits(_points(each, F.col("_c").cast("string"), F.col("_c"), x, y, by), [bandwidth], [kernel], [1])


def rolling_prices(df: DataFrame, rows: int = 30, keys: Sequence[str] = ("state", "district", "commodity"), order: Sequence[str] = ("arrival_date",), price: str = "modal_price", size: int = slices.SIZE) -> DataFrame:
    """df with mean, least and greatest price and number of each row and the ones before it in its group, ``rows`` in all."""
    if rows < 1:
        raise ValueError("a window has a row at least")
    cells = {"rolling_avg": lambda w: F.avg(price).over(w), "rolling_min": lambda w: F.min(price).over(w), "rolling_max": lambda w: F.max(price).over(w), "rows_in_window": lambda w: F.count(F.lit(1)).over(w)}
    return slices.rolling(df, keys, order, rows - 1, cells, size)
