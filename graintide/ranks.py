"""Exact quantiles by histograms that narrow to the wanted order statistics.

No task ever holds a group.  The first pass counts each group's rows in equal bins
between its least and greatest value; partial counts are made where the rows are, so
what is shuffled is a row a bin.  A wanted rank lies in one bin, whose own least and
greatest values bound the next pass; only rows within such bounds are counted again.
A rank is found once its bin holds one value, or few enough rows to be listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graintide.shared import keep

#: Bins of a pass, rows of a bin that may be listed, bounds that are broadcast, and parts of a group that meets its bounds by shuffling.
BINS, LISTED, SMALL, SALTS = 2048, 512, 200_000, 32


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Number of the bin, growing with x.  The ends have bins of their own, so every pass narrows; halves keep the span finite."""
    share = (x / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    inner = F.greatest(F.lit(1), F.least(F.lit(BINS - 2), F.floor(F.coalesce(share, F.lit(0.0)) * (BINS - 2)) + 1))
    return F.when(x == low, F.lit(0)).when(x == high, F.lit(BINS - 1)).otherwise(inner).cast("int")


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def _within(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """rows (keys, x) with the bounds (low, high) of their group that hold x; a group's bounds don't overlap."""
    inside = F.col("r.x").between(F.col("b.low"), F.col("b.high"))
    names = [*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r.x").alias("x"), F.col("b.low").alias("low"), F.col("b.high").alias("high")]
    if small or not keys:
        return rows.alias("r").join(F.broadcast(bounds.alias("b")), [*_same(keys), inside]).select(*names)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS).cast("long")))
    copies = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.alias("r").join(copies.alias("b"), [*_same(keys), F.col("r._salt") == F.col("b._salt"), inside]).select(*names)


def order_statistics(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """(keys, rank, value): the values of the wanted ranks (keys, rank from 0) among the group's x, which has no null or NaN.

    rows: keys and a double x.
    """
    keys = list(keys)
    found: list[DataFrame] = []
    ends = keep(rows.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high")), "ends")
    # target: (keys, rank, low, high, at), the rank is the at-th (from 0) of the rows within its bounds
    target = wanted.alias("r").join(ends.alias("b"), _same(keys) or F.lit(True)).select(*[F.col(f"r.{k}").alias(k) for k in keys], "rank", "low", "high", F.col("rank").alias("at"))
    target = keep(target, "target")
    while True:
        found.append(target.filter("low = high").select(*keys, "rank", F.col("low").alias("value")))
        target = target.filter("low < high")
        bounds = keep(target.select(*keys, "low", "high").distinct(), "bounds")
        n = bounds.count()
        if n == 0:
            break
        held = _within(rows, bounds, keys, n <= small).withColumn("bin", _bin(F.col("x"), F.col("low"), F.col("high")))
        group = [*keys, "low", "high"]
        counts = held.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = keep(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "bins")
        hit = target.alias("t").join(bins.alias("b"), [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col("at") >= F.col("before"), F.col("at") < F.col("before") + F.col("n")])
        target = keep(hit.select(*[F.col(f"t.{k}").alias(k) for k in keys], "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("at") - F.col("before")).alias("at"), "n"), "target")
        few = target.filter(f"low < high AND n <= {LISTED}")
        if not few.isEmpty():  # at most LISTED values of one bin come together
            own = keep(few.select(*keys, "low", "high").distinct(), "few")
            lists = _within(rows, own, keys, own.count() <= small).groupBy(*group).agg(F.sort_array(F.collect_list("x")).alias("values"))
            got = few.alias("t").join(lists.alias("b"), [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])
            found.append(got.select(*[F.col(f"t.{k}").alias(k) for k in keys], "rank", F.expr("values[cast(at as int)]").alias("value")))
            target = target.filter(f"NOT (low < high AND n <= {LISTED})")
        target = target.drop("n")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: dict[str, float], small: int = SMALL) -> DataFrame:
    """keys, n and one column a share: the quantile between the two nearest order statistics, as percentile_cont has it.

    Nulls and NaN of the column aren't counted; groups without a value have no row; null keys are a group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    rows = rows.withColumn("x", F.col("x") + F.lit(0.0))  # one zero
    sizes = keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = sizes.filter("n > 0")
    place = {name: F.lit(float(share)) * (F.col("n") - 1) for name, share in shares.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    values = order_statistics(rows, keys, sizes.select(*keys, F.explode(ranks).alias("rank")), small)
    mapped = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    both = sizes.alias("r").join(mapped.alias("b"), _same(keys) or F.lit(True)).select(*[F.col(f"r.{k}").alias(k) for k in keys], "n", "at")
    cells = []
    for name, p in place.items():
        low, high = F.col("at")[F.floor(p).cast("long")], F.col("at")[F.ceil(p).cast("long")]
        cells.append((low + (high - low) * (p - F.floor(p))).alias(name))
    return both.select(*keys, "n", *cells)


def median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """keys, n and the median of the column."""
    return quantiles(df, keys, column, {name: 0.5})
