"""Windows of a few rows back over groups of any size: large groups are cut by time, and each cut hands its last rows on.

A group of more than ``size`` rows is cut where its leading order column changes, into
slices of about ``size`` rows.  What a window of ``back`` rows needs from before a slice
are the last ``back`` rows of the slice before, which are carried over and dropped again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from graintide.shared import keep

#: Rows of a slice, and groups with cuts that are broadcast.
SIZE, SMALL = 1_000_000, 200_000


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def sliced(rows: DataFrame, keys: Sequence[str], order: str, size: int = SIZE, least: int = 1) -> DataFrame:
    """rows with _slice (from 0) and _last, the number of its group's last slice.

    Slices hold whole values of ``order`` (days, say), and all but a group's last one hold
    half of ``size`` rows or more, which is at least ``least``.  The values of a large group, not its rows, pass one task.
    """
    keys, size = list(keys), max(size, 2 * least)
    large = keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > size), "large")
    n = large.count()
    if n == 0:
        return rows.withColumns({"_slice": F.lit(0), "_last": F.lit(0)})
    side = F.broadcast(large) if n <= SMALL else large
    own = rows.alias("d").join(side.alias("g"), _same("d", "g", keys), "left_semi").groupBy(*keys, F.col(order).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys).orderBy("_day")
    own = own.withColumn("_before", F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_step", F.floor(F.col("_before") / size))
    cuts = own.filter("_step > 0 AND _day IS NOT NULL").groupBy(*keys, "_step").agg(F.min("_day").alias("_day"), F.min("_before").alias("_before"))
    cuts = cuts.withColumn("_gap", F.col("_before") - F.coalesce(F.lag("_before").over(Window.partitionBy(*keys).orderBy("_step")), F.lit(0)))
    lists = cuts.filter(F.col("_gap") >= size / 2).groupBy(*keys).agg(F.array_sort(F.collect_list("_day")).alias("_cuts"))
    lists = keep(lists, "cuts")
    side = (F.broadcast(lists) if lists.count() <= SMALL else lists).alias("c")
    found = rows.alias("r").join(side, _same("r", "c", keys), "left").select("r.*", "_cuts")
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))
    return found.withColumns({"_slice": F.when(F.col(order).isNull() | F.col("_cuts").isNull(), 0).otherwise(number), "_last": F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts"))}).drop("_cuts")


def rolling(rows: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, cells: dict[str, Callable[[WindowSpec], Column]], size: int = SIZE) -> DataFrame:
    """rows with the cells, each made over a window of the row and the ``back`` rows before it in its group.

    ``order`` should leave no ties.
    """
    keys, order = list(keys), list(order)
    parts = sliced(rows, keys, order[0], size, back)
    part = Window.partitionBy(*keys, "_slice")
    ends = parts.filter("_slice < _last").withColumn("_nth", F.row_number().over(part.orderBy(*[F.desc(c) for c in order]))).filter(F.col("_nth") <= back).drop("_nth")
    carried = ends.withColumn("_slice", F.col("_slice") + 1).withColumn("_carried", F.lit(True))
    whole = parts.withColumn("_carried", F.lit(False)).unionByName(carried)
    window = part.orderBy(*order).rowsBetween(-back, Window.currentRow)
    return whole.withColumns({name: cell(window) for name, cell in cells.items()}).filter("NOT _carried").drop("_slice", "_last", "_carried")
