"""Lists of what a table holds against what it should hold, merges by key, and freshness, as functions of DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graintide.cleaning import folded


def union_sources(**tables: DataFrame) -> DataFrame:
    """Tables of differing columns one under another, each row with the name of its ``source``; a column that a table lacks is null there."""
    named = [t.withColumn("source", F.lit(name)) for name, t in tables.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def difference(targets: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """(column, place): names both wanted and found are ``present``, wanted only ``missing``, found only ``unmatched``.

    Names are compared folded; of several spellings the least of the wanted, else of the found, is shown.
    """
    side = lambda t, name: t.groupBy(folded(F.col(column)).alias("_key")).agg(F.min(F.trim(column)).alias(name)).filter("_key IS NOT NULL")
    both = side(targets, "_wanted").join(side(found, "_found"), "_key", "full")
    place = F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "unmatched").otherwise("present")
    return both.select(F.coalesce("_wanted", "_found").alias(column), place.alias("place"))


def targets_present(targets: Sequence[str], found: DataFrame, column: str = "commodity") -> DataFrame:
    """(place, column): the targets that the table holds, in the targets' order; a target named twice counts once."""
    order = list(dict.fromkeys(targets))
    wanted = found.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {column} string")
    return wanted.join(found.select(column).distinct(), column, "left_semi").select("place", column).orderBy("place")


def rows_of_targets(df: DataFrame, targets: Sequence[str], column: str = "commodity") -> DataFrame:
    """Rows of df whose column is a target; ``targets`` is a list of the caller's, so it is a literal."""
    return df.filter(F.col(column).isin(list(targets)))


def options(df: DataFrame, column: str, limit: int = 50, default: Sequence[str] = ()) -> DataFrame:
    """(place, option, n): the commonest non-empty values in title case, ties by value; ``default`` where there is none."""
    counted = df.filter(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "value").limit(limit)
    shown = top.select(F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("place"), F.initcap("value").alias("option"), "n")
    if not default:
        return shown
    spare = df.sparkSession.createDataFrame([(i + 1, x, 0) for i, x in enumerate(default)], "place int, option string, n long")
    none = counted.limit(1).agg(F.count("*").alias("_some")).filter("_some = 0")
    return shown.unionByName(spare.join(F.broadcast(none), how="cross").drop("_some"))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to add: those whose key ``old`` lacks, the first of each by ``order``.  Null keys equal each other."""
    key = list(key)
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("row")).select("row.*")
    held = old.select(*key).distinct()
    return first.alias("n").join(held.alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """old with the rows of each key in ``new`` deleted and the last of them by ``order`` put in their place.  Null keys equal each other."""
    key = list(key)
    last = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("row")).select("row.*")
    rest = old.alias("o").join(last.select(*key).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "left_anti")
    return rest.unionByName(last)


def freshness(prices: DataFrame) -> DataFrame:
    """(commodity, latest_date, n): one row a folded commodity; rows without a commodity are left out."""
    return prices.groupBy(folded(F.col("commodity")).alias("commodity")).agg(F.max("arrival_date").alias("latest_date"), F.count("*").alias("n")).filter("commodity IS NOT NULL")


def staleness(fresh: DataFrame, watched: Sequence[str], now: Column, hours: float = 48, extras: int = 5) -> DataFrame:
    """(commodity, kind, state, hours_ago): every watched commodity, and the stalest few of the others.

    fresh: (commodity, latest_date).  A watched commodity without a row is missing, one without a
    date or older than ``hours`` is stale, else fresh; others are shown only where they are stale.
    """
    spark: SparkSession = fresh.sparkSession
    order = list(dict.fromkeys(w.strip().lower() for w in watched))
    wanted = spark.createDataFrame([(w,) for w in order], "commodity string")
    ago = (F.unix_seconds(now) - F.unix_seconds(F.col("latest_date").cast("timestamp"))) / 3600
    rows = fresh.select(folded(F.col("commodity")).alias("commodity"), ago.alias("hours_ago"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "missing").when(F.coalesce(F.col("hours_ago") <= hours, F.lit(False)), "fresh").otherwise("stale")
    first = wanted.join(rows, "commodity", "left").select("commodity", F.lit("watched").alias("kind"), state.alias("state"), "hours_ago")
    others = rows.join(wanted, "commodity", "left_anti").filter(F.col("hours_ago") > hours)
    others = others.orderBy(F.desc("hours_ago"), "commodity").limit(extras).select("commodity", F.lit("extra").alias("kind"), F.lit("stale").alias("state"), "hours_ago")
    return first.unionByName(others)


def freshness_kpis(fresh: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """One row: commodities, their rows, those with a row of the last days, and the sorted source types."""
    recent = F.col("latest_date") >= F.date_sub(today, days)
    kinds = F.array_sort(F.collect_set(F.nullif("source_type", F.lit(""))))
    return fresh.agg(F.count_distinct("commodity").alias("commodities"), F.sum("n").alias("row_count"), F.count_distinct(F.when(recent, F.col("commodity"))).alias("recent"), F.array_join(kinds, ", ").alias("source_types"))
