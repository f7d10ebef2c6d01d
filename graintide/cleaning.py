"""Repairs of place names, numbers and dates, as functions of DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.functions import dates

#: Other spellings of states, and the names they stand for.
STATE_ALIASES = {
    "jammu and kashmir": "Jammu & Kashmir",
    "jammu & kashmir": "Jammu & Kashmir",
    "orissa": "Odisha",
    "uttaranchal": "Uttarakhand",
    "nct of delhi": "NCT of Delhi",
    "delhi": "NCT of Delhi",
    "pondicherry": "Puducherry",
    "andaman and nicobar": "Andaman & Nicobar",
    "andaman & nicobar islands": "Andaman & Nicobar",
}


def folded(c: Column) -> Column:
    """Lower case without blanks at the ends; null where nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def canonical_state(c: Column, aliases: dict[str, str] = STATE_ALIASES) -> Column:
    """The state that an alias stands for; other names, null among them, as they are."""
    if not aliases:
        return c
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(c))), c)


def state_lookup(*tables: DataFrame, aliases: dict[str, str] = STATE_ALIASES) -> DataFrame:
    """(place, state): one canonical state for each folded district of (district, state) tables.

    A later table stands before an earlier one; within a table the greatest name wins.  Empty
    districts and states are no entries.
    """
    ranked = [t.select(folded(F.col("district")).alias("place"), F.lit(i).alias("rank"), canonical_state(F.trim("state"), aliases).alias("state")) for i, t in enumerate(tables)]
    rows = functools.reduce(DataFrame.unionByName, ranked).filter("place IS NOT NULL AND state <> ''")
    return rows.groupBy("place").agg(F.max(F.struct("rank", "state"))["state"].alias("state"))


def backfill_states(prices: DataFrame, lookup: DataFrame, aliases: dict[str, str] = STATE_ALIASES) -> DataFrame:
    """prices with every empty state filled by its district's, all states canonical, and ``state_from``: own, lookup or nothing.

    A state that is filled or stands in no lookup stays null.  Rows with a state of their own
    don't take part in the join's key, so a district without gaps costs no match.
    """
    own = F.nullif(F.trim("state"), F.lit(""))
    gap = prices.withColumn("_place", F.when(own.isNull(), folded(F.col("district"))))
    found = gap.join(lookup.select(F.col("place").alias("_place"), F.col("state").alias("_found")), "_place", "left")
    kept = F.when(own.isNotNull(), canonical_state(F.col("state"), aliases)).otherwise(F.col("_found"))
    origin = F.when(own.isNotNull(), "own").when(F.col("_found").isNotNull(), "lookup").otherwise("nothing")
    return found.withColumn("state_from", origin).withColumn("state", kept).select(*prices.columns, "state_from")


def backfill_report(filled: DataFrame) -> DataFrame:
    """Of the rows that had no state: one row a district, its rows and whether its state was found; null districts are left out."""
    gaps = filled.filter("state_from <> 'own' AND trim(district) <> ''")
    return gaps.groupBy("district").agg(F.count("*").alias("n"), F.bool_or(F.col("state_from") == "lookup").alias("matched"))


def to_subdivision(prices: DataFrame, places: DataFrame, unmapped: bool = False) -> DataFrame:
    """prices with the sub_division of their (state, district), else of the same names in title case.

    places: (state, district, sub_division); of several for one place the least is taken.  Rows
    without one are dropped, or kept with a null where ``unmapped``.
    """
    known = places.groupBy("state", "district").agg(F.min("sub_division").alias("sub_division"))
    exact = known.select(F.col("state"), F.col("district"), F.col("sub_division").alias("_exact"))
    titled = known.select(F.col("state").alias("_state"), F.col("district").alias("_district"), F.col("sub_division").alias("_titled"))
    rows = prices.join(exact, ["state", "district"], "left").withColumns({"_state": F.initcap("state"), "_district": F.initcap("district")})
    rows = rows.join(titled, ["_state", "_district"], "left").withColumn("sub_division", F.coalesce("_exact", "_titled"))
    rows = rows if unmapped else rows.filter("sub_division IS NOT NULL")
    return rows.select(*prices.columns, "sub_division")


def date_summary(df: DataFrame, column: str, today: Column) -> DataFrame:
    """One row: dates by status, those rejected, and accepted ones whose month and day could change places."""
    ambiguous = F.coalesce((F.dayofmonth("day") <= 12) & (F.dayofmonth("day") != F.month("day")), F.lit(False))
    # counted by status first, so that the long expression of a date stands once in the plan
    kinds = dates.classified(df, column, today).groupBy("status", ambiguous.alias("_either")).agg(F.count("*").alias("_n"))
    total = lambda name, where: F.coalesce(F.sum(F.when(where, F.col("_n"))), F.lit(0)).alias(name)
    each = [total(s, F.col("status") == s) for s in ("ok", "missing", "unparseable", "future", "impossible")]
    return kinds.agg(total("n", F.lit(True)), *each, total("rejected", F.col("status") != "ok"), total("ambiguous", F.col("_either")))


def rainfall_rows(rainfall: DataFrame, sub_division: str, limit: int | None = None, band: tuple[float, float] = (-100, 200)) -> DataFrame:
    """The months of a sub-division in any case, the first ``limit`` if given, without departures beyond the band; no number is null."""
    here = rainfall.filter(F.lower("sub_division") == sub_division.lower()).filter(F.col("departure_pct").between(*band))
    kinds = dict(rainfall.dtypes)
    cells = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rainfall.columns]
    here = here.orderBy("year", "month")
    return (here if limit is None else here.limit(limit)).select(*cells)
