"""Rainfall, vegetation and monsoon files in their published shapes.

Defined cases: cells that are no number are null, rows without their key go, an
input without rows gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.functions.text import clean_number, clean_text

# Spellings of each column, in order of precedence.
RAIN_HEADERS = {
    "sub_division": ("sub_division", "Sub_Division", "subdivision", "SUBDIVISION"),
    "year": ("year", "Year"),
    "month": ("month", "Month"),
    "rainfall_mm": ("rainfall", "Rainfall", "RAINFALL"),
    "normal_mm": ("normal", "Normal", "NORMAL"),
    "departure_pct": ("departure_pct", "departure", "Departure", "DEPARTURE", "anomaly_pct", "Anomaly"),
}


def daily_rain_json(spark: SparkSession, path: str) -> DataFrame:
    """Parallel arrays of days and amounts, a place a line, to (sub_division, date, precip_mm); null amounts go."""
    raw = spark.read.schema("sub_division string, daily struct<time:array<string>,precipitation_sum:array<double>>").json(path)
    pairs = raw.select("sub_division", F.inline(F.arrays_zip(F.col("daily.time").alias("time"), F.col("daily.precipitation_sum").alias("amount"))))
    return pairs.filter("amount IS NOT NULL AND time IS NOT NULL").select("sub_division", F.to_date("time").alias("date"), F.col("amount").alias("precip_mm"))


def rain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly rainfall of sub-divisions under four header spellings; the departure is computed where it is missing and the normal positive."""
    raw = spark.read.option("header", True).csv(path)
    where: dict[str, list[int]] = {c: [raw.columns.index(h) for h in own if h in raw.columns] for c, own in RAIN_HEADERS.items()}
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    cell = lambda c: F.coalesce(*[clean_text(F.col(f"c{i}")) for i in where[c]], F.lit(None).cast("string"))
    rain, normal, given = (clean_number(cell(c)) for c in ("rainfall_mm", "normal_mm", "departure_pct"))
    rows = raw.select(cell("sub_division").alias("sub_division"), cell("year").try_cast("int").alias("year"), cell("month").try_cast("int").alias("month"), rain.alias("rainfall_mm"), normal.alias("normal_mm"), given.alias("departure_pct"))
    rows = rows.filter("sub_division IS NOT NULL AND year <> 0 AND month <> 0")
    return rows.withColumn("departure_pct", F.coalesce("departure_pct", F.when(F.col("normal_mm") > 0, (F.col("rainfall_mm") - F.col("normal_mm")) / F.col("normal_mm") * 100)))


def ndvi_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """Statistics responses, a place a line, to (district, date, ndvi, valid_pixels): intervals with a mean and a valid pixel."""
    stats = "struct<mean:string,sampleCount:long,noDataCount:long>"
    raw = spark.read.schema(f"district string, data array<struct<interval:struct<`from`:string>,outputs:struct<default:struct<bands:struct<B0:struct<stats:{stats}>>>>>>").json(path)
    rows = raw.select("district", F.explode("data").alias("d")).select("district", F.substring("d.interval.from", 1, 10).alias("date"), F.col("d.outputs.default.bands.B0.stats").alias("s"))
    valid = F.coalesce("s.sampleCount", F.lit(0)) - F.coalesce("s.noDataCount", F.lit(0))
    rows = rows.select("district", F.to_date("date").alias("date"), F.round(clean_number(F.col("s.mean")), 4).alias("ndvi"), valid.alias("valid_pixels"))
    return rows.filter("ndvi IS NOT NULL AND valid_pixels > 0")


def monsoon_json(spark: SparkSession, path: str) -> DataFrame:
    """Yearly monsoon series (year, jun, jul, aug, sep, jun_sep) by year; rows whose year is no number go."""
    months = ("jun", "jul", "aug", "sep", "jun_sep")
    fields = ",".join(f"{c}:string" for c in ("year", *months))
    raw = spark.read.schema(f"records array<struct<{fields}>>").json(path).select(F.inline("records"))
    rows = raw.select(F.col("year").try_cast("int").alias("year"), *[clean_number(F.col(c)).alias(c) for c in months])
    return rows.filter("year IS NOT NULL").orderBy("year")
