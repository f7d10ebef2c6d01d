"""Sources and sinks on the given tables: their rows written in each published shape and read back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide import registry, views
from graintide.plans.relational import r
from graintide.shared import folder
from graintide.sources import climate, prices, results

TODAY = "2001-06-30"


def _oracle(where: str = "TRUE", **other: str) -> str:
    """The price rows that a reader gives back, with some columns by another expression."""
    cells = [f"{other[c]} AS {c}" if c in other else f"{r(c)} AS {c}" if c in prices.PRICES else c for c in prices.CANONICAL]
    return views.cte(f"SELECT {', '.join(cells)} FROM prices WHERE {where}")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, "SELECT * FROM prices")


def _named(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(h) for c, h in headers.items()])


def _csv(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = folder(spark, name)
    rows.write.csv(path, header=True)
    return path


def _lines(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """One JSON object a line, null fields left out."""
    path = folder(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*prices.TEXTS, F.col("arrival_date").cast("date").alias("arrival_date"), *[F.expr(r(c)).alias(c) for c in prices.PRICES])


@registry.register("src_agmarknet_csv", _oracle("src_line <> 7"))
def src_agmarknet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive export with word months; rows without a date go."""
    rows = _prices(spark, sf_dir).withColumn("arrival_date", F.when(F.col("src_line") != 7, F.date_format("arrival_date", "dd MMM yyyy")))
    return _shown(prices.agmarknet_csv(spark, _csv(spark, _named(rows, prices.ARCHIVE), "archive")))


@registry.register("src_datagov_csv", _oracle())
def src_datagov_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot export."""
    return _shown(prices.datagov_csv(spark, _csv(spark, _named(_prices(spark, sf_dir), prices.SNAPSHOT), "snapshot")))


@registry.register("src_canonical_csv", _oracle())
def src_canonical_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical columns."""
    return _shown(prices.canonical_csv(spark, _csv(spark, _prices(spark, sf_dir).select(*prices.CANONICAL), "canonical")))


def _wfp(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("arrival_date").alias("date"), F.col("state").alias("admin1"), F.col("district").alias("admin2"), "market", "commodity", F.col("modal_price").alias("price"))


@registry.register("src_wfp_csv", _oracle(variety="commodity", grade="''", min_price="CAST(NULL AS DOUBLE)", max_price="CAST(NULL AS DOUBLE)"))
def src_wfp_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Food-price export with one price."""
    return _shown(prices.wfp_csv(spark, _csv(spark, _wfp(_prices(spark, sf_dir)), "wfp")))


_SHAPES = "CASE src_line % 5 WHEN 0 THEN 'agmarknet_historical' WHEN 1 THEN 'data_gov_in_snapshot' WHEN 2 THEN 'canonical' WHEN 3 THEN 'wfp_food_prices' END"


@registry.register("detect_price_format", views.cte(f"SELECT {_SHAPES} AS format, COUNT(*) AS n, {r('AVG(modal_price)')} AS mean_price FROM prices WHERE src_line % 5 <> 4 GROUP BY 1"))
def detect_price_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five shapes, one of them unknown, told apart by header, read each in its way and united."""
    rows, base = _prices(spark, sf_dir), folder(spark, "mixed")
    written = [lambda x: _named(x, prices.ARCHIVE), lambda x: _named(x, prices.SNAPSHOT), lambda x: x.select(*prices.CANONICAL), _wfp, lambda x: x.select(F.col("market").alias("place"), F.col("modal_price").alias("amount"))]
    for k, shape in enumerate(written):
        shape(rows.filter(F.col("src_line") % 5 == k)).write.csv(f"{base}/part={k}", header=True)
    found = prices.detect_price_format(spark, f"{base}/part=*/*.csv").select(F.regexp_extract("file", "(.*)/[^/]*$", 1).alias("folder"), "format").distinct().filter("format IS NOT NULL")
    readers = {"agmarknet_historical": prices.agmarknet_csv, "data_gov_in_snapshot": prices.datagov_csv, "canonical": prices.canonical_csv, "wfp_food_prices": prices.wfp_csv}
    parts = [readers[x.format](spark, x.folder).withColumn("arrival_date", F.col("arrival_date").cast("date")).withColumn("format", F.lit(x.format)) for x in found.collect()]  # one row a folder
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy("format").agg(F.count("*").alias("n"), F.expr(r("AVG(modal_price)")).alias("mean_price"))


@registry.register("src_alias_csv", _oracle(grade="COALESCE(grade, 'FAQ')"))
def src_alias_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in other spellings."""
    headers = {"state": "State", "district": " District", "market": "MANDI", "commodity": "Commodity", "variety": "Variety", "grade": "Grade", "arrival_date": "ArrivalDate", "min_price": "Min_x0020_Price", "max_price": "Max Price", "modal_price": "Price"}
    return _shown(prices.alias_csv(spark, _csv(spark, _named(_prices(spark, sf_dir), headers), "alias")))


@registry.register("ingest_folder", _oracle())
def ingest_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drop folder read by a stream into a table; a second run finds nothing new."""
    drop, table, state = (folder(spark, x) for x in ("drop", "table", "state"))
    _prices(spark, sf_dir).select(*prices.CANONICAL).write.csv(drop, header=True)
    prices.ingest_folder(spark, drop, table, state)
    return _shown(prices.ingest_folder(spark, drop, table, state))


@registry.register("src_price_json", _oracle(arrival_date=f"CASE WHEN arrival_date > DATE '{TODAY}' + INTERVAL '1' DAY THEN NULL ELSE arrival_date END"))
def src_price_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API records in three spellings; dates after tomorrow (of a fixed day) are null."""
    rows = _prices(spark, sf_dir)
    snake = {c: c for c in prices.CANONICAL}
    pascal = {c: "_".join(p.capitalize() for p in c.split("_")) for c in prices.CANONICAL}
    spelt = [snake, pascal, snake | {"state": "state_name", "district": "district_name", "market": "market_name"}]
    day = F.col("arrival_date").cast("string")
    texts = [_named(rows.filter(F.col("src_line") % 3 == k).withColumn("arrival_date", day), names).select(F.to_json(F.struct("*")).alias("value")) for k, names in enumerate(spelt)]
    path = folder(spark, "records")
    functools.reduce(DataFrame.unionByName, texts).write.text(path)
    return _shown(prices.price_json(spark, path, F.lit(TODAY).cast("date")))


_MONTH = "CAST(make_date(year, month, 1) AS DATE)"


@registry.register("src_ceda_json", views.cte(f"SELECT state, CASE WHEN n_nationkey % 9 = 8 THEN CONCAT('district ', CAST(n_nationkey AS VARCHAR(9))) ELSE district END AS district, commodity, 'label' AS variety, {_MONTH} AS arrival_date, {r('avg_price')} AS modal_price FROM monthly JOIN nation ON n_name = district"))
def src_ceda_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of district months with ids for names; one district in nine has no name."""
    items = views.run(spark, sf_dir, "SELECT CAST(MIN(p_partkey) AS INT) AS id, p_type AS name FROM part GROUP BY p_type")
    states = spark.sql("SELECT CAST(r_regionkey AS INT) AS id, r_name AS name FROM region")
    districts = spark.sql("SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation")
    rows = spark.sql(views.cte(f"SELECT *, CAST({_MONTH} AS STRING) AS t FROM monthly"))
    rows = rows.join(items.select(F.col("id").alias("commodity_id"), F.col("name").alias("commodity")), "commodity").join(districts.select(F.col("id").alias("census_district_id"), F.col("name").alias("district")), "district").join(states.select(F.col("id").alias("state_id"), F.col("name").alias("state")), "state")
    own = F.collect_list(F.struct("t", "census_district_id", F.col("avg_price").alias("p_modal")))  # the months of one commodity and year in one state
    sent = rows.groupBy("commodity_id", "state_id", "year").agg(F.struct(own.alias("data")).alias("output")).drop("year")
    got = prices.ceda_json(spark, _lines(spark, sent, "envelopes"), states, districts.filter("id % 9 <> 8"), items, "label")
    return got.select("state", "district", "commodity", "variety", "arrival_date", F.expr(r("modal_price")).alias("modal_price"))


@registry.register("src_monthly_cell_json", views.cte(f"SELECT state, district, district AS market, commodity, commodity AS variety, {_MONTH} AS arrival_date, {r('avg_price')} AS modal_price FROM monthly"))
def src_monthly_cell_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cells."""
    rows = views.run(spark, sf_dir, f"SELECT substr(CAST({_MONTH} AS STRING), 1, 7) AS t, commodity AS cmdty, district AS district_name, state, avg_price AS p_modal FROM monthly")
    return prices.monthly_cell_json(spark, _lines(spark, rows, "cells")).select("state", "district", "market", "commodity", "variety", "arrival_date", F.expr(r("modal_price")).alias("modal_price"))


_DAYS = "SELECT CONCAT('SUBDIV_', CAST(c_nationkey % 12 AS VARCHAR(4))) AS sub_division, CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"


@registry.register("src_daily_rain_json", f"SELECT sub_division, date, {r('amount', 2)} AS precip_mm FROM ({_DAYS}) t WHERE day(date) <> 13")
def src_daily_rain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of one year's days a line; null amounts are left out."""
    rows = views.run(spark, sf_dir, _DAYS)
    own = rows.groupBy("sub_division", F.year("date").alias("y")).agg(F.collect_list(F.struct(F.col("date").cast("string").alias("t"), F.when(F.dayofmonth("date") != 13, F.col("amount")).alias("p"))).alias("d"))
    sent = own.select("sub_division", F.struct(F.col("d.t").alias("time"), F.col("d.p").alias("precipitation_sum")).alias("daily"))
    return climate.daily_rain_json(spark, _lines(spark, sent, "days")).select("sub_division", "date", F.expr(r("precip_mm", 2)).alias("precip_mm"))


@registry.register("src_rain_csv", views.cte(f"SELECT sub_division, year, month, {r('rainfall_mm', 2)} AS rainfall_mm, {r('normal_mm', 2)} AS normal_mm, {r('departure_pct')} AS departure_pct FROM rainfall"))
def src_rain_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-division months without a departure, which is computed."""
    rows = views.run(spark, sf_dir, "SELECT sub_division AS SUBDIVISION, year AS Year, month AS Month, rainfall_mm AS RAINFALL, normal_mm AS NORMAL FROM rainfall")
    got = climate.rain_csv(spark, _csv(spark, rows, "rain"))
    return got.select("sub_division", "year", "month", *[F.expr(r(c, k)).alias(c) for c, k in (("rainfall_mm", 2), ("normal_mm", 2), ("departure_pct", 4))])


_GREEN = "SELECT district, year, month, AVG(max_price / modal_price - 1) * 10 AS mean, COUNT(*) AS n FROM prices GROUP BY 1, 2, 3".replace("year, month", "CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month")


@registry.register("src_ndvi_stats_json", views.cte(f"SELECT district, {_MONTH} AS date, {r('mean')} AS ndvi, n AS valid_pixels FROM ({_GREEN}) t WHERE month NOT IN (2, 3)"))
def src_ndvi_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics responses; intervals without a mean or a valid pixel go."""
    rows = views.run(spark, sf_dir, _GREEN)
    stats = F.struct(F.when(F.col("month") == 3, "NaN").otherwise(F.col("mean").cast("string")).alias("mean"), F.col("n").alias("sampleCount"), F.when(F.col("month") == 2, F.col("n")).otherwise(F.lit(0)).alias("noDataCount"))
    nested = functools.reduce(lambda c, name: F.struct(c.alias(name)), ("stats", "B0", "bands", "default"), stats)
    entry = F.struct(F.struct(F.concat(F.expr(_MONTH).cast("string"), F.lit("T00:00:00Z")).alias("from")).alias("interval"), nested.alias("outputs"))
    sent = rows.groupBy("district", "year").agg(F.collect_list(entry).alias("data")).drop("year")
    got = climate.ndvi_stats_json(spark, _lines(spark, sent, "stats"))
    return got.select("district", "date", "ndvi", "valid_pixels")


_RAINS = "SELECT year, SUM(CASE WHEN month = 6 THEN rainfall_mm END) AS jun, SUM(CASE WHEN month = 7 THEN rainfall_mm END) AS jul, SUM(CASE WHEN month = 8 THEN rainfall_mm END) AS aug, SUM(CASE WHEN month = 9 THEN rainfall_mm END) AS sep, SUM(CASE WHEN month BETWEEN 6 AND 9 THEN rainfall_mm END) AS jun_sep FROM rainfall GROUP BY year"
_SUMS = ("jun", "jul", "aug", "sep", "jun_sep")


@registry.register("src_monsoon_json", views.cte("SELECT year, " + ", ".join(f"{r(c, 2)} AS {c}" for c in _SUMS) + f" FROM ({_RAINS}) t"))
def src_monsoon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly series, numbers partly as text, in order of year."""
    rows = views.run(spark, sf_dir, _RAINS)
    sent = rows.select(F.array(F.struct(F.col("year").cast("string").alias("year"), *[F.col(c).cast("string" if c == "jul" else "double").alias(c) for c in _SUMS])).alias("records"))
    return climate.monsoon_json(spark, _lines(spark, sent, "series")).select("year", *[F.expr(r(c, 2)).alias(c) for c in _SUMS])


@registry.register("sink_canonical_csv", _oracle())
def sink_canonical_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical columns written as CSV, and read again."""
    return _shown(prices.canonical_csv(spark, prices.written_canonical(_prices(spark, sf_dir))))


@registry.register("sink_results", views.cte(f"SELECT CASE WHEN year(arrival_date) < 1998 THEN 'early' ELSE 'late' END AS run, commodity, COUNT(*) AS n, {r('AVG(price)')} AS mean_price FROM daily GROUP BY 1, 2"))
def sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended to a history, one of them twice, exported as JSON lines and read again."""
    rows = views.run(spark, sf_dir, "SELECT commodity, arrival_date, price FROM daily")
    table, out = folder(spark, "history"), folder(spark, "export")
    for run, own in (("early", F.year("arrival_date") < 1998), ("late", F.year("arrival_date") >= 1998), ("early", F.year("arrival_date") < 1998)):
        results.append_results(rows.filter(own), table, run)
    results.export(results.results(spark, table), out)
    again = spark.read.schema("commodity string, arrival_date date, price double, run string").json(out)
    return again.groupBy("run", "commodity").agg(F.count("*").alias("n"), F.expr(r("AVG(price)")).alias("mean_price"))
