"""Dates, numbers and records are parsed once a row, by expressions small enough to compile."""

import datetime
import json

from pyspark.sql import functions as F

from graintide import maintenance
from graintide.functions import dates, text
from graintide.sources import prices


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_date_steps_read_the_text_a_few_times(spark):
    frame = spark.createDataFrame([("05/04/2025",), ("Apr 05, 2025",), ("0x/04/2025",), ("20250405.0",), ("05.04-2025",), ("5/4/69",), ("5/4/68",)], "raw string").coalesce(1)
    days = frame.select(dates.parse_date(F.col("raw")).alias("day"))
    day = datetime.date(2025, 4, 5)
    assert [r.day for r in days.collect()] == [day, day, None, day, None, datetime.date(1969, 4, 5), datetime.date(2068, 4, 5)]
    assert plan(days).count("raw#") <= 8


def test_number_reads_the_text_twice(spark):
    frame = spark.createDataFrame([(" 1,200.5 ",), ("NaN",), ("na",), ("-",), (None,), ("x",)], "raw string").coalesce(1)
    found = frame.select(text.clean_number(F.col("raw")).alias("v"))
    assert [r.v for r in found.collect()] == [1200.5] + [None] * 5
    assert plan(found).count("raw#") <= 4


def test_record_and_its_date_are_parsed_once(spark, tmp_path):
    path = tmp_path / "records.txt"
    path.write_text("".join(json.dumps(r) + "\n" for r in ({"State": "a", "Arrival_Date": "2025-04-05", "Modal_Price": 3}, {"state": "b", "market_name": "m", "arrival_date": "05/04/2099", "modal_price": "1,000"})))
    got = prices.price_json(spark, str(path), F.lit("2025-06-30").cast("date"))
    assert sorted((r.state, r.market, r.arrival_date, r.modal_price) for r in got.collect()) == [("a", None, datetime.date(2025, 4, 5), 3.0), ("b", "m", None, 1000.0)]
    assert plan(got).count("json_tuple(") == 1 and plan(got).count("try_to_timestamp(") + plan(got).count("gettimestamp(") <= 1


def test_batch_date_is_parsed_once(spark):
    rows = spark.createDataFrame([("s", "05 Apr 2025"), ("s", "05 Apr 2099"), ("s", "nan")], "state string, arrival_date string")
    got = maintenance.dated(rows, F.lit("2025-06-30").cast("date"))
    assert [r.arrival_date for r in got.collect()] == [datetime.date(2025, 4, 5)]
    assert plan(got).count("d MMM yyyy") == 1


def test_a_number_is_read_once(spark):
    frame = spark.createDataFrame([("1,234.5",), ("nan",), (" NaN ",), ("",), ("-",), (None,), ("x1",), (" -7 ",), ("none",)], "raw string").coalesce(1)
    numbers = frame.select(text.clean_number(F.col("raw")).alias("number"))
    assert [r.number for r in numbers.collect()] == [1234.5, None, None, None, None, None, None, -7.0, None]
    assert plan(numbers).count("raw#") <= 2
