"""Date rules on small rows, and a stream against its batch twin."""

import datetime

from pyspark.sql import functions as F

from graintide.functions import dates
from graintide.streaming import events

SF = "/root/testdata/sf0.001"


def test_date_status_and_formats(spark):
    rows = [("2026-09-12",), ("12/09/2026",), ("2026-09-12T10:00:00",), ("12 Sep 2026",), ("2099-12-09",), ("",), ("nan",), (None,), ("not-a-date",), ("1899-01-01",), ("2026-10-01",)]
    today = F.lit("2026-09-30").cast("date")
    frame = spark.createDataFrame(rows, "raw string").select("raw", dates.parse_date(F.col("raw")).alias("day"), dates.date_status(F.col("raw"), today).alias("status"))
    found = {row.raw: (row.day, row.status) for row in frame.collect()}
    day = datetime.date(2026, 9, 12)
    for raw in ("2026-09-12", "12/09/2026", "2026-09-12T10:00:00", "12 Sep 2026"):
        assert found[raw] == (day, "ok")
    assert [found[k][1] for k in ("2099-12-09", "", "nan", None, "not-a-date", "1899-01-01", "2026-10-01")] == ["future", "missing", "missing", "missing", "unparseable", "impossible", "ok"]


def test_swap_month_day(spark):
    rows = [(datetime.date(2026, 12, 9),), (datetime.date(2026, 9, 24),), (None,)]
    frame = spark.createDataFrame(rows, "d date").select(dates.swap_month_day(F.col("d")).alias("s"))
    assert [row.s for row in frame.collect()] == [datetime.date(2026, 9, 12), None, None]


def test_stream_equals_batch(spark):
    streamed = events.run_available(spark, events.tumbling_volume(events.source(spark, SF)))
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
