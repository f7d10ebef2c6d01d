"""Backfill and the wide report on small rows."""

import datetime

from pyspark.sql import functions as F

from graintide.plans import reports
from graintide.shared import folder

KEY = "state string, district string, market string, commodity string, variety string, grade string, arrival_date date, min_price double, max_price double, modal_price double"


def row(day):
    return ("s", "d", "m", "c", None, None, day, 1.0, 2.0, 1.5)


def test_backfill_walks_to_the_floor_and_runs_again(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(30 * k) for k in range(30)]
    archive = spark.createDataFrame([row(d) for d in days + days[:5]], KEY).withColumn("year", F.year("arrival_date"))
    table = spark.createDataFrame([row(days[20])], KEY)
    out, floor, today = folder(spark, "backfill"), days[3], datetime.date(2003, 1, 1)
    for _ in range(2):
        found = sorted(x.arrival_date for x in reports.backfill(table, archive, out, floor, 45, today).collect())
        assert found == days[3:20]
    assert reports.backfill(spark.createDataFrame([row(floor)], KEY), archive, folder(spark), floor, 45, today).count() == 0
    assert reports.backfill(table.limit(0), archive, folder(spark), floor, 400, today).count() == 27


def test_report_names_what_is_missing(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "commodity string, p double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "commodity string, q double")
    found = {x.commodity: (x.p, x.q, x.available, x.missing, x.headline) for x in reports.report({"one": a, "two": b}).collect()}
    assert found == {"x": (1.0, None, "one", "two", "x: one"), "y": (2.0, 3.0, "one,two", "", "y: one,two"), "z": (None, 4.0, "two", "one", "z: two")}
