"""Raw dates by shape and type, and streams that sort, count and sum what arrives in many batches."""

import datetime
import time

from pyspark.sql import functions as F

from graintide.functions import dates
from graintide.shared import folder
from graintide.streaming import events, guard

DAY = datetime.date(2026, 9, 12)


def today():
    return F.lit("2026-09-30").cast("date")


def test_shapes_of_dates(spark):
    good = ["2026-09-12", "12/09/2026", "12-09-2026", "12.09.2026", "2026/09/12", "12/09/26", "12-Sep-2026", "12 sep  2026", "Sep 12, 2026", "20260912", "20260912.0", " 2026-09-12T10:00:00 ", "2026-09-12 00:00:00+05:30", "12/9/2026"]
    bad = {"31/02/2026": "unparseable", "12/09/69": "impossible", "12/09/68": "future", "2026-13-01": "unparseable", "1700000000": "unparseable", "NaN": "missing", " - ": "missing", None: "missing", "1989-12-31": "impossible", "2026-10-02": "future"}
    rows = [(x,) for x in [*good, *bad, "2026-10-01"]]
    got = {r.raw: (r.day, r.status) for r in dates.classified(spark.createDataFrame(rows, "raw string"), "raw", today()).collect()}
    assert all(got[x] == (DAY, "ok") for x in good)
    assert {k: got[k] for k in bad} == {k: (None, v) for k, v in bad.items()}
    assert got["2026-10-01"] == (datetime.date(2026, 10, 1), "ok")


def test_numbers_and_dates_by_type(spark):
    seconds = 1789171200  # 2026-09-12
    rows = [(float(seconds),), (float(seconds) * 1000,), (20260912.0,), (12.5,), (None,), (float("nan"),)]
    got = [(r.day, r.status) for r in dates.classified(spark.createDataFrame(rows, "raw double"), "raw", today()).collect()]
    assert got == [(DAY, "ok")] * 3 + [(None, "unparseable"), (None, "missing"), (None, "missing")]
    assert dates.classified(spark.createDataFrame([(DAY,)], "raw date"), "raw", today()).first().day == DAY


def write(spark, place, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    time.sleep(0.01)


def test_guard_equals_its_batch_twin_and_replays(spark):
    place, base = folder(spark, "in"), folder(spark, "guard")
    lots = [[("a", "2026-09-01"), ("b", "2099-01-01")], [("c", "old"), ("d", None)], [("e", "1999-01-01"), ("f", "12/09/26")]]
    for lot in lots:
        write(spark, place, lot, "id string, raw string")
    judge = lambda rows: dates.classified(rows, "raw", today())
    run = lambda: guard.guarded(spark, spark.readStream.schema("id string, raw string").option("maxFilesPerTrigger", 1).parquet(place), judge, base)
    for k in range(2):
        sinks = run()
        assert sorted(r.id for r in sinks.accepted.collect()) == [["a", "e", "f"], ["a", "e", "f", "g"]][k]
        if k == 0:
            assert {r.id: r.status for r in sinks.quarantined.collect()} == {"b": "future", "c": "unparseable", "d": "missing"}
            assert {r.status: r.n for r in sinks.counts.groupBy("status").agg(F.sum("n").alias("n")).collect()} == {"ok": 3, "future": 1, "unparseable": 1, "missing": 1}
            write(spark, place, [("g", "2001-01-01")], "id string, raw string")


def test_late_parts_add_to_closed_windows(spark):
    place, base = folder(spark, "events"), folder(spark, "volume")
    at = lambda h, m: datetime.datetime(2024, 1, 5, h, m)
    lots = [[(1, at(1, 5), "x"), (2, at(9, 0), "x")], [(3, at(9, 59), "x"), (4, at(23, 0), "y")], [(5, at(1, 59), "x")]]
    schema = "event_id long, ts timestamp_ntz, event_type string"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
    want = {}
    for lot in lots:
        write(spark, place, lot, schema)
        for _, ts, kind in lot:
            want[ts.replace(minute=0), kind] = want.get((ts.replace(minute=0), kind), 0) + 1
        got = events.volume_by_parts(spark, read(), base=base)
        assert {(r.window_start, r.event_type): r.n for r in got.collect()} == want
        events.merge_parts(spark, base)
        assert {(r.window_start, r.event_type): r.n for r in events.summed_parts(spark, base).collect()} == want
