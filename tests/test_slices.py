"""Windows over cut groups against plain windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graintide import slices

CELLS = {"mean": lambda w: F.avg("x").over(w), "least": lambda w: F.min("x").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}


def frame(spark):
    """One group with nine tenths of the rows, a day with many of them, null keys and null days."""
    rng = np.random.default_rng(4)
    day = np.where(rng.random(3000) < 0.3, 77, rng.integers(0, 200, 3000))
    rows = [("hot" if k % 10 else ("b", None)[k % 20 == 0], int(d) if k % 61 else None, k, float(rng.integers(0, 50))) for k, d in enumerate(day)]
    return spark.createDataFrame(rows, "k string, day int, id int, x double")


@pytest.mark.parametrize("size", [60, 300, 10_000])
def test_equal_to_the_plain_window(spark, size):
    df = frame(spark)
    plain = Window.partitionBy("k").orderBy("day", "x", "id").rowsBetween(-29, 0)
    want = sorted(map(str, df.withColumns({c: f(plain) for c, f in CELLS.items()}).collect()))
    assert sorted(map(str, slices.rolling(df, ["k"], ["day", "x", "id"], 29, CELLS, size).collect())) == want


def test_slices_are_bounded_and_filled(spark):
    df = frame(spark)
    parts = slices.sliced(df, ["k"], "day", 300)
    rows = [r for r in parts.groupBy("k", "_slice", "_last").agg(F.count("*").alias("n"), F.count_if(F.col("day") == 77).alias("heap")).collect()]
    assert all(r.n - r.heap <= 700 for r in rows) and all(r.n >= 150 for r in rows if r._slice < r._last)
    assert {r.k: r._last > 0 for r in rows} == {"hot": True, "b": False, None: False}


def test_empty_and_one_row(spark):
    df = frame(spark)
    assert slices.rolling(df.limit(0), ["k"], ["day", "id"], 3, CELLS, 60).collect() == []
    assert slices.rolling(df.limit(1), ["k"], ["day", "id"], 3, CELLS, 60).first()["n"] == 1
