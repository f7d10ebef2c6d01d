"""Quantiles by narrowing histograms against numpy."""

import numpy as np
import pytest

from graintide import ranks

SHARES = {"p5": 0.05, "p25": 0.25, "mid": 0.5, "p90": 0.9, "most": 1.0}


def want(rows):
    by = {}
    for k, x in rows:
        if x is not None and x == x:
            by.setdefault(k, []).append(x)
    return {k: (len(v), *(float(np.quantile(v, q)) for q in SHARES.values())) for k, v in by.items()}


@pytest.mark.parametrize("small, listed", [(200_000, 512), (0, 3)])
def test_against_numpy(spark, monkeypatch, small, listed):
    monkeypatch.setattr(ranks, "LISTED", listed)
    monkeypatch.setattr(ranks, "BINS", 128)
    rng = np.random.default_rng(8)
    rows = [("hot", float(x)) for x in np.exp(rng.normal(0, 4, 3000))]
    rows += [("ties", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 7.5), ("none", None), ("nan", float("nan")), (None, 1.0), (None, 4.0)]
    rows += [("wide", x) for x in (-1.7e308, -1.0, -0.0, 0.0, 5e-324, 1.7e308)] + [("close", 1.0 + k * 2.0**-52) for k in range(40)]
    got = {r.k: tuple(r)[1:] for r in ranks.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", SHARES, small).collect()}
    expected = want(rows)
    assert set(got) == set(expected)
    for k, row in expected.items():
        assert got[k][0] == row[0]
        if k != "wide":
            assert got[k] == pytest.approx(row, rel=1e-12)
    assert got["wide"][5] == 1.7e308 and got["wide"][3] == 0.0


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "x double")
    assert ranks.quantiles(df, [], "x", {"mid": 0.5, "p75": 0.75}).first()[:] == (100, 50.5, 75.25)
    assert ranks.quantiles(df.filter("x < 0"), [], "x", {"mid": 0.5}).collect() == []
    assert ranks.median(df.withColumn("k", (df.x % 2).cast("int")), ["k"], "x").orderBy("k").collect()[0][:] == (0, 50, 51.0)
