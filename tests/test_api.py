"""Queries over hand-made tables, and estimates against weighted least squares."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graintide import api


def fit(x, y, cutoff, width, kernel, order):
    """Difference of the two sides' weighted polynomials at the cutoff."""
    h = width * (x.max() - x.min()) / 100
    u = (x - cutoff) / h
    out = []
    for side in (u < 0, u >= 0):
        own = side & (abs(u) <= 1)
        w = {"triangular": 1 - abs(u), "uniform": np.ones(len(u)), "epanechnikov": 0.75 * (1 - u * u)}[kernel][own]
        design = np.stack([u[own] ** k for k in range(order + 1)], 1)
        out.append(np.linalg.lstsq(design * np.sqrt(w)[:, None], y[own] * np.sqrt(w), rcond=None)[0][0])
    return out[1] - out[0]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-60, 60, 800)
    pdf = pd.DataFrame({"item": "a", "rain": x, "cost": 50 + 0.2 * x + 8 * (x < -5) + rng.normal(0, 1, 800)})
    few = pd.DataFrame({"item": "few", "rain": [1.0, 2.0, np.nan], "cost": [1.0, 2.0, 3.0]})
    return pdf, spark.createDataFrame(pd.concat([pdf, few]))


def test_cutoff_bandwidth_kernel_and_order(points):
    pdf, df = points
    x, y = pdf["rain"].to_numpy(), pdf["cost"].to_numpy()
    for kernel, order, width in (("triangular", 1, 20), ("uniform", 0, 30), ("epanechnikov", 2, 40)):
        row, = api.rdd_local(df, -5.0, width, kernel, order, "rain", "cost", "item").collect()
        assert row.effect == pytest.approx(fit(x, y, -5.0, width, kernel, order), rel=1e-6) and row.commodity == "a"
    assert api.rdd_local(df, -5.0, 20, x="rain", y="cost", by=None).first().p_value < 1e-6


def test_specifications_and_placebos(points):
    pdf, df = points
    rows = api.rdd_specifications(df, -5.0, (20, 30), ("uniform",), (1, 2), "rain", "cost", "item").collect()
    assert len(rows) == 4 and all(abs(r.effect + 8) < 1.5 for r in rows)
    others = api.rdd_placebo(df, [-30.0, -4.0, 25.0], -5.0, 2.0, 20, "triangular", "rain", "cost", "item").collect()
    assert {r.label for r in others} == {"-30.0", "25.0"} and all(abs(r.effect) < 2 for r in others)
    for wrong in ({"bandwidth": 0}, {"order": 3}, {"kernel": "box"}):
        with pytest.raises(ValueError):
            api.rdd_local(df, **wrong, x="rain", y="cost", by="item")


def prices(spark, rows):
    return spark.createDataFrame([("s", d, "m", c, "v", None, day, p, p, p) for d, c, day, p in rows], "state string, district string, market string, commodity string, variety string, grade string, arrival_date date, min_price double, max_price double, modal_price double")


def test_texts_over_the_callers_tables(spark):
    day = lambda n: datetime.date(2026, 1, n)
    df = prices(spark, [("d1", "rice", day(1), 100.0), ("d1", "rice", day(2), 50.0), ("d2", "rice", day(3), 80.0), ("d1", "rice", day(3), 60.0), ("d1", "rice", day(3), 40.0), ("d1", "corn", day(1), 7.0)])
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.district: r for r in api.run("price_movers", prices=df.filter("commodity = 'rice'")).collect()}
    assert {k: (r.price, r.low, r.high, r.n_districts, r.median_price, r.spread, r.day) for k, r in got.items()} == {"d1": (60.0, 1, 2, 2, 70.0, 20.0, day(3)), "d2": (80.0, 2, 1, 2, 70.0, 20.0, day(3))}
    row, = api.run("running_max_drawdown", prices=df.filter("commodity = 'rice'")).collect()
    assert (row.max_drawdown_pct, row.trough_index, row.peak_index, row.peak_date) == (-50.0, 1, 0, day(1))
    assert api.run("health_status", today="2026-01-04", prices=df).first().status == "healthy" and api.run("health_status", today="2026-02-01", prices=df).first().status == "stale"
    assert {t.name for t in spark.catalog.listTables()} == before
    rain = spark.createDataFrame([("x", 2025, 7, 10.0, 10.0, 0.0), ("x", 2026, 7, 5.0, 10.0, -50.0)], "sub_division string, year int, month int, rainfall_mm double, normal_mm double, departure_pct double")
    assert {(r.year, r.share, r.overall_share, r.long_run_mean) for r in api.run("deficit_exposure", rainfall=rain).collect()} == {(2025, 0.0, 0.5, 0.5), (2026, 1.0, 0.5, 0.5)}
    row = api.run("monsoon_baseline", rainfall=rain).first()
    assert (row.driest, row.wettest, row.last_year, row.last_mm) == (2026, 2025, 2026, 5.0)


def test_panel_from_three_tables(spark):
    day = datetime.date(2026, 7, 1)
    rain = spark.createDataFrame([("x", 2026, 7, 5.0, 10.0, -50.0)], "sub_division string, year int, month int, rainfall_mm double, normal_mm double, departure_pct double")
    where = spark.createDataFrame([("s", "d1", "x")], "state string, district string, sub_division string")
    got = api.run("panel_join", prices=prices(spark, [("d1", "rice", day, 10.0), ("d1", "rice", day, 20.0), ("d1", "rice", day, 30.0), ("d2", "rice", day, 1.0)]), rainfall=rain, district_map=where).collect()
    assert [(r.district, r.n, r.avg_price) for r in got] == [("d1", 3, 20.0)]
    with pytest.raises(ValueError):
        api.run("panel_join", rainfall=rain)
    with pytest.raises(ValueError):
        api.run("panel_join", weather=rain)
    with pytest.raises(KeyError):
        api.run("no such key", rainfall=rain)
    assert len(api.names()) > 90


def test_rolling_prices(spark):
    df = prices(spark, [("d1", "rice", datetime.date(2026, 1, n), float(n)) for n in range(1, 6)])
    got = {r.arrival_date.day: (r.rolling_avg, r.rows_in_window) for r in api.rolling_prices(df, 3).collect()}
    assert got == {1: (1.0, 1), 2: (1.5, 2), 3: (2.0, 3), 4: (3.0, 3), 5: (4.0, 3)}
    with pytest.raises(ValueError):
        api.rolling_prices(df, 0)
