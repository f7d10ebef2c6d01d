"""Correlations where every sub-division has the same frequency of deficits, and where they differ."""

import math

import numpy as np
import pytest

from graintide import api, views
from graintide.plans import monitoring, relational

PLACES = [(f"s{k}", f"d{k}", f"sub{k}") for k in range(9)]


def found(spark, key, freq):
    """The one row of a key over nine districts; the k-th has freq[k] of ten months in deficit and price 100 + k * k."""
    prices = spark.createDataFrame([("rice", s, d, 100.0 + k * k) for k, (s, d, _) in enumerate(PLACES)], "commodity string, state string, district string, modal_price double")
    rain = spark.createDataFrame([(sub, -50.0 if m < n else 0.0) for (_, _, sub), n in zip(PLACES, freq, strict=True) for m in range(10)], "sub_division string, departure_pct double")
    places = spark.createDataFrame(PLACES, "state string, district string, sub_division string")
    row, = api.run(key, prices=prices, rainfall=rain, district_map=places).collect()
    return row


@pytest.mark.parametrize("key, column", [("deficit_price_correlation", "pearson_r"), ("left_deficit_freq", "pearson")])
def test_constant_frequency_has_no_correlation(spark, key, column):
    assert math.isnan(found(spark, key, [3] * 9)[column])
    freq = [3, 1, 4, 1, 5, 9, 2, 6, 5]
    assert found(spark, key, freq)[column] == pytest.approx(np.corrcoef([100 + k * k for k in range(9)], freq)[0, 1], abs=1e-4)


def test_oracles_keep_their_text():
    from graintide import registry

    known = registry.oracle_sql()
    assert known["left_deficit_freq"] == views.cte(relational.whole(relational.SQL["left_deficit_freq"]))
    assert known["deficit_price_correlation"] == views.cte(monitoring.whole(monitoring.SQL["deficit_price_correlation"]))


def test_scan_rainfall_has_every_month(spark):
    sf = "/root/testdata/sf0.01"
    every = views.run(spark, sf, "SELECT 1 FROM rainfall WHERE departure_pct BETWEEN -100 AND 200 AND sub_division = 'SUBDIV_3'").count()
    from graintide import registry

    assert registry.queries()["scan_rainfall"](spark, sf).count() == every > 60
    assert "LIMIT" not in registry.oracle_sql()["scan_rainfall"]
