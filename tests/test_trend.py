"""The smoothed trend against a dense solution of the same model, and on drawn series."""

import math

import numpy as np
import pandas as pd
import pytest

from graintide.functions import trend
from graintide.plans.series import kalman_days, nowcast_days

SF = "/root/testdata/sf0.001"


def dense(y, obs, level, slope):
    """Mean, covariance and log likelihood of all states at once, from the joint normal distribution."""
    n, first = len(y), next(v for v in y if v == v)
    wide = max(level**2, slope**2, 1e-8)
    move = np.array([[1.0, 1.0], [0.0, 1.0]])
    mean, cov = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    mean[0], own = first, np.eye(2) * wide
    for t in range(n):
        if t:
            mean[2 * t : 2 * t + 2] = move @ mean[2 * t - 2 : 2 * t]
            own = move @ own @ move.T + np.diag([level**2, slope**2])
        cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] = own
        link = own
        for u in range(t + 1, n):
            link = move @ link
            cov[2 * u : 2 * u + 2, 2 * t : 2 * t + 2] = link
            cov[2 * t : 2 * t + 2, 2 * u : 2 * u + 2] = link.T
    seen = [2 * t for t in range(n) if y[t] == y[t]]
    inner = cov[np.ix_(seen, seen)] + obs**2 * np.eye(len(seen))
    miss = np.array([y[k // 2] - mean[k] for k in seen])
    gain = cov[:, seen] @ np.linalg.inv(inner)
    fit = -0.5 * (len(seen) * math.log(2 * math.pi) + np.linalg.slogdet(inner)[1] + miss @ np.linalg.solve(inner, miss))
    return (mean + gain @ miss).reshape(n, 2), cov - gain @ cov[seen], fit


@pytest.mark.parametrize("gaps", [[], [3, 4, 9], [0, 1, 17]])
def test_smoother_equals_the_dense_solution(gaps):
    rng = np.random.default_rng(2)
    y = 50 + 0.5 * np.arange(18) + rng.normal(0, 2, 18)
    y[gaps] = np.nan
    got = trend.smoothed(y.tolist(), 2.0, 0.7, 0.1)
    states, cov, fit = dense(y.tolist(), 2.0, 0.7, 0.1)
    assert got.states == pytest.approx(states, rel=1e-6, abs=1e-7) and got.fit == pytest.approx(fit)
    assert got.covs == pytest.approx(np.stack([cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] for t in range(18)]), abs=1e-7)


def test_search_finds_a_known_least_point():
    got = trend.simplex_minimum(lambda x: (x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2 + (x[2] - x[0]) ** 2, [0.0, 0.0, 0.0], close=1e-6)
    assert got == pytest.approx([1, -2, 1], abs=1e-2)


def test_smoothing_beats_raw_noise_and_the_first_guess():
    rng = np.random.default_rng(13)
    truth = 100 + 0.3 * np.arange(120) + rng.normal(0, 0.5, 120)
    seen = truth + rng.normal(0, 2.0, 120)
    fit = trend.fitted(seen)
    error = lambda x: math.sqrt(((x - truth) ** 2).mean())
    assert error(fit.states[:, 0]) < 0.6 * error(seen)
    scale = float(np.std(seen))
    assert fit.fit > trend.log_likelihood(seen.tolist(), scale * 0.5, scale * 0.05, scale * 0.005)
    assert trend.fitted(seen[:29]) is None and trend.fitted(np.full(60, 3.0)) is None


def test_months_end_of_an_incomplete_month():
    days = pd.date_range("2026-05-01", periods=51).date
    row = nowcast_days(("c",), pd.DataFrame({"day": days, "price": 95.0 + 0.1 * np.arange(51)})).iloc[0]
    assert (row["days_remaining"], row["observed_days"], row["days_in_month"], row["completion_pct"]) == (10, 20, 30, pytest.approx(66.6667, abs=1e-3))
    assert row["nowcast"] == pytest.approx(101, abs=0.5) and row["low"] <= row["nowcast"] <= row["high"]


def test_gaps_widen_the_band():
    rng = np.random.default_rng(5)
    price = 100 + np.cumsum(rng.normal(0, 1, 90)) + rng.normal(0, 1, 90)
    pdf = pd.DataFrame({"day": pd.date_range("2026-01-01", periods=90).date, "price": price})
    got = kalman_days(("c",), pdf.drop(index=range(40, 60)))
    assert len(got) == 90 and got["n_days"].iloc[0] == 70
    assert got["level_sd"].iloc[50] > 1.5 * got["level_sd"].iloc[20]


def test_queries_over_the_given_days(spark):
    from graintide import registry

    rows = registry.queries()["kalman_trend"](spark, SF).toPandas()
    last = registry.queries()["nowcast_month_end"](spark, SF).toPandas()
    assert set(rows["commodity"]) == set(last["commodity"]) and (rows["level_sd"] >= 0).all() and len(last)
    assert (last["low"] <= last["nowcast"]).all() and (last["completion_pct"] <= 100).all()
