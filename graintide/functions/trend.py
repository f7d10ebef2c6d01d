"""A local linear trend with missing days: likelihood, simplex search of its deviations, smoothing and projection.

Level and slope are two states; the level moves by the slope and a step of its own, the
slope by a step.  Their means and covariances are kept as scalars, since a series is one
key's days.  Days without a price (NaN) skip the update, so the variance widens there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

#: Observed days that a fit needs.
LEAST = 30


def simplex_minimum(f: Callable[[Sequence[float]], float], start: Sequence[float], step: float = 0.5, most: int = 300, close: float = 1e-4) -> list[float]:
    """The least point that a simplex search finds: reflect, expand, contract, or shrink towards the best corner.

    It ends when corners lie within ``close`` of the best and their values do too, or after ``most`` turns.
    """
    corners = [list(start)] + [[x + step * (i == k) for i, x in enumerate(start)] for k in range(len(start))]
    known = sorted(((f(x), x) for x in corners), key=lambda c: c[0])
    for _ in range(most):
        best, worst = known[0], known[-1]
        if worst[0] - best[0] <= close and max(abs(a - b) for _, x in known[1:] for a, b in zip(x, best[1], strict=True)) <= close:
            break
        rest = [x for _, x in known[:-1]]
        middle = [sum(c) / len(rest) for c in zip(*rest, strict=True)]

        def along(t: float, middle=middle, worst=worst) -> tuple[float, list[float]]:
            x = [m + t * (w - m) for m, w in zip(middle, worst[1], strict=True)]
            return f(x), x

        new = along(-1.0)
        if new[0] < best[0]:
            new = min(new, along(-2.0), key=lambda c: c[0])
        elif new[0] >= known[-2][0]:
            inner = along(-0.5) if new[0] < worst[0] else along(0.5)
            new = inner if inner[0] < min(new[0], worst[0]) else None
        if new is None:
            shrunk = [[b + 0.5 * (a - b) for a, b in zip(x, best[1], strict=True)] for _, x in known[1:]]
            known = [best, *((f(x), x) for x in shrunk)]
        else:
            known[-1] = new
        known.sort(key=lambda c: c[0])
    return known[0][1]


def _start(y: Sequence[float], level: float, slope: float) -> tuple[float, float, float, float, float]:
    wide = max(level * level, slope * slope, 1e-8)
    return next(v for v in y if v == v), 0.0, wide, 0.0, wide


def log_likelihood(y: Sequence[float], obs: float, level: float, slope: float) -> float:
    """Of the observed days under the three standard deviations."""
    m, s, a, b, c = _start(y, level, slope)
    noise, step, turn, total = obs * obs, level * level, slope * slope, 0.0
    for v in y:
        if v == v:
            f, miss = a + noise, v - m
            k0, k1 = a / f, b / f
            m, s = m + k0 * miss, s + k1 * miss
            a, b, c = a - k0 * a, b - k0 * b, c - k1 * b
            total -= 0.5 * (math.log(2 * math.pi * f) + miss * miss / f)
        m, a, b, c = m + s, a + 2 * b + c + step, b + c, c + turn
    return total


@dataclass
class Trend:
    """Smoothed level and slope of each day (n x 2), their covariances (n x 2 x 2), deviations and log likelihood."""

    states: np.ndarray
    covs: np.ndarray
    obs: float
    level: float
    slope: float
    fit: float


def smoothed(y: Sequence[float], obs: float, level: float, slope: float) -> Trend:
    """Forward filter, then the backward pass that hands each day what the later ones tell."""
    n, move, noise = len(y), np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level * level, slope * slope])
    m, s, a, b, c = _start(y, level, slope)
    mean, cov = np.array([m, s]), np.array([[a, b], [b, c]])
    before, before_cov, after, after_cov = np.empty((n, 2)), np.empty((n, 2, 2)), np.empty((n, 2)), np.empty((n, 2, 2))
    for t, v in enumerate(y):
        before[t], before_cov[t] = mean, cov
        if v == v:
            gain = cov[:, 0] / (cov[0, 0] + obs * obs)
            mean, cov = mean + gain * (v - mean[0]), cov - np.outer(gain, cov[0])
        after[t], after_cov[t] = mean, cov
        mean, cov = move @ mean, move @ cov @ move.T + noise
    states, covs = after.copy(), after_cov.copy()
    for t in range(n - 2, -1, -1):
        gain = after_cov[t] @ move.T @ np.linalg.pinv(before_cov[t + 1])
        states[t] += gain @ (states[t + 1] - before[t + 1])
        covs[t] += gain @ (covs[t + 1] - before_cov[t + 1]) @ gain.T
    return Trend(states, covs, obs, level, slope, log_likelihood(y, obs, level, slope))


def fitted(y: np.ndarray) -> Trend | None:
    """The trend at the likeliest deviations; None below LEAST observed days or without variation."""
    seen = y[~np.isnan(y)]
    scale = float(np.std(seen)) if len(seen) >= LEAST else 0.0
    if scale <= 0:
        return None
    days = y.tolist()
    start = [math.log(scale * share) for share in (0.5, 0.05, 0.005)]
    found = simplex_minimum(lambda x: -log_likelihood(days, *(math.exp(max(-40.0, min(40.0, v))) for v in x)), start)
    return smoothed(days, *map(math.exp, found))


def projected(trend: Trend, days: int, confidence: float = 0.9) -> tuple[float, float, float]:
    """Level ``days`` after the last one, and its band: the last state's covariance carried on, and the slope's steps between."""
    (level, slope), cov = trend.states[-1], trend.covs[-1]
    variance = cov[0, 0] + 2 * days * cov[0, 1] + days**2 * cov[1, 1] + days**3 * trend.slope**2 / 3
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * math.sqrt(max(variance, 0.0))
    guess = level + days * slope
    return guess, guess - half, guess + half
