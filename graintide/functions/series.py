"""Sequential rules over one key's series: online steps, and the fits that need the series in order.

A series is one commodity's days or months, so it is short whatever the table's
size; Spark deals the keys out.  The three online rules are written as one step on a
small state, which the batch queries fold over a series and the streams keep.
"""

from __future__ import annotations

import numpy as np


def conformal_quantile(scores: np.ndarray, alpha: float) -> float:
    """Order statistic of the scores at the level corrected for their number."""
    m = len(scores)
    level = min(1.0, np.ceil((m + 1) * (1 - alpha)) / m)
    return float(np.sort(scores)[int(np.ceil((m - 1) * level))])


def page_hinkley_step(state: dict, z: float, _: float, delta: float = 0.005, threshold: float = 25.0) -> tuple[float, float, float]:
    """(alarm up, alarm down, excess) after one standardised value; an alarm starts that side anew."""
    out = []
    for side, sign in (("up", 1.0), ("down", -1.0)):
        total, least = state.get(side, (0.0, 0.0))
        total += sign * z - delta
        least = min(least, total)
        out.append((float(total - least > threshold), total - least))
        state[side] = (0.0, 0.0) if total - least > threshold else (total, least)
    return out[0][0], out[1][0], max(out[0][1], out[1][1])


def ewma_step(state: dict, z: float, _: float, lam: float = 0.2, limit: float = 3.0) -> tuple[float, float, float]:
    """(mean, beyond its control limit, limit) after one standardised value; the first value starts the mean."""
    state["mean"] = z if "mean" not in state else lam * z + (1 - lam) * state["mean"]
    edge = limit * np.sqrt(lam / (2 - lam))
    return state["mean"], float(abs(state["mean"]) > edge), float(edge)


def adaptive_conformal_step(state: dict, y: float, guess: float, alpha: float = 0.1, gamma: float = 0.02, window: int = 60, warm: int = 5) -> tuple[float, float, float]:
    """(low, high, alpha) of the interval before the value was known; the working alpha moves by whether it was missed."""
    own, scores = state.setdefault("alpha", alpha), state.setdefault("scores", [])
    out = (np.nan, np.nan, np.nan)
    if len(scores) >= warm:
        half = conformal_quantile(np.array(scores), own)
        out = (guess - half, guess + half, own)
        missed = 0.0 if out[0] <= y <= out[1] else 1.0
        state["alpha"] = float(np.clip(own + gamma * (alpha - missed), 0.001, 0.5))
    state["scores"] = [*scores, abs(y - guess)][-window:]
    return out


STEPS = {"page_hinkley": page_hinkley_step, "ewma": ewma_step, "adaptive_conformal": adaptive_conformal_step}


def holt(y: np.ndarray, alpha: float, beta: float = 0.3, ahead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One-step guesses of y by level and trend, and guesses ahead."""
    level, trend = y[0], (y[-1] - y[0]) / len(y)
    guesses = np.empty(len(y))
    for t, v in enumerate(y):
        guesses[t] = level + trend
        new = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return guesses, level + trend * np.arange(1, ahead + 1)


def seasonal_design(t: np.ndarray, month: np.ndarray, waves: int = 3) -> np.ndarray:
    """Constant, trend and yearly waves."""
    turns = [f(2 * np.pi * k * month / 12) for k in range(1, waves + 1) for f in (np.sin, np.cos)]
    return np.stack([np.ones(len(t)), t / 12.0, *turns], 1)
