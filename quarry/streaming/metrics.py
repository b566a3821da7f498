"""Streaming metrics with keyed state: accuracy, smoothed accuracy, drift, anomalies.

One state row per key; :func:`fold` is the kernel, used by the stream and by
batch tests alike, so both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, n long, accuracy double, smoothed double, drift string, anomaly boolean, window long"
STATE = "n long, correct long, smoothed double, p_min double, s_min double, mean double, m2 double, ph_sum double, ph_min double, window long"
ALPHA, BASE, LOW, HIGH = 0.1, 1000, 100, 10000


@dataclass
class State:
    n: int = 0
    correct: int = 0
    smoothed: float = 0.0
    p_min: float = float("inf")
    s_min: float = float("inf")
    mean: float = 0.0
    m2: float = 0.0
    ph_sum: float = 0.0
    ph_min: float = 0.0
    window: int = BASE


def step(s: State, truth: float, predicted: float, delta: float = 0.005, threshold: float = 50.0) -> tuple[str, bool]:
    """Update the state with one observation; (drift level, anomaly).

    Drift: the drift detection method on the error rate (warning at two, drift at three deviations above
    its minimum, from 30 rows on) or the Page-Hinkley test on the error. Anomaly: |z| > 3 of the absolute
    error, from 10 rows on, the row included.
    """
    error = abs(truth - predicted)
    right = error < 0.001
    s.n += 1
    s.correct += right
    s.smoothed = float(right) if s.n == 1 else ALPHA * right + (1 - ALPHA) * s.smoothed
    p = 1 - s.correct / s.n
    sd = math.sqrt(p * (1 - p) / s.n)
    level = "none"
    if s.n >= 30:
        if p + sd < s.p_min + s.s_min:
            s.p_min, s.s_min = p, sd
        if p + sd > s.p_min + 3 * s.s_min:
            level = "drift"
        elif p + sd > s.p_min + 2 * s.s_min:
            level = "warning"
    d = error - s.mean
    s.mean += d / s.n
    s.m2 += d * (error - s.mean)
    s.ph_sum += error - s.mean - delta
    s.ph_min = min(s.ph_min, s.ph_sum)
    if s.ph_sum - s.ph_min > threshold:
        level, s.ph_sum, s.ph_min = "drift", 0.0, 0.0
    std = math.sqrt(s.m2 / (s.n - 1)) if s.n > 1 else 0.0
    odd = s.n >= 10 and std > 0 and abs(error - s.mean) / std > 3
    acc = s.correct / s.n
    factor = 0.7 if level == "drift" else 0.9 if odd else 0.8 if acc < 0.6 else 1.2 if acc > 0.9 else 1.0
    s.window = int(min(max(s.window * factor, LOW), HIGH))
    return level, bool(odd)


def fold(rows: Iterator[tuple[float, float]], s: State) -> tuple[str, bool]:
    """The worst drift level and whether there was an anomaly, over rows in order."""
    worst, odd, order = "none", False, ("none", "warning", "drift")
    for t, p in rows:
        level, o = step(s, t, p)
        worst, odd = max(worst, level, key=order.index), odd or o
    return worst, odd


def online_metrics(df: DataFrame, key: str, order: str, truth: str, predicted: str) -> DataFrame:
    """One row per key and micro-batch with the metrics so far; df is a stream."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = State(*state.get) if state.exists else State()
        rows = pd.concat(list(pdfs)).sort_values(order)
        level, odd = fold(zip(rows[truth].astype(float), rows[predicted].astype(float)), s)
        state.update(astuple(s))
        yield pd.DataFrame({"key": [str(k[0])], "n": [s.n], "accuracy": [s.correct / s.n], "smoothed": [s.smoothed], "drift": [level], "anomaly": [odd], "window": [s.window]})

    return df.select(key, order, truth, predicted).groupBy(key).applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
