"""Streaming operators with keyed state: history buffers, drift detectors, ensembles, vectorisers and scalers.

Kernels are plain functions over a state and one value, used by the stream and by batch tests alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def history(values: list[float], x: float, size: int = 1000, threshold: float = 3.0) -> tuple[float, float, bool]:
    """Add x to the last ``size`` values; (mean, variance, is x an outlier among those before it: |z| above the threshold, from 10 on)."""
    n = len(values)
    mean = math.fsum(values) / n if n else 0.0
    var = math.fsum((v - mean) ** 2 for v in values) / (n - 1) if n > 1 else 0.0
    odd = n >= 10 and var > 0 and abs(x - mean) > threshold * math.sqrt(var)
    values.append(x)
    del values[:-size]
    m = math.fsum(values) / len(values)
    return m, math.fsum((v - m) ** 2 for v in values) / (len(values) - 1) if len(values) > 1 else 0.0, odd


def adwin(values: list[float], x: float, delta: float = 0.002, size: int = 1000) -> bool:
    """Add x to the window; where two parts of it differ by more than the Hoeffding bound, drop the older one and report drift."""
    values.append(x)
    del values[:-size]
    drift, again = False, True
    while again and len(values) >= 10:
        again = False
        n, total, head = len(values), math.fsum(values), 0.0
        mean = total / n
        var = math.fsum((v - mean) ** 2 for v in values) / n
        log = math.log(2 * math.log(max(n, 3)) / delta)
        for i in range(1, n):
            head += values[i - 1]
            if i < 5 or n - i < 5:
                continue
            m = 1 / (1 / i + 1 / (n - i))
            if abs(head / i - (total - head) / (n - i)) > math.sqrt(2 / m * var * log) + 2 / (3 * m) * log:
                del values[:i]
                drift = again = True
                break
    return drift


def eddm(s: dict, wrong: bool) -> str:
    """Early drift detection by the distance between errors: warning below 0.95, drift below 0.90 of its greatest mean plus two deviations, from 30 errors on."""
    s["t"] = s.get("t", 0) + 1
    if not wrong:
        return "none"
    if "last" not in s:
        s["last"] = s["t"]
        return "none"
    d = s["t"] - s["last"]
    s["last"], s["n"] = s["t"], s.get("n", 0) + 1
    old = s.get("mean", 0.0)
    s["mean"] = old + (d - old) / s["n"]
    s["m2"] = s.get("m2", 0.0) + (d - old) * (d - s["mean"])
    level = s["mean"] + 2 * math.sqrt(s["m2"] / s["n"])
    s["top"] = max(s.get("top", 0.0), level)
    if s["n"] < 30:
        return "none"
    ratio = level / s["top"]
    if ratio < 0.9:
        s.clear()
        return "drift"
    return "warning" if ratio < 0.95 else "none"


def ks_drift(old: list[float], new: list[float], alpha: float = 0.05) -> tuple[float, bool]:
    """Two-sample Kolmogorov-Smirnov distance of two windows, and whether it exceeds the critical value."""
    if not old or not new:
        return 0.0, False
    a, b = sorted(old), sorted(new)
    i = j = 0
    d = 0.0
    while i < len(a) and j < len(b):
        v = min(a[i], b[j])
        while i < len(a) and a[i] == v:
            i += 1
        while j < len(b) and b[j] == v:
            j += 1
        d = max(d, abs(i / len(a) - j / len(b)))
    return d, d > math.sqrt(-0.5 * math.log(alpha / 2)) * math.sqrt((len(a) + len(b)) / (len(a) * len(b)))


def vote(levels: list[str], weights: list[float] | None = None, share: float = 0.5) -> str:
    """The highest level that detectors with at least that share of the weight reach."""
    weights = weights or [1.0] * len(levels)
    rank = {"none": 0, "warning": 1, "drift": 2}
    for level in ("drift", "warning"):
        if sum(w for x, w in zip(levels, weights) if rank[x] >= rank[level]) >= share * sum(weights) > 0:
            return level
    return "none"


HISTORY = "key string, n long, mean double, var double, outliers long, drift boolean"


def history_metrics(df: DataFrame, key: str, order: str, x: str, size: int = 1000) -> DataFrame:
    """A row a key and micro-batch: mean and variance of its last ``size`` values, outliers and ADWIN drift in this batch. A batch's rows of a key are read in the order of ``order`` inside each Arrow batch."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept, window = state.get if state.exists else (0, [], [])
        kept, window = list(kept), list(window)
        m = v = 0.0
        odd, drift = 0, False
        for pdf in pdfs:
            for value in pdf.sort_values(order)[x].astype(float):
                m, v, o = history(kept, value, size)
                drift = adwin(window, value, size=min(size, 200)) or drift
                odd, n = odd + o, n + 1
        state.update((n, kept, window))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "mean": [m], "var": [v], "outliers": [odd], "drift": [drift]})

    return df.select(key, order, x).groupBy(key).applyInPandasWithState(run, HISTORY, "n long, kept array<double>, win array<double>", "update", GroupStateTimeout.NoTimeout)


def streaming_vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(term, n, df): counts of terms and of texts that hold them so far; state is a row a term. Run it in update or complete mode."""
    t = df.select(tokens.alias("_t"))
    pairs = F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("term"), F.size(F.filter(F.col("_t"), lambda x: x == w)).alias("k")))
    return t.select(F.explode(pairs).alias("p")).groupBy("p.term").agg(F.sum("p.k").alias("n"), F.count("*").alias("df"))


def streaming_moments(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count, mean and deviation (n) of columns so far, by key: what a running scaler needs."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def for_each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands every micro-batch to f(batch, id); f sees a batch again after a failure, so it should write by id."""
    return df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
