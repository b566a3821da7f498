"""Time series, signal and finance operators.

A series is (key, order, value); windows are always partitioned by the key, so
series spread over the cluster. Order-recursive kernels (exponential smoothing,
STL-like loess) run per series in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def moving(df: DataFrame, by: list[str], order: str, x: str, w: int) -> DataFrame:
    """Moving mean, var, min, max of the last w rows; only full windows stay."""
    f = _w(by, order).rowsBetween(1 - w, 0)
    out = df.select(*df.columns, F.count("*").over(f).alias("_n"), F.avg(x).over(f).alias("mean"), F.var_samp(x).over(f).alias("var"), F.min(x).over(f).alias("min"), F.max(x).over(f).alias("max"))
    return out.where(F.col("_n") == w).drop("_n")


def rolling_corr(df: DataFrame, by: list[str], order: str, x: str, y: str, w: int) -> DataFrame:
    f = _w(by, order).rowsBetween(1 - w, 0)
    spread = F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)
    corr = F.when(spread > 1e-9, F.covar_pop(x, y).over(f) / spread)  # null where one side is constant
    return df.select(*by, order, corr.alias("corr"), F.count("*").over(f).alias("_n")).where(F.col("_n") == w).drop("_n")


def difference(df: DataFrame, by: list[str], order: str, x: str, lag: int = 1) -> DataFrame:
    """x - lag(x); the first ``lag`` rows of a series go."""
    return df.withColumn("diff", F.col(x) - F.lag(x, lag).over(_w(by, order))).where("diff IS NOT NULL")


def lag_correlations(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """corr(x[t - l], y[t]) for l = 1..lags, and the greatest |corr| as ``best``."""
    cols = [F.lag(x, k).over(_w(by, order)).alias(f"l{k}") for k in range(1, lags + 1)]
    g = df.select(*by, F.col(y).alias("_y"), *cols).groupBy(*by).agg(*(F.corr(f"l{k}", "_y").alias(f"corr{k}") for k in range(1, lags + 1)))
    return g.withColumn("best", F.greatest(*(F.abs(f"corr{k}") for k in range(1, lags + 1))))


def autocorrelation(df: DataFrame, by: list[str], order: str, x: str, lag: int) -> DataFrame:
    """sum((x[t] - m)(x[t - lag] - m)) / sum((x - m)^2)."""
    m = df.select(*by, order, (F.col(x) - F.avg(x).over(Window.partitionBy(*by))).alias("c"))
    p = m.withColumn("p", F.col("c") * F.lag("c", lag).over(_w(by, order)))
    return p.groupBy(*by).agg((F.sum("p") / F.sum(F.col("c") ** 2)).alias("acf"))


def seasonal_strength(df: DataFrame, by: list[str], order: str, x: str, period: int) -> DataFrame:
    """1 - var(x[t] - x[t - p]) / var(x), clamped to [0, 1]."""
    d = df.withColumn("_d", F.col(x) - F.lag(x, period).over(_w(by, order)))
    return d.groupBy(*by).agg(F.least(F.greatest(1 - F.var_pop("_d") / F.var_pop(x), F.lit(0.0)), F.lit(1.0)).alias("strength"))


def decompose(df: DataFrame, by: list[str], order: str, x: str, period: int, model: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average, seasonal means (edges left out), residual."""
    half = period // 2
    w = _w(by, order)
    f = w.rowsBetween(-half, half)
    b = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("trend", F.when(F.count("*").over(f) == 2 * half + 1, F.avg(x).over(f)))
    add = model == "additive"
    b = b.withColumn("_d", F.col(x) - F.col("trend") if add else F.col(x) / F.col("trend")).withColumn("_p", F.col("_i") % period)
    s = b.groupBy(*by, "_p").agg(F.avg("_d").alias("_s"))
    c = s.groupBy(*by).agg(F.avg("_s").alias("_c"))
    s = s.join(c, by).withColumn("seasonal", F.col("_s") - F.col("_c") if add else F.col("_s") / F.col("_c"))
    out = b.join(s.select(*by, "_p", "seasonal"), [*by, "_p"])
    return out.withColumn("resid", F.col(x) - F.col("trend") - F.col("seasonal") if add else F.col(x) / (F.col("trend") * F.col("seasonal"))).drop("_i", "_d", "_p")


def linear_fill(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Nulls of x between known values by index, at the edges by the nearest; a series without a value stays null."""
    w = _w(by, order)
    b = df.withColumn("_i", F.row_number().over(w)).withColumn("_at", F.when(F.col(x).isNotNull(), F.struct("_i", x)))
    before, after = F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_at", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    b = b.withColumn("_a", before).withColumn("_b", after)
    step = (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    value = F.when(F.col(x).isNotNull(), F.col(x)).when(F.col("_a").isNull(), F.col(f"_b.{x}")).when(F.col("_b").isNull(), F.col(f"_a.{x}")).otherwise(F.col(f"_a.{x}") + step * (F.col(f"_b.{x}") - F.col(f"_a.{x}")))
    return b.withColumn("filled", value).drop("_i", "_at", "_a", "_b")


def find_peaks(df: DataFrame, by: list[str], order: str, x: str, height: float | None = None, threshold: float = 0.0) -> DataFrame:
    """Rows strictly above both neighbours, by at least ``threshold``, and of at least ``height``."""
    w = _w(by, order)
    b = df.withColumn("_l", F.lag(x).over(w)).withColumn("_r", F.lead(x).over(w))
    ok = (F.col(x) > F.col("_l")) & (F.col(x) > F.col("_r")) & (F.col(x) - F.col("_l") >= threshold) & (F.col(x) - F.col("_r") >= threshold)
    return b.where(ok & (F.col(x) >= height) if height is not None else ok).drop("_l", "_r")


def convolve(df: DataFrame, by: list[str], order: str, x: str, kernel: list[float]) -> DataFrame:
    """``same``-length direct convolution with a short kernel."""
    w, m = _w(by, order), len(kernel)
    shift = (m - 1) // 2
    total: Column = F.lit(0.0)
    for k, c in enumerate(kernel):
        total = total + F.lit(float(c)) * F.coalesce(F.lag(x, k - shift).over(w) if k >= shift else F.lead(x, shift - k).over(w), F.lit(0.0))
    return df.withColumn("conv", total)


def features(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, variance (n), extremes, quartiles, rms, energy and power of each series."""
    from quarry.operators import state

    c = F.col(x)
    g = df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.sqrt(F.avg(c * c)).alias("rms"), F.sum(c * c).alias("energy"), F.avg(c * c).alias("power"), (F.max(c) - F.min(c)).alias("peak_to_peak"),
    )
    return state.attach(g, state.quantiles(df, x, [0.25, 0.5, 0.75], by).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"}), by)


def trapezoid(df: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    w = _w(by, t)
    b = df.withColumn("_a", (F.col(x) + F.lag(x).over(w)) / 2 * (F.col(t) - F.lag(t).over(w)))
    return b.groupBy(*by).agg(F.sum("_a").alias("area"))


def cusum(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Running sum of deviations from the series mean."""
    b = df.withColumn("_d", F.col(x) - F.avg(x).over(Window.partitionBy(*by)))
    return b.withColumn("cusum", F.sum("_d").over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def stationarity(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Halves at n / 2 (n >= 10): |mean gap| < 0.2 * mean of both deviations, variance ratio below 2."""
    w = Window.partitionBy(*by)
    b = df.withColumn("_h", F.row_number().over(w.orderBy(order)) > F.floor(F.count("*").over(w) / 2))
    g = lambda f, h: f(F.when(F.col("_h") == h, F.col(x)))
    s = b.groupBy(*by).agg(F.count("*").alias("n"), *(g(f, h).alias(f"{k}{int(h)}") for h in (False, True) for k, f in (("m", F.avg), ("s", F.stddev_pop), ("v", F.var_pop))))
    ratio = F.greatest("v0", "v1") / F.least("v0", "v1")
    return s.select(*by, "n", F.when(F.col("n") >= 10, (F.abs(F.col("m0") - F.col("m1")) < 0.2 * (F.col("s0") + F.col("s1")) / 2) & (ratio < 2)).alias("stationary"))


# finance


def sma(df: DataFrame, by: list[str], order: str, x: str, w: int) -> DataFrame:
    f = _w(by, order).rowsBetween(1 - w, 0)
    return df.withColumn("sma", F.when(F.count(x).over(f) == w, F.avg(x).over(f)))


def bollinger(df: DataFrame, by: list[str], order: str, x: str, w: int, k: float = 2.0) -> DataFrame:
    f = _w(by, order).rowsBetween(1 - w, 0)
    full = F.count(x).over(f) == w
    m, s = F.avg(x).over(f), F.stddev_pop(x).over(f)
    return df.withColumn("mid", F.when(full, m)).withColumn("upper", F.when(full, m + k * s)).withColumn("lower", F.when(full, m - k * s))


def rsi(df: DataFrame, by: list[str], order: str, x: str, w: int = 14) -> DataFrame:
    """Relative strength index from simple means of the last w gains and losses."""
    o = _w(by, order)
    b = df.withColumn("_d", F.col(x) - F.lag(x).over(o))
    f = o.rowsBetween(1 - w, 0)
    up, down = F.avg(F.greatest("_d", F.lit(0.0))).over(f), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(f)
    return b.withColumn("rsi", F.when(F.count("_d").over(f) == w, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)))).drop("_d")


def performance(df: DataFrame, by: list[str], p: str, b: str, periods: int = 252) -> DataFrame:
    """Annualised volatility and Sharpe, beta, tracking error, information ratio, capture ratios of returns p against b."""
    e = F.col(p) - F.col(b)
    up = lambda c: F.avg(F.when(F.col(b) > 0, F.col(c)))
    down = lambda c: F.avg(F.when(F.col(b) < 0, F.col(c)))
    return df.groupBy(*by).agg(
        (F.stddev_samp(p) * F.sqrt(F.lit(float(periods)))).alias("volatility"), (F.avg(p) / F.stddev_samp(p) * F.sqrt(F.lit(float(periods)))).alias("sharpe"), F.regr_slope(p, b).alias("beta"),
        F.stddev_samp(e).alias("tracking_error"), F.try_divide(F.avg(e), F.stddev_samp(e)).alias("information_ratio"),
        F.coalesce(F.try_divide(up(p), up(b)), F.lit(0.0)).alias("up_capture"), F.coalesce(F.try_divide(down(p), down(b)), F.lit(0.0)).alias("down_capture"),
    )


def drawdown(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Greatest fall from a running maximum, as a share of it."""
    top = F.max(x).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_d", 1 - F.col(x) / top).groupBy(*by).agg(F.max("_d").alias("max_drawdown"))


# order-recursive kernels, one series at a time


def _per_series(df: DataFrame, by: list[str], order: str, kernel, extra: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra
    return df.groupBy(*by).applyInPandas(lambda g: kernel(g.sort_values(order).reset_index(drop=True)), schema)


def ewma(df: DataFrame, by: list[str], order: str, x: str, alpha: float) -> DataFrame:
    """s[0] = x[0], s[t] = alpha x[t] + (1 - alpha) s[t - 1]."""
    return _per_series(df, by, order, lambda g: g.assign(ewma=g[x].ewm(alpha=alpha, adjust=False).mean()), "ewma double")


def holt_winters(df: DataFrame, by: list[str], order: str, x: str, period: int, alpha: float, beta: float, gamma: float) -> DataFrame:
    """Additive level, trend, seasonal; level starts at x[0], trend at the mean of the first (up to nine) differences."""
    if not all(0 < v < 1 for v in (alpha, beta, gamma)):
        raise ValueError("smoothing factors lie inside (0, 1)")

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        v = g[x].to_numpy(float)
        n = len(v)
        lev, tr, sea = np.zeros(n), np.zeros(n), np.zeros(n)
        season = np.zeros(period)
        if n >= period:
            season = v[:period] - v[:period].mean()
        level, trend = v[0], np.diff(v[:10]).mean() if n > 1 else 0.0
        for t in range(n):
            s = season[t % period]
            old = level
            level = alpha * (v[t] - s) + (1 - alpha) * (level + trend) if t else v[0]
            trend = beta * (level - old) + (1 - beta) * trend if t else trend
            season[t % period] = gamma * (v[t] - level) + (1 - gamma) * s
            lev[t], tr[t], sea[t] = level, trend, season[t % period]
        return g.assign(level=lev, trend=tr, seasonal=sea)

    return _per_series(df, by, order, kernel, "level double, trend double, seasonal double")


def stl(df: DataFrame, by: list[str], order: str, x: str, period: int, seasonal_window: int = 7, rounds: int = 2) -> DataFrame:
    """Seasonal-trend decomposition by loess (inner loop only)."""

    def loess(y: np.ndarray, width: int) -> np.ndarray:
        n = len(y)
        width = min(max(width, 3), n)
        out = np.empty(n)
        at = np.arange(n, dtype=float)
        for i in range(n):
            lo = min(max(i - width // 2, 0), n - width)
            u = at[lo : lo + width] - i
            w = (1 - np.minimum(np.abs(u) / (np.abs(u).max() + 1e-9), 1) ** 3) ** 3 + 1e-9
            sw, su, suu = w.sum(), (w * u).sum(), (w * u * u).sum()
            sy, suy = (w * y[lo : lo + width]).sum(), (w * u * y[lo : lo + width]).sum()
            den = sw * suu - su * su
            out[i] = (suu * sy - su * suy) / den if abs(den) > 1e-12 else sy / sw
        return out

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        v = g[x].to_numpy(float)
        n = len(v)
        trend, season = np.zeros(n), np.zeros(n)
        if n >= 2 * period:
            for _ in range(rounds):
                d = v - trend
                for p in range(period):
                    season[p::period] = loess(d[p::period], seasonal_window)
                low = np.convolve(np.pad(season, period // 2, mode="edge"), np.ones(period) / period, "same")[period // 2 : period // 2 + n]
                season = season - low
                trend = loess(v - season, (3 * period) // 2 | 1)
        else:
            trend = v.copy()
        return g.assign(trend=trend, seasonal=season, resid=v - trend - season)

    return _per_series(df, by, order, kernel, "trend double, seasonal double, resid double")


def spectrum(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """(key, freq, power): squared magnitudes of the real Fourier transform of each series."""
    keys = df.select(*by).schema

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        p = np.abs(np.fft.rfft(g.sort_values(order)[x].to_numpy(float))) ** 2
        return pd.DataFrame({**{b: [g[b].iloc[0]] * len(p) for b in by}, "freq": np.arange(len(p), dtype=np.int32), "power": p})

    return df.groupBy(*by).applyInPandas(kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields) + ", freq int, power double")


# more finance and signal operators


def rolling_performance(df: DataFrame, by: list[str], order: str, r: str, w: int, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """Return, annualised volatility and Sharpe ratio of the last w returns; only full windows stay."""
    f = _w(by, order).rowsBetween(1 - w, 0)
    year = F.sqrt(F.lit(float(periods)))
    s = F.stddev_samp(r).over(f)
    out = df.select(*by, order, F.count(r).over(f).alias("_n"), (F.exp(F.sum(F.log1p(r)).over(f)) - 1).alias("total_return"), (s * year).alias("volatility"), F.try_divide(F.avg(r).over(f) - risk_free / periods, s).alias("_s"))
    return out.where(F.col("_n") == w).select(*by, order, "total_return", "volatility", (F.col("_s") * year).alias("sharpe"))


def macd(df: DataFrame, by: list[str], order: str, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (difference of exponential means of spans fast and slow), signal (its own of span signal) and histogram."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        mean = lambda v, n: v.ewm(span=n, adjust=False).mean()
        line = mean(g[x], fast) - mean(g[x], slow)
        sign = mean(line, signal)
        return g.assign(macd=line, signal=sign, histogram=line - sign)

    return _per_series(df, by, order, kernel, "macd double, signal double, histogram double")


def atr(df: DataFrame, by: list[str], order: str, high: str, low: str, close: str, w: int = 14) -> DataFrame:
    """Average true range: mean of the last w of max(high - low, |high - previous close|, |low - previous close|)."""
    o = _w(by, order)
    last = F.lag(close).over(o)
    d = df.withColumn("_t", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - last), F.abs(F.col(low) - last)))
    f = o.rowsBetween(1 - w, 0)
    return d.withColumn("atr", F.when(F.count("_t").over(f) == w, F.avg("_t").over(f))).drop("_t")


def volume_indicators(df: DataFrame, by: list[str], order: str, price: str, volume: str) -> DataFrame:
    """obv (volume added on a rise, taken away on a fall) and vwap (running volume-weighted price)."""
    o = _w(by, order)
    d = df.withColumn("_v", F.coalesce(F.signum(F.col(price) - F.lag(price).over(o)), F.lit(0.0)) * F.col(volume))
    f = o.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("obv", F.sum("_v").over(f)).withColumn("vwap", F.sum(F.col(price) * F.col(volume)).over(f) / F.sum(volume).over(f)).drop("_v")


def cross_correlation(df: DataFrame, by: list[str], order: str, x: str, y: str, lag: int) -> DataFrame:
    """sum((x[t - lag] - mx)(y[t] - my)) / (n sx sy) with the moments of the whole series."""
    a = Window.partitionBy(*by)
    c = df.select(*by, order, (F.col(x) - F.avg(x).over(a)).alias("a"), (F.col(y) - F.avg(y).over(a)).alias("b"))
    p = c.withColumn("p", F.lag("a", lag).over(_w(by, order)) * F.col("b"))
    return p.groupBy(*by).agg(F.try_divide(F.sum("p"), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("ccf"))


def robust_trend(df: DataFrame, by: list[str], order: str, x: str, half: int, level: float = 1.96) -> DataFrame:
    """trend (median of 2 half + 1 rows, shorter at the ends) and lower, upper (its bounds by the standard deviation of what is left)."""
    near = F.array_sort(F.collect_list(F.col(x).cast("double")).over(_w(by, order).rowsBetween(-half, half)))  # 2 half + 1 values
    m = df.withColumn("_a", near).withColumn("trend", (F.get("_a", F.floor((F.size("_a") - 1) / 2).cast("int")) + F.get("_a", F.floor(F.size("_a") / 2).cast("int"))) / 2).drop("_a")
    s = F.stddev_samp(F.col(x) - F.col("trend")).over(Window.partitionBy(*by))
    return m.withColumn("lower", F.col("trend") - level * s).withColumn("upper", F.col("trend") + level * s)


def snr(df: DataFrame, by: list[str], signal: str, noisy: str) -> DataFrame:
    """Signal-to-noise ratio in decibels of a signal and its noisy copy."""
    e = F.col(noisy) - F.col(signal)
    return df.groupBy(*by).agg((10 * F.log10(F.try_divide(F.sum(F.col(signal) ** 2), F.sum(e * e)))).alias("snr_db"))


def resample(df: DataFrame, by: list[str], ts: str, width: str, aggs: dict[str, Column]) -> DataFrame:
    """(keys, start, ...): aggregates of time buckets of the given width."""
    return df.groupBy(*by, F.window(ts, width).start.alias("start")).agg(*(c.alias(k) for k, c in aggs.items()))


def robust_zscores(df: DataFrame, by: list[str], x: str, threshold: float = 3.5) -> DataFrame:
    """Rows whose modified z, 0.6745 (x - median) / mad, exceeds the threshold, with ``z``."""
    from quarry.operators import state, stats

    m = state.quantiles(df, x, [0.5], by).withColumnRenamed("q0", "_m")
    d = state.attach(state.attach(df, m, by), stats.mad(df, x, by).withColumnRenamed("mad", "_d"), by)
    return d.where("_d > 0").withColumn("z", 0.6745 * (F.col(x) - F.col("_m")) / F.col("_d")).where(F.abs("z") > threshold).drop("_m", "_d")
