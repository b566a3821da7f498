"""Queries over the series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import series
from quarry.plans.registry import read, register

_D = "d AS (SELECT o_orderpriority AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2)"


def daily(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("x"))


def _r(df, digits: int = 4):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_O = "OVER (PARTITION BY k ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@register("series_moving", f"""WITH {_D} SELECT k, day, round(avg(x) {_O.format(6)}, 3) AS mean, round(var_samp(x) {_O.format(6)}, 0) AS var, min(x) {_O.format(6)} AS min, max(x) {_O.format(6)} AS max FROM d QUALIFY count(*) {_O.format(6)} = 7""")
def series_moving(spark, d):
    m = series.moving(daily(spark, d), ["k"], "day", "x", 7)
    return m.select("k", "day", F.round("mean", 3).alias("mean"), F.round("var", 0).alias("var"), "min", "max")


@register("series_rolling_corr", f"WITH {_D} SELECT k, day, round(CASE WHEN stddev_pop(n) {_O.format(29)} * stddev_pop(x) {_O.format(29)} > 1e-9 THEN covar_pop(n, x) {_O.format(29)} / (stddev_pop(n) {_O.format(29)} * stddev_pop(x) {_O.format(29)}) END, 6) AS corr FROM d QUALIFY count(*) {_O.format(29)} = 30")
def series_rolling_corr(spark, d):
    return _r(series.rolling_corr(daily(spark, d), ["k"], "day", "n", "x", 30), 6)


@register("series_difference", f"WITH {_D}, e AS (SELECT k, day, round(x - lag(x, 7) OVER (PARTITION BY k ORDER BY day), 2) AS diff FROM d) SELECT * FROM e WHERE diff IS NOT NULL")
def series_difference(spark, d):
    return _r(series.difference(daily(spark, d), ["k"], "day", "x", 7).select("k", "day", "diff"), 2)


@register("series_lag_corr", f"""WITH {_D}, l AS (SELECT k, x, lag(n, 1) OVER w AS a, lag(n, 2) OVER w AS b, lag(n, 3) OVER w AS c FROM d WINDOW w AS (PARTITION BY k ORDER BY day))
 SELECT k, round(corr(a, x), 6) AS corr1, round(corr(b, x), 6) AS corr2, round(corr(c, x), 6) AS corr3, round(greatest(abs(corr(a, x)), abs(corr(b, x)), abs(corr(c, x))), 6) AS best FROM l GROUP BY k""")
def series_lag_corr(spark, d):
    return _r(series.lag_correlations(daily(spark, d), ["k"], "day", "n", "x", 3), 6)


@register("series_acf", f"WITH {_D}, c AS (SELECT k, day, x - avg(x) OVER (PARTITION BY k) AS c FROM d), p AS (SELECT k, c, c * lag(c, 3) OVER (PARTITION BY k ORDER BY day) AS p FROM c) SELECT k, round(sum(p) / sum(c * c), 6) AS acf FROM p GROUP BY k")
def series_acf(spark, d):
    return _r(series.autocorrelation(daily(spark, d), ["k"], "day", "x", 3), 6)


@register("series_seasonal_strength", f"WITH {_D}, s AS (SELECT k, x, x - lag(x, 7) OVER (PARTITION BY k ORDER BY day) AS d FROM d) SELECT k, round(least(greatest(1 - var_pop(d) / var_pop(x), 0), 1), 6) AS strength FROM s GROUP BY k")
def series_seasonal_strength(spark, d):
    return _r(series.seasonal_strength(daily(spark, d), ["k"], "day", "x", 7), 6)


@register("series_decompose", f"""WITH {_D}, t AS (SELECT k, day, x, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS i, CASE WHEN count(*) OVER f = 7 THEN avg(x) OVER f END AS trend FROM d WINDOW f AS (PARTITION BY k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 s AS (SELECT k, i % 7 AS p, avg(x - trend) AS s FROM t GROUP BY 1, 2), c AS (SELECT k, avg(s) AS c FROM s GROUP BY 1)
 SELECT t.k, day, round(trend, 2) AS trend, round(s - c, 2) AS seasonal, round(x - trend - (s - c), 2) AS resid FROM t JOIN s ON t.k = s.k AND t.i % 7 = s.p JOIN c ON t.k = c.k""")
def series_decompose(spark, d):
    return _r(series.decompose(daily(spark, d), ["k"], "day", "x", 7).select("k", "day", "trend", "seasonal", "resid"), 2)


@register("series_linear_fill", f"""WITH {_D}, i AS (SELECT k, day, row_number() OVER (PARTITION BY k ORDER BY day) AS i, CASE WHEN n % 3 <> 0 THEN n END AS v FROM d),
 a AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY k ORDER BY i) AS ia, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM i)
 SELECT a.k, a.day, round(CASE WHEN a.v IS NOT NULL THEN a.v WHEN x.v IS NULL THEN y.v WHEN y.v IS NULL THEN x.v ELSE x.v + (a.i - a.ia) / (a.ib - a.ia)::DOUBLE * (y.v - x.v) END, 6) AS filled
 FROM a LEFT JOIN i x ON a.k = x.k AND a.ia = x.i LEFT JOIN i y ON a.k = y.k AND a.ib = y.i""")
def series_linear_fill(spark, d):
    s = daily(spark, d).select("k", "day", F.when(F.col("n") % 3 != 0, F.col("n")).alias("v"))
    return _r(series.linear_fill(s, ["k"], "day", "v").select("k", "day", "filled"), 6)


@register("series_peaks", f"WITH {_D}, l AS (SELECT k, day, x, lag(x) OVER w AS l, lead(x) OVER w AS r FROM d WINDOW w AS (PARTITION BY k ORDER BY day)) SELECT k, day, x FROM l WHERE x > l AND x > r AND x >= 100000")
def series_peaks(spark, d):
    return series.find_peaks(daily(spark, d), ["k"], "day", "x", 100000.0).select("k", "day", "x")


@register("series_convolve", f"WITH {_D} SELECT k, day, round(0.25 * coalesce(lead(x) OVER w, 0) + 0.5 * x + 0.25 * coalesce(lag(x) OVER w, 0), 4) AS conv FROM d WINDOW w AS (PARTITION BY k ORDER BY day)")
def series_convolve(spark, d):
    return _r(series.convolve(daily(spark, d), ["k"], "day", "x", [0.25, 0.5, 0.25]).select("k", "day", "conv"), 4)


@register("series_features", """SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(var_pop(value), 4) AS var, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 5) AS q25, round(median(value), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75,
 round(sqrt(avg(value * value)), 5) AS rms, round(sum(value * value), 1) AS energy, round(avg(value * value), 4) AS power, round(max(value) - min(value), 5) AS peak_to_peak FROM events GROUP BY 1""")
def series_features(spark, d):
    f = series.features(read(spark, d, "events"), ["event_type"], "value")
    own = {"var": 4, "power": 4, "energy": 1}
    return f.select(*(F.round(c, own.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes))


@register("series_trapezoid", "WITH e AS (SELECT event_type, event_id::DOUBLE AS t, value FROM events), a AS (SELECT event_type, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, round(sum(a), 1) AS area FROM a GROUP BY 1")
def series_trapezoid(spark, d):
    return _r(series.trapezoid(read(spark, d, "events").withColumn("t", F.col("event_id").cast("double")), ["event_type"], "t", "value"), 1)


@register("series_cusum", f"WITH {_D}, c AS (SELECT k, day, n - avg(n) OVER (PARTITION BY k) AS c FROM d) SELECT k, day, round(sum(c) OVER (PARTITION BY k ORDER BY day), 4) + 0.0 AS cusum FROM c")
def series_cusum(spark, d):
    return series.cusum(daily(spark, d), ["k"], "day", "n").select("k", "day", (F.round("cusum", 4) + F.lit(0.0)).alias("cusum"))


@register("series_stationarity", f"""WITH {_D}, h AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY day) > floor(count(*) OVER (PARTITION BY k) / 2.0) AS h FROM d),
 s AS (SELECT k, count(*) AS n, avg(x) FILTER (NOT h) AS m0, avg(x) FILTER (h) AS m1, stddev_pop(x) FILTER (NOT h) AS s0, stddev_pop(x) FILTER (h) AS s1 FROM h GROUP BY 1)
 SELECT k, n, CASE WHEN n >= 10 THEN abs(m0 - m1) < 0.2 * (s0 + s1) / 2 AND greatest(s0 * s0, s1 * s1) / least(s0 * s0, s1 * s1) < 2 END AS stationary FROM s""")
def series_stationarity(spark, d):
    return series.stationarity(daily(spark, d), ["k"], "day", "x")


@register("finance_bollinger", f"WITH {_D} SELECT k, day, round(CASE WHEN count(x) OVER f = 20 THEN avg(x) OVER f END, 4) AS mid, round(CASE WHEN count(x) OVER f = 20 THEN avg(x) OVER f + 2 * stddev_pop(x) OVER f END, 4) AS upper, round(CASE WHEN count(x) OVER f = 20 THEN avg(x) OVER f - 2 * stddev_pop(x) OVER f END, 4) AS lower FROM d WINDOW f AS (PARTITION BY k ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def finance_bollinger(spark, d):
    return _r(series.bollinger(daily(spark, d), ["k"], "day", "x", 20).select("k", "day", "mid", "upper", "lower"), 4)


@register("finance_sma", f"WITH {_D} SELECT k, day, round(CASE WHEN count(x) {_O.format(4)} = 5 THEN avg(x) {_O.format(4)} END, 3) AS sma FROM d")
def finance_sma(spark, d):
    return _r(series.sma(daily(spark, d), ["k"], "day", "x", 5).select("k", "day", "sma"), 3)


@register("finance_rsi", f"""WITH {_D}, e AS (SELECT k, day, x - lag(x) OVER (PARTITION BY k ORDER BY day) AS c FROM d), s AS (SELECT k, day, count(c) OVER f AS n, avg(greatest(c, 0)) OVER f AS u, avg(greatest(-c, 0)) OVER f AS v FROM e WINDOW f AS (PARTITION BY k ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
 SELECT k, day, round(CASE WHEN n = 14 THEN CASE WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END END, 5) AS rsi FROM s""")
def finance_rsi(spark, d):
    return _r(series.rsi(daily(spark, d), ["k"], "day", "x").select("k", "day", "rsi"), 5)


_RET = "r AS (SELECT k, day, x / lag(x) OVER (PARTITION BY k ORDER BY day) - 1 AS p, n / lag(n) OVER (PARTITION BY k ORDER BY day) - 1 AS b FROM d)"


@register("finance_performance", f"""WITH {_D}, {_RET} SELECT k, round(stddev_samp(p) * sqrt(252), 5) AS volatility, round(avg(p) / stddev_samp(p) * sqrt(252), 5) AS sharpe, round(regr_slope(p, b), 5) AS beta, round(stddev_samp(p - b), 5) AS tracking_error, round(avg(p - b) / stddev_samp(p - b), 5) AS information_ratio,
 round(coalesce(avg(p) FILTER (b > 0) / avg(b) FILTER (b > 0), 0), 5) AS up_capture, round(coalesce(avg(p) FILTER (b < 0) / avg(b) FILTER (b < 0), 0), 5) AS down_capture FROM r WHERE p IS NOT NULL GROUP BY k""")
def finance_performance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("day")
    r = daily(spark, d).select("k", (F.col("x") / F.lag("x").over(w) - 1).alias("p"), (F.col("n") / F.lag("n").over(w) - 1).alias("b")).where("p IS NOT NULL")
    return _r(series.performance(r, ["k"], "p", "b"), 5)


@register("finance_drawdown", f"WITH {_D}, t AS (SELECT k, 1 - x / max(x) OVER (PARTITION BY k ORDER BY day) AS f FROM d) SELECT k, round(max(f), 6) AS max_drawdown FROM t GROUP BY k")
def finance_drawdown(spark, d):
    return _r(series.drawdown(daily(spark, d), ["k"], "day", "x"), 6)


@register("series_ewma", f"""WITH RECURSIVE {_D}, i AS (SELECT k, day, n, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM d),
 e AS (SELECT k, day, i, n AS e FROM i WHERE i = 1 UNION ALL SELECT i.k, i.day, i.i, 0.3 * i.n + 0.7 * e.e FROM i JOIN e ON i.k = e.k AND i.i = e.i + 1) SELECT k, day, round(e, 6) AS ewma FROM e""")
def series_ewma(spark, d):
    return _r(series.ewma(daily(spark, d), ["k"], "day", "n", 0.3).select("k", "day", "ewma"), 6)


_HW = f"""WITH RECURSIVE {_D}, i AS (SELECT k, day, x, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS t, count(*) OVER (PARTITION BY k) AS n FROM d),
 q AS (SELECT k, list(x ORDER BY t) AS v FROM i WHERE t < 10 GROUP BY k),
 z AS (SELECT k, CASE WHEN len(v) >= 7 THEN list_transform(v[1:7], lambda y: y - list_avg(v[1:7])) ELSE [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] END AS s, CASE WHEN len(v) > 1 THEN (v[len(v)] - v[1]) / (len(v) - 1) ELSE 0 END AS tr FROM q),
 h AS (SELECT i.k, i.day, i.t, i.x AS level, z.tr AS trend, list_concat(z.s[2:7], [0.2 * (i.x - i.x) + 0.8 * z.s[1]]) AS s FROM i JOIN z USING (k) WHERE t = 0 UNION ALL
  SELECT i.k, i.day, i.t, y.l, 0.1 * (y.l - h.level) + 0.9 * h.trend, list_concat(h.s[2:7], [0.2 * (i.x - y.l) + 0.8 * h.s[1]]) FROM h JOIN i ON i.k = h.k AND i.t = h.t + 1, LATERAL (SELECT 0.3 * (i.x - h.s[1]) + 0.7 * (h.level + h.trend) AS l) y)
 SELECT k, day, round(level, 2) AS level, round(trend, 2) AS trend, round(s[7], 2) AS seasonal FROM h"""


@register("series_holt_winters", _HW)
def series_holt_winters(spark, d):
    return _r(series.holt_winters(daily(spark, d), ["k"], "day", "x", 7, 0.3, 0.1, 0.2).select("k", "day", "level", "trend", "seasonal"), 2)


@register("series_stl")
def series_stl(spark, d):
    return series.stl(daily(spark, d), ["k"], "day", "x", 7)


@register("series_spectrum", f"""WITH {_D}, i AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS t, count(*) OVER (PARTITION BY k) AS m FROM d), f AS (SELECT k, any_value(m) AS m, unnest(range(0, any_value(m) // 2 + 1)) AS freq FROM i GROUP BY k)
 SELECT i.k, CAST(freq AS INTEGER) AS freq, round(pow(sum(n * cos(2 * pi() * ((freq * t) % f.m) / f.m)), 2) + pow(sum(n * sin(2 * pi() * ((freq * t) % f.m) / f.m)), 2), 3) AS power FROM i JOIN f ON f.k = i.k GROUP BY 1, 2""")
def series_spectrum(spark, d):
    return _r(series.spectrum(daily(spark, d), ["k"], "day", "n"), 3)
