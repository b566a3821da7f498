"""Feature selection and causality of series; every score is an aggregation, solved from sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_correlations(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, score): |Pearson correlation| with y."""
    one = df.agg(*(F.abs(F.corr(c, y)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("score")) for c in columns))).alias("x")).select("x.*")


def anova_scores(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, score): F of the one-way analysis of variance of each column by the classes y."""
    rows = df.where(F.col(y).isNotNull()).select(y, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(y, "x.*").where("v IS NOT NULL")
    g = rows.groupBy("column", y).agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("w"))
    s = g.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("b"))
    return s.select("column", F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("score"))


def information_scores(df: DataFrame, columns: list[str], y: str, bins: int = 10) -> DataFrame:
    """(column, score): mutual information (nats) of each column in equal-width bins with the classes y."""
    lim = df.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max)))).first()
    cell = lambda i, c: F.least(F.floor((F.col(c) - F.lit(lim[f"a{i}"])) / F.lit(((lim[f"b{i}"] or 0) - (lim[f"a{i}"] or 0)) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(y).isNotNull()).select(y, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), cell(i, c).alias("b")) for i, c in enumerate(columns)))).alias("x")).select(y, "x.*").where("b IS NOT NULL")
    n = rows.groupBy("column", "b", y).agg(F.count("*").cast("double").alias("n"))
    w = lambda *k: Window.partitionBy("column", *k)  # noqa: E731  bins times classes of a column
    t = n.select("column", "n", F.sum("n").over(w("b")).alias("nb"), F.sum("n").over(w(y)).alias("ny"), F.sum("n").over(w()).alias("t"))
    return t.groupBy("column").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("score"))


def autocorrelation_scores(df: DataFrame, by: list[str], order: str, columns: list[str], lags: int) -> DataFrame:
    """(keys, column, score): the greatest |autocorrelation| of lags 1 to ``lags``."""
    w = Window.partitionBy(*by).orderBy(order)
    r = df.select(*by, *(F.struct(F.col(c).cast("double").alias("v"), F.lag(F.col(c).cast("double"), k).over(w).alias("l")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in range(1, lags + 1)))
    g = r.groupBy(*by).agg(*(F.abs(F.corr(F.col(f"{i}_{k}").v, F.col(f"{i}_{k}").l)).alias(f"{i}_{k}") for i in range(len(columns)) for k in range(1, lags + 1)))
    best = [F.struct(F.lit(c).alias("column"), F.array_max(F.array(*(F.col(f"{i}_{k}") for k in range(1, lags + 1)))).alias("score")) for i, c in enumerate(columns)]
    return g.select(*by, F.explode(F.array(*best)).alias("x")).select(*by, "x.*")


def select_k_best(scores: DataFrame, k: int) -> list[str]:
    """The k columns of the greatest score (ties: the smaller name); a row a column."""
    return [r["column"] for r in scores.where("score IS NOT NULL").orderBy(F.desc("score"), "column").limit(k).collect()]


def uncorrelated(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """The columns in order without those whose |correlation| with a kept one exceeds the threshold; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else []
    close = {p for p, v in zip(pairs, r) if v is not None and abs(v) > threshold}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in close for k in kept):
            kept.append(c)
    return kept


def granger(df: DataFrame, by: list[str], order: str, x: str, y: str, lag: int = 1) -> DataFrame:
    """(keys, n, f): does x help to predict y? F of the regression of y on its own lags against that with x's lags too.

    The regressions are solved from sums of products, one row a series, so a series may be of any length.
    """
    w = Window.partitionBy(*by).orderBy(order)
    names = ["one", *(f"y{k}" for k in range(1, lag + 1)), *(f"x{k}" for k in range(1, lag + 1)), "y0"]
    cols = [F.lit(1.0).alias("one"), *(F.lag(F.col(y).cast("double"), k).over(w).alias(f"y{k}") for k in range(1, lag + 1)), *(F.lag(F.col(x).cast("double"), k).over(w).alias(f"x{k}") for k in range(1, lag + 1)), F.col(y).cast("double").alias("y0")]
    r = df.select(*by, *cols).dropna(subset=names)
    centre = r.groupBy(*by).agg(*(F.avg(c).alias(f"_{c}") for c in names[1:]))
    r = r.join(centre, by).select(*by, "one", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in names[1:]))
    sums = r.groupBy(*by).agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).alias("_s"))
    m = len(names)

    def solve(batches):
        for pdf in batches:
            f, n = [], []
            for s in pdf["_s"]:
                g = np.array(s, float).reshape(m, m)

                def rss(k: int) -> float:
                    a, b = g[:k, :k], g[:k, -1]
                    return float(g[-1, -1] - b @ np.linalg.lstsq(a, b, rcond=None)[0])

                rows, less, full = g[0, 0], rss(1 + lag), rss(1 + 2 * lag)
                free = rows - 2 * lag - 1
                f.append(((less - full) / lag) / (full / free) if free > 0 and full > 0 else None)
                n.append(int(rows))
            out = pdf.drop(columns="_s").assign(n=n, f=f)
            yield out

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    return sums.mapInPandas(solve, f"{keys}, n long, f double")

