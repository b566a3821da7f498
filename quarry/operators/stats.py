"""Statistics over columns, by group where asked. NaN counts as a value; convert it to null to leave it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import state


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def describe(df: DataFrame, x: str, by=None) -> DataFrame:
    """n, mean, std, var (n - 1), min, max, range and sem in one pass."""
    c = F.col(x)
    return df.groupBy(*_by(by)).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.var_samp(c).alias("var"),
        F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("sem"),
    )


def moments(df: DataFrame, x: str, by=None) -> DataFrame:
    """Skewness and excess kurtosis, biased and bias-corrected; null where undefined."""
    c, n = F.col(x), F.col("n")
    m = df.groupBy(*_by(by)).agg(F.count(c).alias("n"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"))
    return m.select(
        *_by(by), "n", "skew", "kurt",
        F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew_unbiased"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6)).alias("kurt_unbiased"),
    )


def central_moment(df: DataFrame, x: str, k: int, by=None) -> DataFrame:
    """k-th central moment by group, in two aggregations."""
    keys = _by(by)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_m"))
    joined = df.join(mean, keys) if keys else df.crossJoin(F.broadcast(mean))  # one row
    return joined.groupBy(*keys).agg(F.avg(F.pow(F.col(x) - F.col("_m"), F.lit(k))).alias(f"moment{k}"))


def quantile(df: DataFrame, x: str, q: float, by=None, method: str = "linear") -> DataFrame:
    """Quantile at q(n - 1): linear, lower, higher, midpoint or nearest (below one half: lower), exact for columns of any size."""
    keys = _by(by)
    r = state.order_statistics(df, x, [q], keys)
    low, high, part = F.col("lo")[0], F.col("hi")[0], F.col("part")[0]
    pick = {"linear": low + (high - low) * part, "lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": F.when(part < 0.5, low).otherwise(high)}
    return r.select(*keys, pick[method].alias("quantile"))


def dispersion(df: DataFrame, x: str, by=None) -> DataFrame:
    """Interquartile range, coefficient of variation (null at mean 0) and range."""
    c, keys = F.col(x), _by(by)
    s = df.groupBy(*keys).agg(F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias("cv"), (F.max(c) - F.min(c)).alias("range"))
    return state.attach(s, state.quantiles(df, x, [0.25, 0.75], keys), keys).select(*keys, (F.col("q1") - F.col("q0")).alias("iqr"), "cv", "range")


def percentile_range(df: DataFrame, x: str, lo: float, hi: float, by=None) -> DataFrame:
    """Distance of two quantiles."""
    keys = _by(by)
    return state.quantiles(df, x, [lo, hi], keys).select(*keys, (F.col("q1") - F.col("q0")).alias("percentile_range"))


def mad(df: DataFrame, x: str, by=None, scale: float = 1.0) -> DataFrame:
    """Median absolute deviation from the median."""
    keys = _by(by)
    joined = state.attach(df, state.quantiles(df, x, [0.5], keys), keys).select(*keys, F.abs(F.col(x) - F.col("q0")).alias("_d"))
    return state.quantiles(joined, "_d", [0.5], keys).select(*keys, (F.col("q0") * scale).alias("mad"))


def robust_summary(df: DataFrame, x: str, by=None) -> DataFrame:
    """median, q1, q3, iqr, mad (scaled to the normal) and the five-number range."""
    keys = _by(by)
    q = state.quantiles(df, x, [0.0, 0.25, 0.5, 0.75, 1.0], keys).select(*keys, F.col("q0").alias("min"), F.col("q1").alias("q1"), F.col("q2").alias("median"), F.col("q3").alias("q3"), F.col("q4").alias("max"), (F.col("q3") - F.col("q1")).alias("iqr"))
    return state.attach(q, mad(df, x, keys, 1.4826), keys)


def gini(df: DataFrame, x: str, by) -> DataFrame:
    """2 sum(i x(i)) / (n sum(x)) - (n + 1) / n with values in order; 0 when they add up to 0.

    Equal values are one row, with the sum of their ranks.
    """
    keys = _by(by)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    r = state.running_sums(counts, x, {"_hi": "_c"}, keys)
    ranks = F.col("_c") * (2 * F.col("_hi") - F.col("_c") + 1) / 2
    n, s = F.sum("_c"), F.sum(F.col(x) * F.col("_c"))
    return r.groupBy(*keys).agg(F.when(F.abs(s) < 1e-12, 0.0).otherwise(2 * F.sum(ranks * F.col(x)) / (n * s) - (n + 1) / n).alias("gini"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr, cov) of every pair of columns, a <= b, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.covar_samp(a, b).alias("cov")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(f"p{i}" for i in range(len(pairs))))).alias("p")).select("p.*")


def zscore_outliers(df: DataFrame, x: str, threshold: float = 3.0, by=None) -> DataFrame:
    """Rows with |x - mean| > threshold * std (n - 1), with ``z``."""
    keys = _by(by)
    s = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    j = df.join(s, keys) if keys else df.crossJoin(F.broadcast(s))  # one row
    return j.where(F.col("_s") > 1e-12).withColumn("z", (F.col(x) - F.col("_m")) / F.col("_s")).where(F.abs("z") > threshold).drop("_m", "_s")


def iqr_outliers(df: DataFrame, x: str, factor: float = 1.5, by=None) -> DataFrame:
    keys = _by(by)
    s = state.quantiles(df, x, [0.25, 0.75], keys).withColumnsRenamed({"q0": "_a", "q1": "_b"})
    j = state.attach(df, s, keys)
    width = F.col("_b") - F.col("_a")
    return j.where((F.col(x) < F.col("_a") - factor * width) | (F.col(x) > F.col("_b") + factor * width)).drop("_a", "_b")


def histogram(df: DataFrame, x: str, bins: int, lo: float | None = None, hi: float | None = None, by=None) -> DataFrame:
    """(bin, n): equal widths, the greatest value in the last bin, values outside dropped."""
    if lo is None or hi is None:
        r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        lo, hi = (r.a if lo is None else lo), (r.b if hi is None else hi)
    if lo is None:
        return df.limit(0).groupBy(*_by(by), F.lit(0).alias("bin")).agg(F.count("*").alias("n"))
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(x) - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).between(lo, hi)).groupBy(*_by(by), b.alias("bin")).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, x: str, by=None, name: str = "rank") -> DataFrame:
    """Adds the average rank of x (ties share it), through a table of distinct values."""
    keys = _by(by)
    c = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    r = state.running_sums(c, x, {"_hi": "_c"}, keys).withColumn(name, F.col("_hi") - (F.col("_c") - 1) / 2)
    return df.join(r.drop("_c", "_hi"), [*keys, x])


def spearman(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    r = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*_by(by)).agg(F.corr("_rx", "_ry").alias("spearman"))


def _inversions(ys: list[float], ns: list[float]) -> float:
    """Weighted pairs i < j with y[i] > y[j], by a Fenwick tree."""
    import numpy as np

    at = np.unique(ys, return_inverse=True)[1]
    tree, total, out = np.zeros(int(at.max(initial=-1)) + 2), 0.0, 0.0
    for k, n in zip(at, ns):
        below, i = 0.0, int(k) + 1
        while i:
            below += tree[i]
            i -= i & -i
        out += n * (total - below)
        total += n
        i = int(k) + 1
        while i < len(tree):
            tree[i] += n
            i += i & -i
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b from discordant pairs over the table of distinct (x, y) cells.

    Cells are dealt by ranges of x and of y. Pairs of cells in different ranges of both need the ranges' counts only;
    pairs in one x range or in one y range are counted there, in order, by a tree. So a task holds one range's cells.
    """
    import numpy as np
    import pandas as pd

    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = base.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    cells = state.write(cells.withColumn("rx", state.ranges(cells, "x")).withColumn("ry", state.ranges(cells, "y")))

    def strip(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y"])
        return pd.DataFrame({"d": [_inversions(g["y"].tolist(), g["n"].tolist())]})

    def band(g: pd.DataFrame) -> pd.DataFrame:
        """In one y range: pairs in different x ranges only."""
        g = g.sort_values(["x", "y"])
        d = _inversions(g["y"].tolist(), g["n"].tolist())
        for _, h in g.groupby("rx", sort=False):
            d -= _inversions(h["y"].tolist(), h["n"].tolist())
        return pd.DataFrame({"d": [d]})

    own = cells.groupBy("rx").applyInPandas(strip, "d double").unionAll(cells.groupBy("ry").applyInPandas(band, "d double")).agg(F.sum("d")).first()[0] or 0.0
    grid = cells.groupBy("rx", "ry").agg(F.sum("n").alias("n")).collect()  # ranges of x times ranges of y
    m = np.zeros((max((r.rx for r in grid), default=0) + 1, max((r.ry for r in grid), default=0) + 1))
    for r in grid:
        m[r.rx, r.ry] = r.n
    past = np.cumsum(m, 0) - m  # cells before, by y range
    above = past.sum(1, keepdims=True) - np.cumsum(past, 1)
    own += float((m * above).sum())
    half = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tie = lambda *c: base.groupBy(*c).agg(F.count("*").cast("double").alias("k")).agg(half("k").alias("t"))
    tx, ty, txy = (F.broadcast(tie(*c).withColumnRenamed("t", k)) for c, k in ((("x",), "tx"), (("y",), "ty"), (("x", "y"), "txy")))
    out = base.agg(F.count("*").cast("double").alias("n")).crossJoin(tx).crossJoin(ty).crossJoin(txy)  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tx_, ty_, txy_ = (F.coalesce(c, F.lit(0.0)) for c in ("tx", "ty", "txy"))
    return out.select(F.try_divide(pairs - tx_ - ty_ + txy_ - 2 * F.lit(own), F.sqrt((pairs - tx_) * (pairs - ty_))).alias("tau_b"))


def partial_correlation(df: DataFrame, x: str, y: str, z: str, by=None) -> DataFrame:
    """Correlation of x and y given z."""
    c = df.groupBy(*_by(by)).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    return c.select(*_by(by), ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial_corr"))


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    """One-way analysis of variance: ss_between, ss_within, df_between, df_within, f."""
    g = df.where(F.col(x).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("N"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("ss_between"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    dfb, dfw = F.col("k") - 1, F.col("N") - F.col("k")
    return t.select("ss_between", "ss_within", dfb.alias("df_between"), dfw.alias("df_within"), ((F.col("ss_between") / dfb) / (F.col("ss_within") / dfw)).alias("f"))


def tukey_pairs(df: DataFrame, x: str, group: str) -> DataFrame:
    """For each pair of groups (a < b): mean difference and studentised range statistic q (Tukey-Kramer)."""
    g = df.where(F.col(x).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    mse = g.agg((F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"))
    a, b = (g.select(F.col("g").alias(s), F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}")) for s in "ab")
    p = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(mse))  # groups are few; one row
    return p.select("a", "b", (F.col("ma") - F.col("mb")).alias("diff"), (F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.col("mse") / 2 * (1 / F.col("na") + 1 / F.col("nb")))).alias("q"))


def levene(df: DataFrame, x: str, group: str, center: str = "mean") -> DataFrame:
    """Levene's statistic: the analysis of variance of |x - centre|; ``median`` gives Brown-Forsythe."""
    c = state.quantiles(df, x, [0.5], [group]).withColumnRenamed("q0", "_c") if center == "median" else df.groupBy(group).agg(F.avg(x).alias("_c"))
    return anova(df.join(c, group).withColumn("_d", F.abs(F.col(x) - F.col("_c"))), "_d", group).select(F.col("f").alias("w"), "df_between", "df_within")


def bartlett(df: DataFrame, x: str, group: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.var_samp(x).alias("v"))
    d = F.col("n") - 1
    t = g.agg(F.count("*").alias("k"), F.sum(d).alias("D"), F.sum(d * F.col("v")).alias("S"), F.sum(d * F.log("v")).alias("L"), F.sum(1 / d).alias("R"))
    k, D = F.col("k"), F.col("D")
    return t.select(((D * F.log(F.col("S") / D) - F.col("L")) / (1 + (F.col("R") - 1 / D) / (3 * (k - 1)))).alias("t"), (k - 1).alias("df"))


def chi2_gof(df: DataFrame, observed: str, expected: str) -> DataFrame:
    o, e = F.col(observed), F.col(expected)
    return df.agg(F.sum((o - e) ** 2 / e).alias("chi2"), (F.count("*") - 1).alias("df"))


def chi2_independence(df: DataFrame, a: str, b: str, yates: bool = False) -> DataFrame:
    """Pearson's chi-square of the table a x b; empty cells count with their expectation.

    Without Yates the empty cells add up to t minus the expectations of the others; with it the table is 2 x 2.
    """
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy(a).agg(F.sum("n").alias("ra")), n.groupBy(b).agg(F.sum("n").alias("rb"))
    total = n.agg(F.sum("n").alias("t"))
    e = F.col("ra") * F.col("rb") / F.col("t")
    shape = ra.agg(F.count("*").alias("ka")).crossJoin(F.broadcast(rb.agg(F.count("*").alias("kb"))))  # one row each
    df_ = ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df")
    if yates:
        if shape.where("ka > 2 OR kb > 2").count():
            raise ValueError("the correction is for tables of two by two")
        cells = ra.crossJoin(F.broadcast(rb)).join(n, [a, b], "left")  # four rows at most
        gap = F.greatest(F.abs(F.coalesce("n", F.lit(0)) - e) - 0.5, F.lit(0.0))
        return state.attach(state.attach(cells, total, []).agg(F.sum(gap * gap / e).alias("chi2")), shape, []).select("chi2", df_)
    full = state.attach(n.join(ra, a).join(rb, b), total, [])
    s = full.agg(F.sum((F.col("n") - e) ** 2 / e).alias("s"), F.sum(e).alias("e"), F.first("t").alias("t"))
    return state.attach(s, shape, []).select((F.col("s") + F.col("t") - F.col("e")).alias("chi2"), df_)


def t_test(df: DataFrame, x: str, group: str, a, b, equal_var: bool = False) -> DataFrame:
    """Two-sample t statistic and degrees of freedom, Welch or pooled."""
    col = lambda v, f: f(F.when(F.col(group) == v, F.col(x)))
    s = df.agg(*(col(v, f).alias(f"{k}{i}") for i, v in ((1, a), (2, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if equal_var:
        sp = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, d = F.sqrt(sp * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        se = F.sqrt(v1 / n1 + v2 / n2)
        d = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return s.select(((F.col("m1") - F.col("m2")) / se).alias("t"), d.alias("df"))


def mann_whitney(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """U of group a, from average ranks."""
    r = average_ranks(df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()), x)
    s = r.agg(F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("r"), F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("n"))
    return s.select((F.col("r") - F.col("n") * (F.col("n") + 1) / 2).alias("u"))


def kruskal(df: DataFrame, x: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with the correction for ties."""
    d = df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
    g = average_ranks(d, x).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    s = g.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("N"), (F.count("*") - 1).alias("df"))
    ties = d.groupBy(x).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("T"))
    N = F.col("N").cast("double")
    return s.crossJoin(F.broadcast(ties)).select(((12 / (N * (N + 1)) * F.col("s") - 3 * (N + 1)) / (1 - F.col("T") / (N**3 - N))).alias("h"), "df")


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Signed-rank sums of x - y, zeros left out; the statistic is the smaller."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    r = average_ranks(d, "a").agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    return r.withColumn("w", F.least("w_plus", "w_minus"))


def friedman(df: DataFrame, subject: str, treatment: str, x: str) -> DataFrame:
    """Friedman's chi-square from average ranks inside each subject, ties corrected."""
    w = Window.partitionBy(subject)
    r = df.withColumn("_r", F.rank().over(w.orderBy(x))).withColumn("_t", F.count("*").over(Window.partitionBy(subject, x))).withColumn("_r", F.col("_r") + (F.col("_t") - 1) / 2)
    s = r.groupBy(treatment).agg(F.sum("_r").alias("s")).agg(F.sum(F.col("s") ** 2).alias("S"), F.count("*").alias("k"))
    t = r.agg(F.countDistinct(subject).alias("n"), F.sum(F.col("_t") ** 2 - 1).alias("T"))  # each tie of t values gives t(t^2 - 1)
    n, k = F.col("n"), F.col("k")
    return s.crossJoin(F.broadcast(t)).select(((12 / (n * k * (k + 1)) * F.col("S") - 3 * n * (k + 1)) / (1 - F.col("T") / (n * k * (k * k - 1)))).alias("chi2"), (k - 1).alias("df"))


def ks_two_sample(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Largest gap of the two empirical distribution functions, over distinct values."""
    c = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()).groupBy(x).agg(F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col(group) == b, 1).otherwise(0)).alias("nb"))
    r = state.running_sums(c, x, {"ca": "na", "cb": "nb"})
    r = state.attach(r, c.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb")), [])
    return r.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def linear_regression(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    return df.groupBy(*_by(by)).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Least-squares coefficients, constant first: sums of powers in one aggregation, solved on the driver."""
    import numpy as np

    p = [F.sum(F.pow(F.col(x), F.lit(i))).alias(f"p{i}") for i in range(2 * degree + 1)]
    q = [F.sum(F.col(y) * F.pow(F.col(x), F.lit(i))).alias(f"q{i}") for i in range(degree + 1)]
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*p, *q).first()
    a = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return np.linalg.lstsq(a, np.array([r[f"q{i}"] for i in range(degree + 1)], float), rcond=None)[0].tolist()


def icc(df: DataFrame, subject: str, rater: str, x: str) -> DataFrame:
    """Intraclass correlations of a complete two-way table: models 1, 2 and 3."""
    t = df.agg(F.countDistinct(subject).alias("n"), F.countDistinct(rater).alias("k"), F.sum(x).alias("s"), F.sum(F.col(x) ** 2).alias("q"))
    rows = df.groupBy(subject).agg(F.sum(x).alias("a")).agg(F.sum(F.col("a") ** 2).alias("A"))
    cols = df.groupBy(rater).agg(F.sum(x).alias("b")).agg(F.sum(F.col("b") ** 2).alias("B"))
    one = t.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # one row each
    n, k, c = F.col("n"), F.col("k"), F.col("s") ** 2 / (F.col("n") * F.col("k"))
    ssb, ssr, sst = F.col("A") / k - c, F.col("B") / n - c, F.col("q") - c
    msb, msr = ssb / (n - 1), ssr / (k - 1)
    mse, msw = (sst - ssb - ssr) / ((n - 1) * (k - 1)), (sst - ssb) / (n * (k - 1))
    z = lambda top, bottom: F.when(top <= 0, 0.0).otherwise(top / bottom)
    return one.select(z(msb - msw, msb + (k - 1) * msw).alias("icc1"), z(msb - mse, msb + (k - 1) * mse + k * (msr - mse) / n).alias("icc2"), z(msb - mse, msb + (k - 1) * mse).alias("icc3"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-width bins on both axes; 0 for a constant column."""
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()

    def cut(col: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit((hi - lo) / bins if hi > lo else 1.0)), F.lit(bins - 1))

    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cut(x, r.a, r.b).alias("i"), cut(y, r.c, r.d).alias("j")).agg(F.count("*").alias("n"))
    ni, nj = cells.groupBy("i").agg(F.sum("n").alias("ni")), cells.groupBy("j").agg(F.sum("n").alias("nj"))
    t = F.broadcast(cells.agg(F.sum("n").alias("t")))  # one row
    return cells.join(ni, "i").join(nj, "j").crossJoin(t).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mi"))


def f_score(df: DataFrame, x: str, y: str) -> DataFrame:
    """Univariate regression F = r2 (n - 2) / (1 - r2)."""
    s = df.agg(F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    return s.select(F.when(F.col("r2") >= 1, float("inf")).otherwise(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))).alias("f"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, x: str, by=None) -> DataFrame:
    """Shannon entropy (nats) of the values of x."""
    keys = _by(by)
    c = df.groupBy(*keys, x).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def bootstrap_means(df: DataFrame, x: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean) by Poisson weights: each row counts a Poisson(1) number of times in each replicate, so no row is copied to one task."""
    u = F.pmod(F.xxhash64(F.struct(*df.columns), F.monotonically_increasing_id(), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight, below, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 10):
        below += p
        weight = F.when(u >= below, k).otherwise(weight)
        p /= k
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight).groupBy("replicate").agg((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias("mean"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "Window", "F", "scalar", "state")]
