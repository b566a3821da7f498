"""Sampling, splits, scalers, encoders and imputers.

Draws are by hash of a stable id, so they do not depend on partitioning.
Exact counts need a rank, which is taken over sorted ranges or inside keys,
never over one unpartitioned window of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import state


def _u(id_col: str, seed: int) -> Column:
    """Uniform in [0, 1) by id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _key(id_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def _cut_off(df: DataFrame, id_col: str, seed: int, k: int):
    """(hash, id) of the k-th row in hash order: counts by the hash's first bits, then the order inside one of these."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = df.select(h.alias("h"), F.col(id_col).alias("i")).withColumn("b", F.shiftright("h", 48))
    left = k
    for r in sorted(rows.groupBy("b").agg(F.count("*").alias("n")).collect()):  # at most 65536 counts
        if r.n >= left:
            return rows.where(F.col("b") == r.b).orderBy("h", "i").limit(left).orderBy(F.desc("h"), F.desc("i")).first()
        left -= r.n


def _up_to(df: DataFrame, id_col: str, seed: int, k: int) -> Column:
    """Is a row among the first k in hash order?"""
    last = _cut_off(df, id_col, seed, k)
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    return (h < last["h"]) | ((h == last["h"]) & (F.col(id_col) <= F.lit(last["i"])))


def random_sample(df: DataFrame, id_col: str, k: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """Exactly k rows; without replacement ValueError if there are fewer, with it ``draw`` numbers the draws."""
    n = df.count()
    if k < 0 or n == 0 or (k > n and not replacement):
        raise ValueError(f"{k} rows of {n}")
    if not k:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long")) if replacement else df.limit(0)
    if not replacement:
        return df.where(_up_to(df, id_col, seed, k))
    numbered = global_index(df, [id_col], "_i")
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_i"))
    return draws.join(numbered, "_i").select(*df.columns, "draw")


def bootstrap(df: DataFrame, id_col: str, size: int | None = None, replicates: int = 1, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement, ``size`` (all by default) for each ``replicate``, numbered by ``draw``."""
    n = df.count()
    size = n if size is None else size
    if n == 0 or size < 1 or replicates < 1:
        raise ValueError("a bootstrap needs rows, a size and replicates")
    numbered = global_index(df, [id_col], "_i")
    draws = df.sparkSession.range(size * replicates).select(F.floor(F.col("id") / size).cast("int").alias("replicate"), (F.col("id") % size).alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_i"))
    return draws.join(numbered, "_i").select(*df.columns, "replicate", "draw")


def leave_one_out(df: DataFrame, order: str) -> DataFrame:
    """Adds ``fold`` 0 to n - 1: each row is the test of its own fold. Training rows of a fold are all others, so they are not listed."""
    return global_index(df, [order], "fold")


def cross_validate(df: DataFrame, fold: str, fit, score) -> list:
    """score(fit(training rows), test rows) for every value of ``fold``; folds are few."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    return [score(fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k)) for k in folds]


def stratified_sample(df: DataFrame, id_col: str, y: str, k: int, seed: int = 0) -> DataFrame:
    """Equal counts per class, the remainder to the lowest classes; ValueError if a class is short."""
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}  # a row a class
    if None in sizes:
        raise ValueError("a class is null")
    classes = sorted(sizes)
    quota = {c: k // len(classes) + (i < k % len(classes)) for i, c in enumerate(classes)}
    if any(quota[c] > sizes[c] for c in classes):
        raise ValueError("a class has fewer rows than its share")
    w = Window.partitionBy(y).orderBy(*_key(id_col, seed))
    q = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.element_at(q, F.col(y))).drop("_r")


def importance_sample(df: DataFrame, id_col: str, weight: str, k: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """k rows with chances by weight: without replacement by exponential keys, with it (numbered by ``draw``) by running sums.

    ValueError on a negative weight, if all are zero, or if fewer than k rows have one.
    """
    one = df.agg(F.min(weight).alias("low"), F.sum(weight).alias("total"), F.sum((F.col(weight) > 0).cast("long")).alias("n")).first()
    if one.low is None or one.low < 0 or not one.total or (k > one.n and not replacement):
        raise ValueError("weights are not negative, not all zero, and enough for the sample")
    live = df.where(F.col(weight) > 0)
    if replacement:
        spans = state.running_sums(live.withColumn("_o", F.xxhash64(F.col(id_col), F.lit(seed))), "_o", {"_end": weight})
        width = float(one.total) / max(k, 1)
        u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.lit(float(one.total))
        draws = df.sparkSession.range(k).select(F.col("id").alias("draw"), u.alias("_u")).withColumn("_b", F.floor(F.col("_u") / width))
        spans = spans.withColumn("_start", F.col("_end") - F.col(weight)).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))))
        return draws.join(spans, "_b").where("_u >= _start AND _u < _end").select(*df.columns, "draw")
    keyed = live.withColumn("_k", -F.log(1 - _u(id_col, seed)) / F.col(weight))
    last = state.order_statistics(keyed, "_k", [(k - 1) / max(one.n - 1, 1)]).first()["hi"][0] if k else -1.0
    less = keyed.where(F.col("_k") < last)
    ties = keyed.where(F.col("_k") == last).orderBy(id_col).limit(max(k - less.count(), 0))  # rows of one key
    return less.unionByName(ties).drop("_k")


def global_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2 ... in the given order: a range-partitioned sort, then offsets of the partitions (a number each on the driver)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_j", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_j", F.col("_j") - F.col("_p") * F.lit(1 << 33))
    ranged = state.write(ranged)  # the partition numbers must not change between both uses
    counts = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect())
    start, offsets = 0, []
    for p, n in counts:
        offsets.append((p, start))
        start += n
    table = df.sparkSession.createDataFrame(offsets, "_p int, _s long")
    return ranged.join(F.broadcast(table), "_p").withColumn(name, F.col("_j") + F.col("_s")).drop("_p", "_j", "_s")  # a row a partition


def train_test_split(df: DataFrame, id_col: str, test_size: float, seed: int = 0) -> DataFrame:
    """Adds ``split``: exactly round(n * test_size) rows are ``test``, by hash order."""
    n = df.count()
    k = int(n * test_size + 0.5)
    if not 0 < k < n:
        raise ValueError("both sides need rows")
    test = _up_to(df, id_col, seed, k)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def k_fold(df: DataFrame, order: str, k: int) -> DataFrame:
    """Contiguous folds 0 to k - 1; the first n % k have one row more."""
    n = df.count()
    size, more = divmod(n, k)
    i = F.col("_i")
    g = global_index(df, [order], "_i")
    return g.withColumn("fold", F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(F.lit(more) + F.floor((i - more * (size + 1)) / F.lit(max(size, 1)))).cast("int")).drop("_i")


def stratified_k_fold(df: DataFrame, y: str, order: str, k: int) -> DataFrame:
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(y).orderBy(order)) - 1)


def time_series_split(n: int, n_splits: int, test_size: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """(train_end, test_start, test_end): training rows are [0, train_end)."""
    s = (n - test_size - gap) // n_splits
    if s <= 0:
        raise ValueError("too few rows")
    out = []
    for i in range(n_splits):
        start = s * (i + 1) + gap
        out.append((start - gap, start, min(start + test_size, n)))
    return out


def _fit(df: DataFrame, columns: list[str], aggs) -> dict:
    return df.agg(*(f(c).alias(f"{c}__{k}") for c in columns for k, f in aggs.items())).first().asDict()


def standardize(df: DataFrame, columns: list[str], eps: float = 1e-10) -> DataFrame:
    """(x - mean) / std with n in the denominator; centred only where std <= eps."""
    m = _fit(df, columns, {"m": F.avg, "s": F.stddev_pop})
    return df.withColumns({c: (F.col(c) - m[f"{c}__m"]) / (m[f"{c}__s"] if (m[f"{c}__s"] or 0) > eps else 1.0) for c in columns})


def min_max(df: DataFrame, columns: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Into [lo, hi]; a constant column goes to the middle."""
    m = _fit(df, columns, {"a": F.min, "b": F.max})
    return df.withColumns({c: lo + (F.col(c) - m[f"{c}__a"]) / (m[f"{c}__b"] - m[f"{c}__a"]) * (hi - lo) if m[f"{c}__b"] != m[f"{c}__a"] else F.when(F.col(c).isNotNull(), (lo + hi) / 2) for c in columns})


def max_abs(df: DataFrame, columns: list[str]) -> DataFrame:
    m = _fit(df, columns, {"m": lambda c: F.max(F.abs(c))})
    return df.withColumns({c: F.col(c) / (m[f"{c}__m"] or 1.0) for c in columns})


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) with quartiles as order statistics n / 4 and 3n / 4; centred only where they agree."""
    out = {}
    for c in columns:
        n = df.agg(F.count(c)).first()[0]
        at = lambda i, n=n: min(max(i, 0), n - 1) / max(n - 1, 1)
        r = state.order_statistics(df, c, [at(-(-n // 4) - 1), 0.5, at(-(-3 * n // 4) - 1)]).first() if n else None
        if r is None:
            out[c] = F.col(c).cast("double")
            continue
        mid = r.lo[1] + (r.hi[1] - r.lo[1]) * r.part[1]
        out[c] = (F.col(c) - mid) / ((r.lo[2] - r.lo[0]) or 1.0)
    return df.withColumns(out)


def normalize_rows(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    cols = [F.col(c) for c in columns]
    size = {"l1": sum((F.abs(c) for c in cols), F.lit(0.0)), "l2": F.sqrt(sum((c * c for c in cols), F.lit(0.0))), "max": F.greatest(*(F.abs(c) for c in cols)) if len(cols) > 1 else F.abs(cols[0])}[norm]
    return df.withColumn("_n", size).withColumns({c: F.when(F.col("_n") > 1e-12, F.col(c) / F.col("_n")).otherwise(F.col(c)) for c in columns}).drop("_n")


def equal_width(df: DataFrame, x: str, bins: int) -> DataFrame:
    m = _fit(df, [x], {"a": F.min, "b": F.max})
    w = ((m[f"{x}__b"] or 0) - (m[f"{x}__a"] or 0)) / bins or 1.0
    return df.withColumn("bin", F.least(F.floor((F.col(x) - m[f"{x}__a"]) / w), F.lit(bins - 1)).cast("int"))


def quantile_bins(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Bins by exact quantile edges; a value on an edge goes up."""
    edges = list(state.quantiles(df, x, [i / bins for i in range(1, bins)]).first())
    return df.withColumn("bin", sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0)))


def frequency_encode(df: DataFrame, x: str) -> DataFrame:
    n = df.count()
    return df.join(df.groupBy(x).agg((F.count("*") / F.lit(n)).alias(f"{x}_freq")), x)


def ordinal_encode(df: DataFrame, x: str) -> DataFrame:
    """Index of the sorted distinct value, by sorted ranges."""
    d = global_index(df.select(x).where(F.col(x).isNotNull()).distinct(), [x], f"{x}_code").withColumn(f"{x}_code", F.col(f"{x}_code").cast("int"))
    return df.join(d, x, "left")


def target_encode(df: DataFrame, x: str, y: str, smoothing: float = 1.0) -> DataFrame:
    """Mean of y by value, drawn to the overall mean by ``smoothing`` rows."""
    m = df.agg(F.avg(y)).first()[0]
    g = df.groupBy(x).agg(((F.sum(y) + smoothing * m) / (F.count(y) + smoothing)).alias(f"{x}_target"))
    return df.join(g, x)


def woe_encode(df: DataFrame, x: str, y: str) -> DataFrame:
    """(value, woe): ln of the shares of positives and negatives, each count half a row up."""
    t = df.agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.sum(F.when(F.col(y) == 0, 1).otherwise(0))).first()
    g = df.groupBy(x).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("q"))
    return g.select(x, F.log(((F.col("p") + 0.5) / (t[0] + 0.5)) / ((F.col("q") + 0.5) / (t[1] + 0.5))).alias("woe"))


def one_hot(df: DataFrame, x: str, values: list) -> DataFrame:
    return df.withColumns({f"{x}={v}": (F.col(x) == v).cast("int") for v in values})


def impute(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    if how == "median":
        m = {f"{c}__v": (state.quantiles(df, c, [0.5]).first() or [None])[0] for c in columns}
    else:
        m = _fit(df, columns, {"v": {"mean": F.avg, "mode": F.mode}[how]})
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(m[f"{c}__v"])) for c in columns})


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    from itertools import combinations_with_replacement

    out = {}
    for k in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, k):
            e = F.lit(1.0)
            for c in combo:
                e = e * F.col(c)
            out["*".join(combo)] = e
    return df.withColumns(out)


def oversample(df: DataFrame, id_col: str, y: str, seed: int = 0) -> DataFrame:
    """Every class as large as the largest: each row is repeated n // size times, and the first by hash once more."""
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}  # a row a class
    top = max(sizes.values(), default=0)
    w = Window.partitionBy(y).orderBy(*_key(id_col, seed))
    size = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col(y))
    copies = F.floor(F.lit(top) / size) + (F.row_number().over(w) <= F.lit(top) % size).cast("int")
    return df.withColumn("_c", copies.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")


def undersample(df: DataFrame, id_col: str, y: str, seed: int = 0) -> DataFrame:
    low = min((r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()), default=0)
    w = Window.partitionBy(y).orderBy(*_key(id_col, seed))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= low).drop("_r")
