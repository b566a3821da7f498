"""What operators share: tables in the shared folder, and running sums over a sorted column without one big window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write(df: DataFrame) -> DataFrame:
    """Write df below the session's shared checkpoint folder and read it again: cuts the lineage.

    A session without such a folder may use a local one only if it runs in one process (``local[...]``, as in tests).
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what :func:`write` has written, when nothing reads it any more."""
    path = getattr(df, "_written", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ranges(df: DataFrame, x: str) -> Column:
    """The number of a row's range, 0 and up, by about equal shares of x (a number, date or timestamp); null x has range 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(x).cast("double")
    cuts = df.select(number.alias("x")).stat.approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted(set(cuts))

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(number <= F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return F.when(F.col(x).isNull(), F.lit(0)).otherwise(pick(0, len(cuts)))


def running_sums(df: DataFrame, x: str, sums: dict[str, str], by: list[str] = (), descending: bool = False) -> DataFrame:
    """Adds columns name -> sum of the given column over the rows with x up to this row's (down to it, if descending).

    Rows are dealt by key and range of x; a range starts from the totals of the ranges before it, of which there are a
    few a key. So no task sees a whole column, and no key is one task.
    """
    by = list(by)
    d = df.withColumn("_range", ranges(df, x))
    names = {k: f"_s{i}" for i, k in enumerate(sums)}
    totals = d.groupBy(*by, "_range").agg(*(F.sum(c).alias(names[k]) for k, c in sums.items()))
    order = F.desc("_range") if descending else F.asc("_range")
    past = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    before = totals.select(*by, "_range", *(F.coalesce(F.sum(v).over(past), F.lit(0)).alias(v) for v in names.values()))
    j = d.join(before if by else F.broadcast(before), [*by, "_range"])  # without keys: a row a range
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(x) if descending else F.asc(x)).rangeBetween(Window.unboundedPreceding, 0)
    return j.withColumns({k: F.sum(c).over(inside) + F.col(names[k]) for k, c in sums.items()}).drop("_range", *names.values())


def attach(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of a table of one row a key (one row, without keys)."""
    return df.join(one, by) if by else df.crossJoin(F.broadcast(one))  # one row


def order_statistics(df: DataFrame, x: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """(keys, lo array, hi array, part array): the values at floor and ceil of q(n - 1) for each q, and q's fraction between them.

    Equal values are one row, and order comes from :func:`running_sums`.
    """
    by = list(by)
    d = df.where(F.col(x).isNotNull())
    counts = d.groupBy(*by, x).agg(F.count("*").alias("_c"))
    ranked = running_sums(counts, x, {"_hi": "_c"}, by)
    ranked = attach(ranked, d.groupBy(*by).agg(F.count("*").alias("_n")), by)
    at = lambda p: F.max(F.when((F.col("_hi") - F.col("_c") <= p) & (p < F.col("_hi")), F.col(x)))
    pos = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    low = [at(F.floor(p + 1e-9)) for p in pos]
    high = [at(F.least(F.ceil(p - 1e-9), F.col("_n") - 1)) for p in pos]
    part = [F.first(F.greatest(p - F.floor(p + 1e-9), F.lit(0.0))) for p in pos]
    return ranked.groupBy(*by).agg(F.array(*low).alias("lo"), F.array(*high).alias("hi"), F.array(*part).alias("part"))


def quantiles(df: DataFrame, x: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """(keys, q0, q1 ...): quantiles by linear interpolation at q(n - 1), exact; without keys always one row."""
    s = order_statistics(df, x, qs, by)
    value = lambda i: F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) * F.col("part")[i]
    out = s.select(*by, *(value(i).alias(f"q{i}") for i in range(len(qs))))
    return out
