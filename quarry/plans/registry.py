"""All queries of the reference's own operators, by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query, and its oracle where SQL can express it."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register(
    "summary_stats",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean_qty,
       round(var_samp(l_quantity), 6) AS var_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped one-pass count, sums, mean, sample variance and range."""
    from pyspark.sql import functions as F

    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_quantity"), 6).alias("mean_qty"),
            F.round(F.var_samp("l_quantity"), 6).alias("var_qty"),
            F.min("l_extendedprice").alias("min_price"),
            F.max("l_extendedprice").alias("max_price"),
        )
    )


def load() -> None:
    """Import the modules that register queries."""
    from quarry.plans import models, more, statistics, texts, timeseries  # noqa: F401


load()
