"""Plane geometry: polygons as rows of vertices, and inverse distance weighting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import relational


def edges(vertices: DataFrame, polygon: str, order: str, x: str, y: str) -> DataFrame:
    """(polygon, x1, y1, x2, y2) of each polygon's sides, closed."""
    w = Window.partitionBy(polygon).orderBy(order)
    whole = Window.partitionBy(polygon).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(polygon, F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"), nxt(F.col(x).cast("double")).alias("x2"), nxt(F.col(y).cast("double")).alias("y2"))


def polygon_measures(sides: DataFrame, polygon: str) -> DataFrame:
    """(polygon, n, area, perimeter): area by the shoelace sum (without sign)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return sides.groupBy(polygon).agg(F.count("*").alias("n"), (F.abs(F.sum(cross)) / 2).alias("area"), F.sum(F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)).alias("perimeter"))


def contains(points: DataFrame, sides: DataFrame, polygon: str, cell: float) -> DataFrame:
    """points(id, polygon, x, y) with ``inside``, by the parity of sides crossed to the right; each point against its own polygon.

    Points meet the sides that cross their row of cells of height ``cell`` only. There the crossings of each height are
    computed and sorted once, and its points are found among them by bisection.
    """
    s = sides.where("y1 <> y2").select(polygon, "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))).alias("_c")).where(F.col(polygon).isNotNull())
    p = points.withColumn("_c", F.floor(F.col("y") / cell))

    def number(t: pa.Table, c: str) -> np.ndarray:
        return t.column(c).cast(pa.float64()).to_numpy().astype("float64")  # null: nan

    def part(p: pa.Table, s: pa.Table) -> pa.Table:
        inside = np.zeros(len(p), bool)
        if len(p) and len(s):
            x, y = number(p, "x"), number(p, "y")
            x1, y1, x2, y2 = (number(s, c) for c in ("x1", "y1", "x2", "y2"))
            order = np.argsort(y, kind="stable")
            order = order[~np.isnan(y[order])]
            for at in np.split(order, np.flatnonzero(np.diff(y[order])) + 1) if len(order) else ():
                v = y[at[0]]
                on = (y1 > v) != (y2 > v)
                cross = np.sort((x2[on] - x1[on]) * (v - y1[on]) / (y2[on] - y1[on]) + x1[on])
                inside[at] = (len(cross) - np.searchsorted(cross, x[at], side="right")) % 2 == 1
        return p.drop_columns(["_c"]).append_column("inside", pa.array(inside))

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in points.schema.fields)
    return p.groupBy(polygon, "_c").cogroup(s.groupBy(polygon, "_c")).applyInArrow(part, f"{kinds}, inside boolean")


def idw(known: DataFrame, asked: DataFrame, radius: float, power: float = 2.0) -> DataFrame:
    """(id, value): mean of the known(id, x, y, z) within the radius of each asked(id, x, y), weighted by distance ** -power.

    At a known point its own value (the mean, if there are several) counts alone; without any in reach the value is null.
    """
    near = relational.grid_join(asked.select("id", "x", "y"), known.select("id", "x", "y", "z"), "x", "y", radius)
    w = F.when(F.col("dist") > 0, F.pow(F.col("dist"), F.lit(-power)))
    g = near.groupBy(F.col("l_id").alias("id")).agg(F.avg(F.when(F.col("dist") == 0, F.col("r_z"))).alias("here"), (F.sum(w * F.col("r_z")) / F.sum(w)).alias("mean"))
    return asked.select("id").join(g, "id", "left").select("id", F.coalesce("here", "mean").alias("value"))
