"""Joins by distance and order, sparse matrices as (i, j, v), and validation of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import state


def grid_join(left: DataFrame, right: DataFrame, x: str, y: str, eps: float) -> DataFrame:
    """Pairs of points within eps (Euclid): points meet in grid cells of side eps, never all with all.

    Columns of both sides are l_* and r_*; ``dist`` is added. The right side has nine rows a point, which Spark's estimate
    of its size leaves out, so it is never broadcast.
    """
    cell = lambda c: F.floor(F.col(c) / eps)
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).withColumn("_cx", cell(f"l_{x}")).withColumn("_cy", cell(f"l_{y}"))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    near = F.array(*(F.struct((cell(f"r_{x}") + i).alias("_cx"), (cell(f"r_{y}") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = b.withColumn("_c", F.explode(near)).select("*", "_c._cx", "_c._cy").drop("_c")
    d = F.sqrt((F.col(f"l_{x}") - F.col(f"r_{x}")) ** 2 + (F.col(f"l_{y}") - F.col(f"r_{y}")) ** 2)
    return a.join(b.hint("merge"), ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= eps).drop("_cx", "_cy")


#: Ids of rows of equal coordinates travel in arrays of about so many.
HEAP = 512


def heaps(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys, ids) with the prefix: the ids of the rows of equal keys without nulls, in arrays of about HEAP."""
    d = df.select("id", *keys).dropna(subset=keys)
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / HEAP)).alias("_h")
    g = d.join(n, keys).groupBy(*keys, part).agg(F.collect_list("id").alias("ids"))
    return state.write(g.select(*(F.col(k).alias(f"{prefix}{k}") for k in keys), F.col("ids").alias(f"{prefix}ids")))


def near_pairs(df: DataFrame, x: str, y: str, eps: float) -> DataFrame:
    """(a, b, dist) of all points (id, x, y) within eps, a < b, each pair once.

    Places meet in the grid, once however many points they have; only the pairs of the result are made from their ids.
    """
    l = heaps(df, [x, y], "l_")
    r = l.select(*(F.col(c).alias(f"r_{c[2:]}") for c in l.columns))
    at = l.select(F.col(f"l_{x}").alias(x), F.col(f"l_{y}").alias(y)).distinct()
    same = (F.col(f"l_{x}") == F.col(f"r_{x}")) & (F.col(f"l_{y}") == F.col(f"r_{y}"))
    after = (F.col(f"l_{x}") < F.col(f"r_{x}")) | ((F.col(f"l_{x}") == F.col(f"r_{x}")) & (F.col(f"l_{y}") <= F.col(f"r_{y}")))
    p = grid_join(at, at, x, y, eps).where(after).withColumn("_same", same)
    p = p.join(l.hint("merge"), [f"l_{x}", f"l_{y}"]).join(r.hint("merge"), [f"r_{x}", f"r_{y}"]).select("dist", "_same", F.explode("l_ids").alias("_a"), "r_ids").select("dist", "_same", "_a", F.explode("r_ids").alias("_b"))
    # inside a place both orders come
    return p.where("_a < _b OR (NOT _same AND _a > _b)").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "dist")


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(l_id, r_id) of overlapping boxes (id, x0, y0, x1, y1), through the grid cells they touch; each pair once.

    Equal boxes of a side meet the other side once; only the pairs of the result are made from their ids.
    """
    keys = ["x0", "y0", "x1", "y1"]
    l, r = heaps(left, keys, "l_"), heaps(right, keys, "r_")

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(f"{p}{a}") / cell), F.floor(F.col(f"{p}{b}") / cell))
        d = df.select(*(f"{p}{k}" for k in keys)).distinct()
        return d.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))

    j = cells(l, "l_").join(cells(r, "r_").hint("merge"), ["_cx", "_cy"])
    hit = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    # a pair is reported in the first cell that both boxes touch
    first = (F.col("_cx") == F.floor(F.greatest("l_x0", "r_x0") / cell)) & (F.col("_cy") == F.floor(F.greatest("l_y0", "r_y0") / cell))
    p = j.where(hit & first).join(l.hint("merge"), [f"l_{k}" for k in keys]).join(r.hint("merge"), [f"r_{k}" for k in keys])
    return p.select(F.explode("l_ids").alias("l_id"), "r_ids").select("l_id", F.explode("r_ids").alias("r_id"))


def range_search(df: DataFrame, x: str, y: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def nearest(df: DataFrame, point: dict[str, float], k: int, id_col: str) -> DataFrame:
    """The k rows nearest to a point (ties: smaller id), by a distributed top-k."""
    d = F.sqrt(sum(((F.col(c) - v) ** 2 for c, v in point.items()), F.lit(0.0)))
    return df.withColumn("dist", d).orderBy("dist", id_col).limit(k)


def assign(df: DataFrame, vec: str, centroids: list[list[float]]) -> DataFrame:
    """Adds ``code`` and ``dist`` of the nearest centroid (first on ties); the centroids travel in the plan."""
    ds = [F.struct(F.sqrt(F.aggregate(F.zip_with(F.col(vec), F.array(*map(F.lit, map(float, c))), lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, v: s + v)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return df.withColumn("_b", F.array_min(F.array(*ds))).withColumn("code", F.col("_b.i")).withColumn("dist", F.col("_b.d")).drop("_b")


def as_of(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """left with the last ``value`` of right at or before t, per key: one union and one window, no range join."""
    u = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_s", F.lit(1)).unionByName(right.select(*by, t, F.col(value).alias("_v"), F.lit(0).alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(t, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("_v", True).over(w)).where("_s = 1").drop("_v", "_s")


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside [start, end) of the same key, through buckets of ``width`` that each span touches."""
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, [*by, "_b"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_b")


# sparse matrices


#: Rows and columns of the pieces that a product is computed in, the least number of parts that each side's free index is
#: dealt to, how many entries a part has about, and how many products are added up at a time where a piece is sparse.
ROWS, COLS, PARTS, ENTRIES, TERMS = 512, 2048, 4, 2_000_000, 1_000_000


def matmul(a: DataFrame, b: DataFrame, block: int = 4096) -> DataFrame:
    """Sum over k of a(i, k) b(k, j), zeros dropped.

    Rows of a and columns of b are dealt to parts by hash, and each pair of parts is one task that has all their entries,
    makes its piece of the product part by part and sends it as it goes: nothing is added up after it. Pieces are dense
    (``block`` inner indices at a time) where enough of their products are there, and sums of single products elsewhere.
    """
    a, b = (m.dropna(subset=["i", "j", "v"]) for m in (a, b))
    parts = max(PARTS, -(-max(a.count(), b.count()) // ENTRIES))
    each = F.explode(F.array(*(F.lit(p) for p in range(parts))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    ki, kj = a.schema["i"].dataType.simpleString(), b.schema["j"].dataType.simpleString()
    v = F.col("v").cast("double").alias("v")
    x = a.select(part("i").alias("ip"), each.alias("jp"), "i", F.lit(None).cast(kj).alias("j"), F.col("j").alias("k"), v)
    y = b.select(each.alias("ip"), part("j").alias("jp"), F.lit(None).cast(ki).alias("i"), "j", F.col("i").alias("k"), v)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        left = t.column("i").is_valid().to_numpy()
        names = t.column("k").combine_chunks().dictionary_encode().indices.to_numpy()
        value = t.column("v").to_numpy()
        ri, rj = (t.column(c).combine_chunks().dictionary_encode() for c in "ij")
        i, j = (c.indices.filter(c.indices.is_valid()).to_numpy() for c in (ri, rj))
        p, q = (names[left], value[left]), (names[~left], value[~left])
        del t
        o = np.argsort(i, kind="stable")
        i, pk, pv = i[o], p[0][o], p[1][o]
        o = np.argsort(q[0], kind="stable")
        j, qk, qv = j[o], q[0][o], q[1][o]
        size = len(rj.dictionary)
        first = np.searchsorted(qk, np.arange(names.max() + 2)) if len(names) else np.zeros(1, int)  # where each k begins in b
        terms = np.diff(first)
        finite = bool(np.isfinite(pv).all() and np.isfinite(qv).all())

        def send(r, c, m):
            return pa.RecordBatch.from_arrays([ri.dictionary.take(pa.array(r)), rj.dictionary.take(pa.array(c)), pa.array(m)], ["i", "j", "v"])

        for r in range(0, len(ri.dictionary), ROWS):
            at = slice(*np.searchsorted(i, [r, r + ROWS]))
            ks, rk = np.unique(pk[at], return_inverse=True)
            n, rows = terms[pk[at]], min(ROWS, len(ri.dictionary) - r)
            if finite and rows * len(ks) * size <= 64 * n.sum():
                on = np.flatnonzero(np.isin(qk, ks))
                on = on[np.argsort(j[on], kind="stable")]
                ok, oj = np.searchsorted(ks, qk[on]), j[on]
                for c in range(0, size, COLS):
                    z = slice(*np.searchsorted(oj, [c, c + COLS]))
                    m = np.zeros((rows, min(COLS, size - c)))
                    for k in range(0, len(ks), block):
                        u, w = np.zeros((rows, min(block, len(ks) - k))), np.zeros((min(block, len(ks) - k), m.shape[1]))
                        e, g = (rk >= k) & (rk < k + block), (ok[z] >= k) & (ok[z] < k + block)
                        np.add.at(u, (i[at][e] - r, rk[e] - k), pv[at][e])
                        np.add.at(w, (ok[z][g] - k, oj[z][g] - c), qv[on[z]][g])
                        m += u @ w
                    e, g = np.nonzero(m)
                    yield send(r + e, c + g, m[e, g])
                continue
            # whole rows of a, about TERMS products at a time
            ends = np.flatnonzero(np.diff(i[at], append=-1)) + 1
            upto, begin = np.cumsum(n)[ends - 1] if len(ends) else [], 0
            while begin < len(n):
                done = upto[np.searchsorted(ends, begin, side="right") - 1] if begin else 0
                e = ends[max(np.searchsorted(ends, begin, side="right"), np.searchsorted(upto, done + TERMS, side="right") - 1)]
                some = slice(at.start + begin, at.start + e)
                m, start = n[begin:e], first[pk[some]]
                pos = np.repeat(start - (np.cumsum(m) - m), m) + np.arange(m.sum())
                key = np.repeat(i[some].astype("int64"), m) * size + j[pos]
                key, where = np.unique(key, return_inverse=True)
                got = np.bincount(where, np.repeat(pv[some], m) * qv[pos], len(key))
                begin = e
                if len(key):
                    yield send((key // size)[got != 0], (key % size)[got != 0], got[got != 0])

    return x.unionByName(y).groupBy("ip", "jp").applyInArrow(product, f"i {ki}, j {kj}, v double")


def sparse_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "_b"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_b")).alias("v")).where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_norms(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"), F.count("*").alias("nnz"))


# validation


def missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, share): nulls, and NaN in floating columns."""
    bad = lambda f: F.col(f.name).isNull() | F.isnan(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).isNull()
    one = df.agg(F.count("*").alias("_n"), *(F.sum(bad(f).cast("long")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_missing"), F.coalesce(F.try_divide(f"c{i}", "_n"), F.lit(0.0)).alias("share")) for i, f in enumerate(df.schema.fields)))).alias("x")).select("x.*")


def near_duplicates(df: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """Rows that agree in all columns after rounding to the tolerance, with their group's size."""
    keys = [F.round(F.col(c) / tolerance) for c in columns]
    g = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.withColumns({f"_k{i}": k for i, k in enumerate(keys)}).join(g, [f"_k{i}" for i in range(len(keys))]).drop(*(f"_k{i}" for i in range(len(keys))))


def temporal_violations(df: DataFrame, by: list[str], order: str, t: str, min_gap: float | None = None, max_gap: float | None = None) -> DataFrame:
    """Rows whose time goes back, repeats, or leaves the gap bounds: (keys, order, violation)."""
    d = F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(order))
    v = F.when(d < 0, "monotonic").when(d == 0, "duplicate")
    v = v.when(d < min_gap, "min_gap") if min_gap is not None else v
    v = v.when(d > max_gap, "max_gap") if max_gap is not None else v
    return df.select(*by, order, v.alias("violation")).where("violation IS NOT NULL")


def bounds_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_checked, n_failed): rows on which a condition is not true."""
    one = df.agg(F.count("*").alias("_n"), *(F.sum(F.when(c, 0).otherwise(1)).alias(f"r{i}") for i, c in enumerate(rules.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col("_n").alias("n_checked"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n_failed")) for i, k in enumerate(rules)))).alias("x")).select("x.*")


def low_variance(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """The columns whose sample variance reaches the threshold."""
    v = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first()
    return [c for c in columns if (v[c] or 0.0) >= threshold]


def column_transform(df: DataFrame, parts: list[tuple[list[str], object]], remainder: str = "drop") -> DataFrame:
    """Apply Column -> Column functions to subsets; outputs in declared order, passed-through columns last."""
    used = {c for cols, _ in parts for c in cols}
    out = [f(F.col(c)).alias(c) for cols, f in parts for c in cols]
    return df.select(*out, *(c for c in df.columns if remainder == "passthrough" and c not in used))


def branch(df: DataFrame, selector: Column, branches: dict[str, object]) -> DataFrame:
    """Rows go to the branch (DataFrame -> DataFrame) that the selector names; an unknown name is an error."""
    known = F.when(selector.isin(list(branches)), selector).otherwise(F.raise_error(F.concat(F.lit("unknown branch: "), selector.cast("string"))))
    d = df.withColumn("_branch", known)
    out = None
    for name, f in branches.items():
        part = f(d.where(F.col("_branch") == name).drop("_branch"))
        out = part if out is None else out.unionByName(part)
    return out
