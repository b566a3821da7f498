"""Exact top-k search by inner product: columnar branch and bound.

Candidates are held dimension by dimension. Partial scores grow block by
block; after each block a candidate stays only while its partial score plus
the product of both remaining norms (the remaining mass) can still reach a
query's k-th best score, and the survivors are compacted. Queries go to the
executors in blocks of bounded size; each task returns its own top k of each
query, and a window picks the best of these.

Components are ``floor(scale * x)`` with x as double, a long (what is outside
the range of long counts as its nearest end), and so is a score. Sums that
could leave the range are added as unbounded integers. A
vector that is null or has a null or non-finite component takes no part, and
neither does a null id. Vectors of different length do not meet. Rows that
share an id are one candidate (its best score), and none of a query's own id.
An empty vector scores 0 against other empty vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import base

#: Queries that are on the executors at a time.
QUERY_BLOCK = 4096
#: Dimensions a step adds; queries that share a compaction; candidates a step looks at.
DIMS, GROUP, ROWS = 8, 32, 8192
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<long>) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine: Column = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


class _Best:
    """Running top k of a group of queries: scores descend, ties by smaller id, ids distinct."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64) for _ in range(n)]
        self.ids = [np.zeros(0, np.int64) for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, ~s))  # ~s descends as s ascends, and cannot overflow
        s, i = s[order], i[order]
        _, once = np.unique(i, return_index=True)  # the first, so the best, of each id
        once.sort()
        s, i = s[once][: self.k], i[once][: self.k]
        self.score[q], self.ids[q] = s, i
        if len(s) == self.k:
            self.floor[q] = s[-1]


def _rests(x: np.ndarray) -> np.ndarray:
    """Norms of what is left from each block on: (blocks + 1, rows); x is (dims, rows)."""
    d = len(x)
    sq = np.zeros((-(-d // DIMS) + 1, x.shape[1]))
    for b in range(len(sq) - 2, -1, -1):
        part = x[b * DIMS : (b + 1) * DIMS].astype(np.float64)
        sq[b] = sq[b + 1] + (part * part).sum(0)
    return np.sqrt(sq)


def _search(x: np.ndarray, ids: np.ndarray, rest: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_rest: np.ndarray, best: _Best, lo: int) -> None:
    """Queries lo to lo + len(q) of best against candidates x (dims, rows)."""
    at = np.arange(x.shape[1])
    part = np.zeros((len(q), len(at)), x.dtype)
    floor = best.floor[lo : lo + len(q)][:, None]
    for b in range(-(-len(x) // DIMS)):
        part = part + q[:, b * DIMS : (b + 1) * DIMS] @ x[b * DIMS : (b + 1) * DIMS][:, at]
        bound = part + q_rest[b + 1][:, None] * rest[b + 1][at][None, :]
        alive = (bound * (1 + 1e-12 * np.sign(bound)) + 1e-6 >= floor).any(0)
        if not alive.all():
            at, part = at[alive], part[:, alive]
        if not len(at):
            return
    for j in range(len(q)):
        ok = np.flatnonzero((part[j] >= best.floor[lo + j]) & (ids[at] != q_ids[j]))
        if len(ok) > 4 * best.k and part.dtype != object:  # ties stay in; the sort is for the few that can win
            cut = np.partition(part[j][ok], len(ok) - best.k)[len(ok) - best.k] if len(np.unique(ids[at[ok]])) == len(ok) else -np.inf
            ok = ok[part[j][ok] >= cut]
        if len(ok):
            found = part[j][ok]
            best.add(lo + j, (np.clip(found, _LEAST, _MOST) if found.dtype == object else found).astype(np.int64), ids[at[ok]])


def _top(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_len = {}
        for d, (q_ids, q) in queries.value.items():
            by_len[d] = (q_ids, q, _rests(q.T), _Best(len(q_ids), k))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            ids = base.longs(batch, "id")
            lens = np.diff(np.asarray(lists.offsets))
            flat, off = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for d in np.unique(lens):
                if int(d) not in by_len:
                    continue
                q_ids, q, q_rest, best = by_len[int(d)]
                rows = np.flatnonzero(lens == d)
                for r in range(0, len(rows), ROWS):
                    take = rows[r : r + ROWS]
                    x = flat[off[take][:, None] + np.arange(d)].T
                    # doubles are exact while every sum stays below 2**53, longs below 2**63
                    big = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(int(d), 1)
                    kind = np.float64 if big < 2**53 else np.int64 if big < 2**62 else object
                    x, rest = np.ascontiguousarray(x.astype(kind)), _rests(x)
                    for lo in range(0, len(q_ids), GROUP):
                        part = slice(lo, lo + GROUP)
                        _search(x, ids[take], rest, q[part].astype(kind), q_ids[part], q_rest[:, part], best, lo)
        for q_ids, _, _, best in by_len.values():
            n = [len(s) for s in best.score]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query, ties to the smaller id.

    ``queries`` has the columns of ``vectors``; of query rows that share an id the least vector counts.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    spark = vectors.sparkSession
    base.ship(spark)
    rows = quantized(vectors, id_col, vec_col, scale)
    asked = base.materialize(quantized(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() // block)
    found = None
    for b in range(blocks):
        held: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toLocalIterator():  # a block of bounded size
            ids, vs = held.setdefault(len(r.v), ([], []))
            ids.append(r.id)
            vs.append(r.v)
        sent = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), d)) for d, (i, v) in held.items()})
        part = rows.mapInArrow(_top(sent, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = base.materialize(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
