"""Document fingerprints by locally consistent parsing.

A text's code points are parsed level by level. On each level a run of equal
symbols becomes one symbol; deterministic coin tossing (the lowest bit in which
a symbol differs from its left neighbour, and that bit, four times over)
shrinks the alphabet to a handful of labels; local maxima of the labels start
the phrases, whose names are hashes of their symbols and are the next level's
symbols. A phrase depends on a few neighbours only, so equal substrings have
the same phrases inside wherever they stand.

The fingerprint is a bottom-k sketch of the phrase names of two levels, the
same at every length: the second (about ten code points) and the third. Likeness of two fingerprints is the share of
common values among the k least of both (an estimate of the Jaccard
coefficient of the phrase sets). An empty or null text has the empty
fingerprint, which is like itself only. Names of a level are 64-bit hashes, of
which the sketch keeps 32 bits; ties cannot occur, equal values are one. Rows
that share an id follow each other by text, and one id's rows are one task's. A
very long text is parsed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import base, kernels

K = 64
TOSSES = 3


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 16 of neighbours that differ; ``first`` marks the texts' first symbols."""
    x = x.astype(np.uint32)
    for _ in range(TOSSES + 1):
        d = np.empty_like(x)
        d[0] = 0
        np.bitwise_xor(x[1:], x[:-1], out=d[1:])
        d[first] = x[first]
        at = np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1))
        bits = 8 * x.dtype.itemsize
        at = np.minimum(at, bits - 1).astype(x.dtype)
        x = (at * x.dtype.type(2) + (x >> at & x.dtype.type(1))).astype(np.uint8)
    return x


def parse(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and text offsets of the next level; x: symbols (uint64) of all texts."""
    n = len(x)
    if not n:
        return x, off
    head = np.zeros(n + 1, bool)
    head[off[:-1]] = True
    head = head[:n]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new |= head
    if not new.all():  # runs become one symbol that knows its length
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, n]).astype(np.uint64)
        y = x[at]
        many = size > 1
        y[many] = kernels.mix(y[many] ^ (size[many] * np.uint64(0xA0761D6478BD642F)))
        off = np.searchsorted(at, off)
        x, n = y, len(at)
        head = np.zeros(n + 1, bool)
        head[off[:-1]] = True
        head = head[:n]
    lab = _labels(x, np.flatnonzero(head)).astype(np.int8)
    left = np.empty(n, np.int8)
    left[0] = 127
    left[1:] = lab[:-1]
    right = np.empty(n, np.int8)
    right[-1] = 127
    right[:-1] = lab[1:]
    ends = off[1:] - 1
    right[ends[ends >= 0]] = 127  # a text knows nothing of the one after it
    cut = (lab >= left) & (lab > right)
    cut[head] = True
    starts = np.flatnonzero(cut)
    names = kernels.span_hashes(x, starts, np.r_[starts[1:], n])
    return names, np.searchsorted(starts, off)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and offsets."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), np.cumsum([0, *(len(r) // 4 for r in raw)])


def prints(texts: list[str], k: int = K) -> list[np.ndarray]:
    """Sorted uint32 sketch of each text."""
    x, off = symbols(texts)
    levels = []
    for _ in range(3):
        x, off = parse(x, off)
        levels.append(((kernels.mix(x ^ np.uint64(len(levels))) >> np.uint64(32)).astype(np.uint32), off))
    out = []
    for d in range(len(texts)):
        out.append(np.unique(np.concatenate([v[o[d] : o[d + 1]] for v, o in levels[1:]]))[:k])
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:k]
    return float(np.isin(least, a).__and__(np.isin(least, b)).sum() / len(least))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of each row."""
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in base.pieces(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_of(p) for p in prints(texts, k)])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def _part(bounds: list[int]) -> Column:
    """How many bounds are below or at key, by halving."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") < bounds[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(k: int):
    """Rows come by part, then own rows before the guest, each in the order of documents."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        own = prints(texts, k)
        live = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = []
        for i in live:
            m = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - m] + texts[i + 1][:m])
        new = prints(edited, k)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in live], pa.int64()),
                pa.array([len(texts[i]) for i in live], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([text_of(own[i]) for i in live], pa.string()),
                pa.array([text_of(p) for p in new], pa.string()),
                pa.array([likeness(own[i], p, k) for i, p in zip(live, new)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1], k) for i in live], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part, _, _ in base.pieces(batch, "text", base.CHUNK_BYTES // 2):
                cols = part.to_pydict()
                held += zip(cols["part"], cols["guest"], cols["doc_id"], (t or "" for t in cols["text"]))
                if len(held) > 1:
                    yield solve(held)
                    held = held[-1:]

    return run


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (whole code points) replaced by as much of the start of the
    next document's text. Documents follow each other by descending doc_id (null last), rows of one
    id by text (null first); after the last comes the first. The id range is cut into parts of about equal
    counts; each part also gets the first document of the part that follows.
    """
    spark = docs.sparkSession
    base.ship(spark)
    least = -(1 << 63)
    rows = docs.select("doc_id", "text").withColumn("key", F.coalesce("doc_id", F.lit(least)))
    n = base.shuffle_partitions(spark)
    bounds = sorted({int(b) for b in rows.select("key").stat.approxQuantile("key", [i / n for i in range(1, n)], max(1e-5, 0.2 / n))}) if n > 1 else []
    rows = rows.withColumn("part", _part(bounds))
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max("key").alias("top")).collect()}  # a row a part
    order = sorted(tops, reverse=True)
    follow = [(tops[b], a) for a, b in zip(order, order[1:] + order[:1])]
    guests = spark.createDataFrame(follow, "key long, to int").groupBy("key").agg(F.collect_list("to").alias("to"))
    asked = rows.join(F.broadcast(guests), "key", "left")  # at most a row a part
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    more = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest")))
    dealt = asked.select("doc_id", "key", "text", F.explode(F.concat(F.array(own), more)).alias("x")).select("x.part", "x.guest", "doc_id", "key", "text")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.desc("key"), "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_edit(k), OUT)
