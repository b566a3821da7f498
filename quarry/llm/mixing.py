"""Mixing to target weights with soft domain membership.

A classifier learned from a table of labels predicts each document's domain
posteriors p (multinomial logistic regression over shape features of the
text). Rates x >= 0 for all documents are then fitted so that the expected
tokens of each domain, sum(x * tokens * p), match targets: projected gradient
descent on the squared misses, from x = 1, in the metric that weighs a document
by its tokens, so documents with the same posteriors get the same rate and
rates move no further from 1 than the targets need.

Posteriors are rounded to 1 / ``GRID``; documents with equal posteriors are
added up before the descent, whose every step is one aggregation over that
table. Only one number per domain comes to the driver.

Null and empty texts have no tokens; they get the posteriors of their shape,
and a rate like any other. A null id is kept, repeated rows get the same rate,
and so do rows of equal posteriors. Training sees at most
``MAX_DOCS`` labelled documents, by hash of the id; without two labels in them
every document belongs wholly to the one domain (or to ``None``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import base, kernels

MAX_DOCS = 1500
GRID = 256
#: Steps at most, and the largest miss as a share of all tokens at which the descent ends.
STEPS, MISS = 400, 1e-4
#: Steps without a better miss after which it ends too.
PATIENCE = 12


def shape(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features (texts, n), words) of each text."""
    n = len(off) - 1
    starts, ends, first = kernels.words(data, off)
    size = np.maximum(np.diff(off), 1)
    words_n = np.diff(first)
    many = np.maximum(words_n, 1)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][off]) / of

    low = kernels.LOWER[data]
    hashes = kernels.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    line_starts, line_ends, line_first = kernels.words(data, off, np.arange(256) == 10)
    lines = kernels.word_hashes(data, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    word_text = np.repeat(np.arange(n), words_n)

    def distinct(units: np.ndarray, text: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of distinct units, share of the most frequent one)."""
        order = np.lexsort((units, text))
        u, t = units[order], text[order]
        new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (t[1:] != t[:-1])]) if len(u) else np.zeros(0, np.int64)
        k = np.diff(np.r_[new, len(u)])
        top = np.zeros(n)
        np.maximum.at(top, t[new], k)
        c = np.maximum(counts, 1)
        return np.bincount(t[new], minlength=n) / c, top / c

    ttr, top = distinct(hashes, word_text, words_n)
    line_n = np.diff(line_first)
    line_ttr, line_top = distinct(lines, np.repeat(np.arange(n), line_n), line_n)
    mark = (data < 128) & kernels.NON_WORD[data] & ~kernels.SPACE[data]
    letters = ~kernels.NON_LETTER[data]
    cols = [
        np.log1p(words_n), share(mark, size), share((data >= 65) & (data <= 90), size), share((data >= 48) & (data <= 57), size), share(kernels.SPACE[data], size), share(letters, size),
        np.log1p(size / many), ttr, ttr * np.log1p(words_n), top, line_ttr, line_top, np.log1p(words_n / np.maximum(line_n, 1)), share((data == 46) | (data == 44), many), share((data == 33) | (data == 124) | (data == 42) | (data == 36) | (data == 37) | (data == 38) | (data == 35), many),
    ]
    x = np.stack(cols, 1) if n else np.zeros((0, len(cols)))
    return x, words_n


@dataclass
class Classifier:
    names: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], 1)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if len(self.names) < 2:
            return np.ones((len(x), 1))
        s = self.expand(x) @ self.weights
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, labels: list) -> Classifier:
    """Multinomial logistic regression by accelerated gradient descent, lightly regularised."""
    names = sorted(set(labels))
    c = Classifier(names or [None], x.mean(0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(0), 1e-6) if len(x) else np.ones(x.shape[1]), np.zeros((1 + 2 * x.shape[1], max(len(names), 1))))
    if len(names) < 2:
        return c
    f = c.expand(x)
    y = np.eye(len(names))[[names.index(v) for v in labels]]
    rate = 1.0 / (0.5 * np.linalg.norm(f, 2) ** 2 / len(f) + 1e-3)
    w = v = c.weights
    for t in range(1500):
        s = f @ v
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - rate * (f.T @ (p - y) / len(f) + 1e-3 * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    c.weights = w
    return c


def fit_classifier(docs: DataFrame, labels: DataFrame, column: str, max_docs: int = MAX_DOCS) -> Classifier:
    """Learn the domain ``column`` of labels(doc_id, column) from at most ``max_docs`` documents."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("_domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # at most max_docs ids
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text or ""))
    parts = [shape(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]]
    for i in range(0, len(rows), 64):  # a few texts at a time bound the driver's memory
        raw = [(r.text or "").encode("utf-8", "replace") for r in rows[i : i + 64]]
        parts.append(shape(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0])
    return train(np.concatenate(parts), [r._domain for r in rows])


def membership(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with ``_tokens`` long and ``_p`` array<double> (by domain, multiples of 1 / GRID that add up to 1), in place of columns of these names."""
    docs = docs.drop("_tokens", "_p")
    base.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in base.pieces(batch, "text"):
                x, n = shape(data, off)
                p = sent.value.posteriors(x)
                down = np.floor(p * GRID)
                left = (GRID - down.sum(1)).astype(np.int64)  # the largest remainders get what rounding down left
                rank = np.argsort(np.argsort(-(p * GRID - down), 1, kind="stable"), 1)
                p = (down + (rank < left[:, None])) / GRID
                k = p.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(p) + 1, k, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), lists], names=[*part.schema.names, "_tokens", "_p"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, _tokens long, _p array<double>")


def _rates(p: np.ndarray, misses: list[np.ndarray], step: float, most: float | None) -> np.ndarray:
    """Rates of documents with posteriors p after the steps with these misses (accelerated projected gradient)."""
    high = np.inf if most is None else most
    x = v = np.clip(np.ones(len(p)), 0.0, high)
    for t, miss in enumerate(misses):
        y = np.clip(v - step * (p @ miss), 0.0, high)
        v = np.clip(y + t / (t + 3) * (y - x), 0.0, high)
        x = y
    return v


def fit_rates(groups: DataFrame, target: list[float], most: float | None = None) -> DataFrame:
    """groups(_p, _tokens) with ``rate`` added, so that sum(rate * _tokens * _p) comes to ``target`` (tokens by domain).

    Projected gradient descent with momentum, rates in [0, most]. A rate follows from the posteriors and the
    misses of the steps so far, so a step is one aggregation that replays them, and its state is a number per
    domain. It ends at the miss of the module, or when ``PATIENCE`` steps bring no better one (targets out of reach).
    """
    k = len(target)
    base.ship(groups.sparkSession)
    groups = groups.select("_p", "_tokens")
    one = groups.agg(F.sum("_tokens").alias("n"), *(F.sum(F.col("_tokens") * F.col("_p")[i] * F.col("_p")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    total = float(one.n or 0)
    m = np.array([[one[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) / max(total, 1.0)
    step = 1.0 / max(float(np.linalg.eigvalsh(m).max()), 1e-12)
    goal = np.array(target, float)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        p = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, k)
        return p, np.asarray(batch.column(1), dtype=np.float64)

    def sums(misses: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, n = arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (_rates(p, misses, step, most) * n) @ p], names=[f"s{i}" for i in range(k)])

        row = groups.mapInArrow(run, ", ".join(f"s{i} double" for i in range(k))).agg(*(F.sum(f"s{i}") for i in range(k))).first()
        return np.array([v or 0.0 for v in row])

    misses: list[np.ndarray] = []
    best, kept, stale = float("inf"), 0, 0
    while total and len(misses) < STEPS:
        miss = (sums(misses) - goal) / total
        size = float(np.sqrt((miss * miss).sum()))  # what the descent lowers; one domain may stay out of reach
        if size < best - MISS / 10:
            best, kept, stale = size, len(misses), 0
        else:
            stale += 1
        if np.abs(miss).max() < MISS or stale >= PATIENCE:
            break
        misses.append(miss)
    misses = misses[:kept]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(arrays(batch)[0], misses, step, most))], names=["_p", "_tokens", "rate"])

    return groups.mapInArrow(final, "_p array<double>, _tokens long, rate double")


def mix(docs: DataFrame, labels: DataFrame, column: str, weights: dict, tokens: float | None = None, most: float | None = None) -> DataFrame:
    """docs with _tokens, _p and ``_rate`` added (in place of columns of these names).

    ``weights`` gives each domain's share; ``tokens`` the share of all tokens that the mix comes to in
    expectation, ``most`` the largest rate. By default that is all tokens; with ``most`` as many as the
    domain of the greatest weight can bear at that rate, and a domain that has too few tokens for its share
    then gives what it has. So targets are in reach. Domains without a weight get none.
    """
    docs = docs.drop("_tokens", "_p", "_rate")
    model = fit_classifier(docs, labels, column)
    held = membership(docs, model)
    groups = base.materialize(held.groupBy("_p").agg(F.sum("_tokens").alias("_tokens")))
    named = list(model.names)
    has = groups.agg(*(F.sum(F.col("_tokens") * F.col("_p")[i]) for i in range(len(named)))).first()
    has = [float(v or 0) for v in has]
    whole = sum(weights.values())
    share = [weights.get(x, 0.0) / whole for x in named] if len(named) > 1 else [1.0]
    total = sum(has)
    if tokens is not None:
        total *= tokens
    elif most is not None:
        lead = max(range(len(share)), key=lambda i: share[i])
        total = most * has[lead] / share[lead] if share[lead] else 0.0
    target = [total * w if tokens is not None or most is None else min(total * w, most * h) for h, w in zip(has, share)]
    rates = base.materialize(fit_rates(groups, target, most).select("_p", F.col("rate").alias("_rate")))
    return held.join(base.small(rates, 96 * rates.count()), "_p").select(*docs.columns, "_tokens", "_p", "_rate")


def drawn(mixed: DataFrame) -> DataFrame:
    """The rows of a mix that stay when each is kept with probability min(rate, 1), by hash of the id."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return mixed.where(u < F.col("_rate"))
