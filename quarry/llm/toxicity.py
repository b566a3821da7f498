"""Toxicity scores by a bidirectional gated recurrent network with attention.

A word (letters and digits, A-Z lower-cased) enters as the sum of a learned
word vector (for words of a vocabulary learned from the training texts) and the
scaled sum of learned vectors of its byte trigrams, edges included. Two
recurrent passes read a window of ``WINDOW`` words, attention pools their
states, and a logistic unit scores the window. Windows start every ``STRIDE``
words and at the text's end, so that each overlaps the next; a text's score is
its best window's. A text shorter than a window is one window of its words, in
training behind a mask. Everything is trained in numpy.

Only texts are labelled, so training looks for the windows that carry the
label: it starts from naive Bayes weights and, each round, takes the
best-scoring window of each toxic text against the best-scoring and random
windows of the others. It sees at most ``MAX_TEXTS`` toxic texts and
``MAX_CLEAN`` others, by hash of the id.

A text without words (null, empty) scores 0; so does every text if the
training texts with words do not hold both labels. Rows that share an id are
texts of their own; an id with both labels counts as toxic. Ties between
windows go to the first, and no tie changes a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import base, kernels

WINDOW, STRIDE = 32, 16
MAX_TEXTS, MAX_CLEAN = 400, 1200
VOCABULARY = 2048
D_WORD, D_CHAR, HIDDEN = 6, 6, 8
_GRAM, _SLOTS = 1 << 15, 1 << 16
CUT = 0.7


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, trigram row of each byte, starts, first)."""
    low = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, off, kernels.NON_WORD)
    n = len(low)
    gram = np.zeros(n, np.int64)
    if n:
        # at each byte of a word the trigram around it, with 0 for what is outside the word
        d = np.where(kernels.NON_WORD[data], 0, low).astype(np.uint32)
        left, right = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        left[1:], right[:-1] = d[:-1], d[1:]
        left[starts], right[ends - 1] = 0, 0
        code = (left * np.uint32(0x85EBCA6B) ^ d) * np.uint32(0xC2B2AE35) ^ right
        gram = np.where(d > 0, 1 + ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)) % np.uint32(_GRAM - 1), 0).astype(np.int64)
    return kernels.word_hashes(low, starts, ends), gram, starts, first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, size) of all overlapping windows; the last one ends with the text."""
    n = np.diff(first)
    k = np.where(n == 0, 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1)
    text = np.repeat(np.arange(len(n)), k)
    i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    at = np.minimum(i * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, first[text] + at, np.minimum(n[text], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Weights, forward pass and gradients; rows of the tables at 0 stay zero."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        r = np.random.Generator(np.random.PCG64(seed))
        d = D_WORD + D_CHAR
        make = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.slots = np.zeros(_SLOTS, np.uint64)
        self.row = np.zeros(_SLOTS, np.int64)
        slot = (vocabulary >> np.uint64(48)).astype(np.int64)
        self.slots[slot[::-1]], self.row[slot[::-1]] = vocabulary[::-1], np.arange(len(vocabulary), 0, -1)
        self.w = {
            "word": make(len(vocabulary) + 1, D_WORD, k=0.05),
            "char": make(_GRAM, D_CHAR, k=0.05),
            "wf": make(d, 3 * HIDDEN, k=d**-0.5), "wb": make(d, 3 * HIDDEN, k=d**-0.5),
            "uf": make(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "ub": make(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5),
            "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
            "att": make(2 * HIDDEN, k=0.3), "out": make(2 * HIDDEN, k=0.5), "bias": np.full(1, -1, np.float32),
        }
        for k in ("word", "char"):
            self.w[k][0] = 0

    def rows(self, word: np.ndarray) -> np.ndarray:
        slot = (word >> np.uint64(48)).astype(np.int64)
        return np.where(self.slots[slot] == word, self.row[slot], 0)

    def inputs(self, rows: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Input vector of each word."""
        chars = np.add.reduceat(self.w["char"][gram], starts, axis=0) if len(starts) else np.zeros((0, D_CHAR), np.float32)
        return np.concatenate([self.w["word"][rows], chars], 1)

    def scan(self, x: np.ndarray, which: str, at: np.ndarray, keep: bool = False, live: np.ndarray | None = None):
        """States (steps, windows, HIDDEN) along the word numbers ``at`` (steps, windows); a step that is not ``live`` leaves the state."""
        u, h = self.w["u" + which], np.zeros((at.shape[1], HIDDEN), np.float32)
        states = np.empty((*at.shape, HIDDEN), np.float32)
        saved = []
        for t in range(len(at)):
            g, r = x[at[t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            if keep:
                saved.append((h, z, reset, c, r[:, 2 * HIDDEN :]))
            new = c + z * (h - c)
            h = new if live is None else np.where(live[t][:, None], new, h)
            states[t] = h
        return (states, saved) if keep else states

    def pool(self, s: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, attention, pooled) of states (steps, windows, 2 HIDDEN)."""
        a = s @ self.w["att"]
        if live is not None:
            a = np.where(live, a, np.float32(-1e9))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        v = np.einsum("tb,tbh->bh", a, s)
        return _sigmoid(v @ self.w["out"] + self.w["bias"]), a, v

    def score(self, vec: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Score of each window (first word, size)."""
        out = np.zeros(len(at), np.float32)
        xf, xb = vec @ self.w["wf"] + self.w["bf"], vec @ self.w["wb"] + self.w["bb"]
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            for lo in range(0, len(some), 4096):
                part = some[lo : lo + 4096]
                idx = at[part][None, :] + np.arange(n)[:, None]
                s = np.concatenate([self.scan(xf, "f", idx), self.scan(xb, "b", idx[::-1])[::-1]], 2)
                out[part] = self.pool(s)[0]
        return out

    def gradients(self, rows: np.ndarray, gram: np.ndarray, starts: np.ndarray, idx: np.ndarray, y: np.ndarray, live: np.ndarray | None = None) -> dict:
        """Gradients of the mean cross-entropy for windows idx (steps, windows) of words; only ``live`` steps count."""
        w, h2 = self.w, 2 * HIDDEN
        x = self.inputs(rows, gram, starts)
        pre = {"f": x @ w["wf"] + w["bf"], "b": x @ w["wb"] + w["bb"]}
        ids = {"f": idx, "b": idx[::-1]}
        lives = {"f": live, "b": None if live is None else live[::-1]}
        done = {k: self.scan(pre[k], k, ids[k], True, lives[k]) for k in "fb"}
        s = np.concatenate([done["f"][0], done["b"][0][::-1]], 2)
        p, a, v = self.pool(s, live)
        g: dict = {}
        dl = ((p - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = v.T @ dl, dl.sum(keepdims=True)
        dv = dl[:, None] * w["out"]
        da = np.einsum("bh,tbh->tb", dv, s)
        de = a * (da - (a * da).sum(0))
        ds = a[:, :, None] * dv[None] + de[:, :, None] * w["att"]
        g["att"] = np.einsum("tb,tbh->h", de, s)
        dx = np.zeros_like(x)
        for k, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[::-1, :, HIDDEN:])):
            dpre = np.zeros_like(pre[k])
            du, dh = np.zeros_like(w["u" + k]), np.zeros((idx.shape[1], HIDDEN), np.float32)
            for t in range(len(idx) - 1, -1, -1):
                h, z, reset, c, rc = done[k][1][t]
                dh = dh + part[t]
                past = 0
                if live is not None:
                    past, dh = np.where(lives[k][t][:, None], 0, dh), np.where(lives[k][t][:, None], dh, 0)
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * rc * reset * (1 - reset)
                back = np.concatenate([dz, dr, dc * reset], 1)
                np.add.at(dpre, ids[k][t], np.concatenate([dz, dr, dc], 1))
                du += h.T @ back
                dh = dh * z + back @ w["u" + k].T + past
            g["u" + k], g["b" + k], g["w" + k] = du, dpre.sum(0), x.T @ dpre
            dx += dpre @ w["w" + k].T
        size = np.diff(np.r_[starts, len(gram)])
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], rows, dx[:, :D_WORD])
        np.add.at(g["char"], gram[starts[0] if len(starts) else 0 :], np.repeat(dx[:, D_WORD:], size, 0))
        g["word"][0] = g["char"][0] = 0
        return g


def train(texts: list[str], toxic: list[int], rounds: int = 4, steps: int = 120, batch: int = 96, seed: int = 3) -> Network | None:
    """A network fitted to the texts' labels; None without both labels."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    r = np.random.Generator(np.random.PCG64(seed))
    raw = [t.encode("utf-8", "replace") for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    parts, n_bytes, n_words = [], 0, 0
    for i in range(0, len(raw), 64):  # a few texts at a time bound the driver's memory
        some = raw[i : i + 64]
        w, g, at, f = tokens(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        parts.append((w, g.astype(np.int32), at + n_bytes, f[:-1] + n_words))
        n_bytes, n_words = n_bytes + sum(map(len, some)), n_words + len(w)
    del raw
    word, gram, starts, first = (np.concatenate(x) for x in zip(*parts))
    first = np.r_[first, n_words]
    del parts
    worded = np.diff(first) > 0
    if not (worded & (y == 1)).any() or not (worded & (y == 0)).any():
        return None
    size = np.diff(np.r_[starts, n_bytes])

    def weights(units: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, texts with it) of each unit, by presence in a text; text by text, which needs little memory."""
        has = np.zeros((2, n))
        for d, k in enumerate(toxic):
            has[k, np.unique(units[bounds[d] : bounds[d + 1]])] += 1
        total = [(y == k).sum() for k in (0, 1)]
        return np.log((has[1] + 0.3) / (total[1] + 0.6)) - np.log((has[0] + 0.3) / (total[0] + 0.6)), has[0] + has[1]

    kinds, code = np.unique(word, return_inverse=True)
    odds, seen = weights(code, first, len(kinds))
    worth = np.where(seen >= 3, np.abs(odds) * np.sqrt(seen), 0)
    vocabulary = kinds[np.lexsort((kinds, -worth))][:VOCABULARY]
    net = Network(vocabulary, seed)
    rows = net.rows(word)
    of = dict(zip(kinds.tolist(), np.clip(odds, -2, 6)))
    net.w["word"][1:, 0] = [0.5 * of[v] for v in vocabulary.tolist()]
    g_odds, g_seen = weights(gram, off, _GRAM)
    net.w["char"][1:, 0] = (0.3 * np.clip(g_odds, -1, 6) * (g_seen >= 3))[1:]
    # the first choice of windows: naive Bayes over words and trigrams
    hint = np.where(g_seen >= 5, np.clip(g_odds, 0, 6), 0).astype(np.float32)
    hint[0] = 0
    strong = np.maximum(np.where(seen[code] >= 3, odds[code], 0), np.add.reduceat(hint[gram], starts) / 3)
    text, at, length = windows(first)
    value = np.array([strong[a : a + n].max() for a, n in zip(at, length)])

    def scored() -> np.ndarray:
        """Scores of all windows, 64 texts at a time."""
        out, ends = [], np.r_[starts, n_bytes]
        for i in range(0, len(y), 64):
            w0, w1 = first[i], first[min(i + 64, len(y))]
            if w0 < w1:
                mine = (text >= i) & (text < i + 64)
                vec = net.inputs(rows[w0:w1], gram[ends[w0] : ends[w1]], starts[w0:w1] - ends[w0])
                out.append(net.score(vec, at[mine] - w0, length[mine]))
        return np.concatenate(out)

    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step = np.arange(int(length.max()))[:, None]
    t = 0
    for turn in range(rounds):
        if turn:
            value = scored()
        best = np.lexsort((-value, text))
        best = best[np.r_[True, text[best][1:] != text[best][:-1]]]  # each text's best window
        hot = best[y[text[best]] == 1]
        cold_best = best[y[text[best]] == 0]
        cold = np.flatnonzero(y[text] == 0)
        for _ in range(steps):
            pick = np.r_[r.choice(hot, batch // 3), r.choice(cold_best, batch // 3), r.choice(cold, batch - 2 * (batch // 3))]
            live = step < length[pick][None, :]
            flat = np.where(live, at[pick][None, :] + step, at[pick][None, :]).ravel()  # what is not live reads the first word
            sz = size[flat]
            bytes_ = np.repeat(starts[flat] - (np.cumsum(sz) - sz), sz) + np.arange(int(sz.sum()))
            local = np.arange(live.size).reshape(live.shape)
            grads = net.gradients(rows[flat], gram[bytes_], np.cumsum(sz) - sz, local, y[text[pick]], None if live.all() else live)
            t += 1
            rate = 0.02 if turn < rounds - 1 else 0.006
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def score_texts(net: Network | None, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Score of each text, 0 to 1."""
    out = np.zeros(len(off) - 1)
    if net is None:
        return out
    word, gram, starts, first = tokens(data, off)
    text, at, size = windows(first)
    if len(text):
        p = net.score(net.inputs(net.rows(word), gram, starts), at, size)
        lead = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        out[text[lead]] = np.maximum.reduceat(p, lead)
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, max_texts: int = MAX_TEXTS, max_clean: int = MAX_CLEAN) -> Network | None:
    """A network from at most ``max_texts`` toxic and ``max_clean`` other eligible ids; labels(doc_id, toxic)."""
    known = labels.where(eligible & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for k, most in ((0, max_clean), (1, max_texts)):
        some = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").collect()  # at most max_texts + max_clean ids
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    net = train([r.text for r in rows], [r.toxic for r in rows])
    del rows
    base.trim()
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with ``_toxicity`` added (in place of a column of that name); the text column is ``text``."""
    spark, docs = docs.sparkSession, docs.drop("_toxicity")
    base.ship(spark)
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in base.pieces(batch, "text", base.CHUNK_BYTES // 2):
                p = score_texts(sent.value, data, off)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, "_toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, _toxicity double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out, then score all: doc_id, held_out, score, predicted."""
    from quarry.llm.crf import held_out

    net = fit(docs, labels, ~held_out())
    s = score(docs.select("doc_id", "text"), net)
    return s.select("doc_id", held_out().alias("held_out"), F.col("_toxicity").alias("score"), F.when(F.col("_toxicity") >= CUT, 1).otherwise(0).alias("predicted"))
