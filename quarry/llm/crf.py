"""Language identification by a linear-chain conditional random field.

Every word (a run of letters, A-Z lower-cased) is labelled with a language.
Its features are its affixes (the first and last one to three bytes), its byte
trigrams and its entry in a lexicon learned from the training texts; learned
transitions join neighbouring words, and forward-backward gives each word's
posterior. A chain is a line, cut after ``CHAIN`` words. A text's language is
the one with the greatest mean posterior (ties: the smaller name), its score
that mean.

Training sees at most ``MAX_DOCS`` texts for each language, and fewer where
there are so many languages that this would be more than ``MAX_ROWS`` in all
(more languages than that are an error), by hash of the id; its chains mix
stretches of several languages, so that switches are learned too. Rows that
share an id are texts of their own, labelled with that id's languages.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import base, kernels

MAX_DOCS = 250
MAX_ROWS = 16_000
CHAIN = 128
LEXICON = 4000
_AFFIX, _GRAM, _LEX = 1 << 15, 1 << 15, 1 << 16


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(affixes (words, 6), grams of each byte, lexicon entry): rows of the weight tables, 0 where there is none."""
    d = kernels.LOWER[data].astype(np.uint32)
    n = len(d)
    size = ends - starts
    affix = np.zeros((len(starts), 6), np.int64)
    code_a, code_b = np.full(len(starts), 7, np.uint32), np.full(len(starts), 11, np.uint32)
    for k in range(3):
        has = size > k
        a, b = d[np.minimum(starts + k, n - 1)], d[np.maximum(ends - 1 - k, 0)]
        code_a, code_b = code_a * np.uint32(0x01000193) ^ a, code_b * np.uint32(0x85EBCA6B) ^ b
        for at, code in ((k, code_a), (3 + k, code_b)):
            affix[has, at] = 1 + ((code[has] * np.uint32(0x9E3779B1)) >> np.uint32(17)) % np.uint32(_AFFIX - 1)
    gram = np.zeros(n, np.int64)
    if n > 2:
        code = (d[:-2] * np.uint32(0x85EBCA6B) ^ d[1:-1]) * np.uint32(0xC2B2AE35) ^ d[2:]
        inside = np.zeros(n + 1, np.int32)  # bytes from which a trigram of one word starts
        long = size > 2
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - 2, -1)
        ok = np.cumsum(inside)[: n - 2] > 0
        gram[: n - 2] = np.where(ok, 1 + ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)) % np.uint32(_GRAM - 1), 0)
    word = kernels.word_hashes(kernels.LOWER[data], starts, ends)
    slot = (word >> np.uint64(48)).astype(np.int64)
    return affix, gram, np.where(lexicon[slot] == word, slot + 1, 0)


class Model:
    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.affix, self.gram, self.lex = (np.zeros((k, n), np.float32) for k in (_AFFIX, _GRAM, _LEX + 1))
        self.move, self.first = np.zeros((n, n), np.float32), np.zeros(n, np.float32)

    def emissions(self, f: tuple, starts: np.ndarray) -> np.ndarray:
        affix, gram, lex = f
        e = self.lex[lex]
        for k in range(6):
            e = e + self.affix[affix[:, k]]
        return e + np.add.reduceat(self.gram[gram], starts, axis=0) if len(starts) else e

    def posteriors(self, e: np.ndarray, chain: np.ndarray, size: np.ndarray, expected: bool = False):
        """Posterior of each word; chain: first word of each chain (they follow each other), size: its words.
        With ``expected``, also the expected transitions and first labels."""
        order = np.argsort(-size, kind="stable")
        chain, size = chain[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # chains longer than t
        e = np.exp(e - e.max(1, keepdims=True))
        move, first = np.exp(self.move), np.exp(self.first)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = e[chain] * first
        a /= a.sum(1, keepdims=True)
        alpha[chain] = a
        for t in range(1, len(live)):
            at = chain[: live[t]] + t
            a = (a[: live[t]] @ move) * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        moves = np.zeros_like(self.move)
        for t in range(len(live) - 1, 0, -1):
            at = chain[: live[t]] + t
            b = e[at] * beta[at]
            if expected:
                pair = alpha[at - 1][:, :, None] * move[None] * b[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b = b @ move.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        return (p, moves, p[chain].sum(0)) if expected else p


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    return data, *kernels.words(data, off, kernels.NON_LETTER)


def train(texts: list[str], langs: list[str], epochs: int = 3, seed: int = 7) -> Model | None:
    """Adagrad on the log-likelihood of chains that mix stretches of the texts."""
    names = sorted(set(langs))
    if not names:
        return None
    data, starts, ends, first = _spans([t.encode("utf-8", "replace") for t in texts])
    y = np.repeat([names.index(x) for x in langs], np.diff(first)).astype(np.int64)
    word = kernels.word_hashes(kernels.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    kinds, counts = np.unique(word, return_counts=True)
    lexicon = np.zeros(_LEX, np.uint64)
    top = kinds[np.lexsort((kinds, -counts))][:LEXICON][::-1]  # of words that share a slot the most frequent stays
    lexicon[(top >> np.uint64(48)).astype(np.int64)] = top
    model = Model(names, lexicon)
    if len(names) == 1 or not len(starts):
        return model
    affix, gram, lex = features(data, starts, ends, lexicon)
    rng = np.random.Generator(np.random.PCG64(seed))
    sums = [np.full_like(x, 1e-6) for x in (model.affix, model.gram, model.lex, model.move, model.first)]

    def step(table: np.ndarray, total: np.ndarray, rows, grad: np.ndarray) -> None:
        if rows is not None:
            rows, at = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(at, grad[:, c], len(rows)) for c in range(grad.shape[1])], 1).astype(np.float32)
            g[rows == 0] = 0
        else:
            rows, g = slice(None), grad.astype(np.float32)
        total[rows] += g * g
        table[rows] += 0.3 * g / np.sqrt(total[rows])

    n = len(starts)
    for _ in range(epochs):
        cuts = np.unique(np.r_[0, np.cumsum(rng.integers(4, 40, n // 4 + 1)), first])
        cuts = cuts[cuts < n]
        order = rng.permutation(len(cuts))
        stop = np.r_[cuts[1:], n]
        line = np.concatenate([np.arange(cuts[i], stop[i]) for i in order])
        for at in range(0, n, 64 * 128):
            w = line[at : at + 64 * 128]
            e = model.lex[lex[w]] + sum(model.affix[affix[w, k]] for k in range(6))
            size = ends[w] - starts[w]
            byte = np.repeat(starts[w] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            owner = np.repeat(np.arange(len(w)), size)
            e = e + np.add.reduceat(model.gram[gram[byte]], np.cumsum(size) - size, axis=0)
            chain = np.arange(0, len(w), 64)
            sizes = np.minimum(64, len(w) - chain)
            p, moves, heads = model.posteriors(e, chain, sizes, True)
            truth = np.zeros_like(p)
            truth[np.arange(len(w)), y[w]] = 1
            g = truth - p
            step(model.lex, sums[2], lex[w], g)
            for k in range(6):
                step(model.affix, sums[0], affix[w, k], g)
            step(model.gram, sums[1], gram[byte], g[owner])
            real = np.zeros_like(moves)
            inner = np.arange(len(w)) % 64 != 0
            np.add.at(real, (y[w][:-1][inner[1:]], y[w][1:][inner[1:]]), 1)
            step(model.move, sums[3], None, real - moves)
            step(model.first, sums[4], None, np.bincount(y[w][chain], minlength=len(names)) - heads)
    return model


def label(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each word, first word of each text)."""
    starts, ends, first = kernels.words(data, off, kernels.NON_LETTER)
    n = len(starts)
    if not n:
        return np.zeros((0, len(model.langs)), np.float32), first
    breaks = np.cumsum(data == 10)[starts] if len(data) else np.zeros(n)
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = breaks[1:] != breaks[:-1]
    new[first[:-1][first[:-1] < n]] = True
    line = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(line, np.diff(np.r_[line, n]))
    chain = np.flatnonzero(inside % CHAIN == 0)
    return model.posteriors(model.emissions(features(data, starts, ends, model.lexicon), starts), chain, np.diff(np.r_[chain, n])), first


def fit(docs: DataFrame, eligible: Column, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS) -> Model | None:
    """A model of every language of the eligible rows of docs(doc_id, text, lang), from at most ``max_docs`` ids each and ``max_rows`` in all."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(eligible & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    n = known.agg(F.count_distinct("lang")).first()[0]
    if n > max_rows:
        raise ValueError(f"{n} languages, but at most {max_rows} training texts")
    ids = known.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= min(max_docs, max_rows // max(n, 1))).drop("_k")
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("text", "lang", "doc_id")  # at most max_rows ids
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    base.ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part, data, off in base.pieces(batch, "text"):
                lettered = np.asarray(part.column(part.schema.get_field_index("lettered")).to_numpy(zero_copy_only=False), bool)
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                first = np.zeros(part.num_rows + 1, np.int64)
                if model is not None:
                    p, first = label(model, data, off)
                    some = np.flatnonzero(lettered & (np.diff(first) > 0))
                    total = np.r_[np.zeros((1, len(model.langs))), np.cumsum(p, 0, dtype=np.float64)]
                    mean = (total[first[some + 1]] - total[first[some]]) / (first[some + 1] - first[some])[:, None]
                    best = mean.argmax(1)
                    score[some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
                    for i, b in zip(some, best):
                        pred[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(np.diff(first))], names=["doc_id", "lang_pred", "score", "n_words"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select("doc_id", "text", lettered).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs(doc_id, text, lang) that are not held out, then label all: doc_id, held_out, lang_pred, score, n_words."""
    model = fit(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words")
