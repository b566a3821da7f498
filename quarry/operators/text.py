"""Text operators: tokens, counts, vectorisers, readability, sentiment, topics, language model.

Word tokens are maximal runs of letters, marks, digits and underscore, lower-cased by default.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"
SENTENCE = r"[^.!?]+[.!?]"

# The basic sentiment lexicon.
POSITIVE = {
    "good": 1.0, "great": 2.0, "excellent": 3.0, "amazing": 3.0, "wonderful": 2.5, "fantastic": 2.5, "love": 2.0, "like": 1.0, "happy": 2.0, "joy": 2.0,
    "pleased": 1.5, "satisfied": 1.0, "positive": 1.0, "perfect": 3.0, "best": 2.5, "awesome": 2.5, "beautiful": 2.0, "brilliant": 2.5, "superb": 2.5, "nice": 1.0,
}
NEGATIVE = {
    "bad": -1.0, "terrible": -2.5, "awful": -2.5, "horrible": -3.0, "hate": -2.5, "dislike": -1.5, "sad": -2.0, "unhappy": -2.0, "disappointed": -2.0, "negative": -1.0,
    "worst": -3.0, "poor": -1.5, "disgusting": -3.0, "ugly": -2.0, "nasty": -2.5, "stupid": -2.0, "pathetic": -2.5, "failure": -2.0, "fail": -2.0, "sucks": -2.0,
}
# Words that turn the sign, and factors of words that strengthen or weaken what follows.
NEGATORS = ["not", "no", "never", "neither", "nobody", "nothing", "nowhere", "n't", "cannot", "without"]
INTENSIFIERS = {"very": 1.5, "extremely": 2.0, "incredibly": 2.0, "really": 1.3, "so": 1.3, "absolutely": 2.0}
DIMINISHERS = {"somewhat": 0.5, "slightly": 0.5, "barely": 0.3, "hardly": 0.3, "a little": 0.5}


def words(text, lower: bool = True) -> Column:
    """Word tokens; blank text gives an empty array."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(t) if lower else t, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def sentences(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.coalesce(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(tokens: Column, lo: int, hi: int | None = None) -> Column:
    """Runs of lo to hi tokens joined by one space."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(lo, (hi or lo) + 1)))


def char_ngrams(text, n: int) -> Column:
    """Runs of n characters; the text is split once, so long texts cost no more a character than short ones."""
    c = F.split(F.col(text) if isinstance(text, str) else text, "")
    c = F.filter(c, lambda x: x != "")
    shift = lambda k: F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - (n - 1), F.lit(0)))
    out = shift(0)
    for k in range(1, n):
        out = F.zip_with(out, shift(k), lambda a, b: F.concat(a, b))
    return F.when(F.size(c) >= n, out).otherwise(F.array().cast("array<string>"))


def clean(text, stopwords: list[str] | None = None) -> Column:
    """Punctuation dropped, white space collapsed, stop words (case-sensitive) removed."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[^\p{L}\p{M}\p{N}_\s]+", ""), r"\s+", " "))
    return F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(stopwords)), " ") if stopwords else t


def filter_tokens(tokens: Column, min_len: int = 0, max_len: int | None = None, pattern: str | None = None, stopwords: list[str] | None = None, keep_stopwords: bool = False) -> Column:
    """Tokens by inclusive length, regular expression, and (lower-cased) stop words."""

    def ok(t: Column) -> Column:
        c = F.length(t) >= min_len
        if max_len is not None:
            c = c & (F.length(t) <= max_len)
        if pattern:
            c = c & t.rlike(pattern)
        if stopwords:
            inside = F.lower(t).isin(stopwords)
            c = c & (inside if keep_stopwords else ~inside)
        return c

    return F.filter(tokens, ok)


def strip_html(text) -> Column:
    """Scripts, styles, comments and tags become spaces; the basic entities their characters."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mask(text, urls: bool = True, emails: bool = True) -> Column:
    """E-mail addresses and urls become <email> and <url>."""
    t = F.col(text) if isinstance(text, str) else text
    if emails:
        t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.regexp_replace(t, r"https?://[^\s<>\"]+|www\.[^\s<>\"]+", "<url>") if urls else t


def token_counts(df: DataFrame, tokens: Column, by=None) -> DataFrame:
    """(term, n)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    return df.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def collocations(df: DataFrame, tokens: Column, window: int, min_count: int) -> DataFrame:
    """(a, b, n): ordered pairs at most ``window`` - 1 tokens apart, kept from min_count on. No self-join: each token looks ahead."""
    t = df.select(tokens.alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(F.col("t"), i + 2, window - 1), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return t.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def vocabulary(df: DataFrame, id_col: str, tokens: Column, max_size: int | None = None) -> DataFrame:
    """(term, id): ids in order of first appearance (by id_col, then position), from 0.

    Ids come from counts of sorted ranges, not from one unpartitioned window over all terms.
    """
    seen = df.select(F.col(id_col).alias("_d"), F.posexplode(tokens).alias("_p", "term")).groupBy("term").agg(F.min(F.struct("_d", "_p")).alias("_at"))
    from quarry.operators.sampling import global_index

    out = global_index(seen.select("term", "_at._d", "_at._p"), ["_d", "_p"], "id").select("term", F.col("id").cast("long").alias("id"))
    return out.where(F.col("id") < max_size) if max_size is not None else out


def tfidf(df: DataFrame, id_col: str, tokens: Column, smooth: bool = True, l2: bool = True, min_df: int = 1, plus_one: bool = True) -> DataFrame:
    """Long form (id, term, tf, weight). idf = ln((n + 1) / (df + 1)) + 1 smoothed, else ln(n / df) (+ 1)."""
    tf = df.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("_n"))
    dfreq = tf.groupBy("term").agg(F.count("*").alias("_df")).where(F.col("_df") >= min_df)
    idf = F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1 if smooth else F.log(F.col("_n") / F.col("_df")) + (1 if plus_one else 0)
    w = tf.join(dfreq, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.col("tf") * idf)  # n: one row
    if l2:
        norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_z"))
        w = w.join(norm, id_col).withColumn("weight", F.when(F.col("_z") > 0, F.col("weight") / F.col("_z")).otherwise(0.0))
    return w.select(id_col, "term", "tf", "weight")


def hashing_counts(df: DataFrame, id_col: str, tokens: Column, buckets: int) -> DataFrame:
    """(id, bucket, n) by crc32 of the term."""
    return df.select(id_col, F.explode(tokens).alias("t")).groupBy(id_col, (F.crc32(F.col("t").cast("binary")) % buckets).alias("bucket")).agg(F.count("*").alias("n"))


def syllables(word: Column) -> Column:
    """At most 3 bytes: 1; else vowel groups after a final es, ed or e is cut, at least 1."""
    cut = F.regexp_replace(word, r"(es|ed|e)$", "")
    return F.when(F.octet_length(word) <= 3, 1).otherwise(F.greatest(F.size(F.regexp_extract_all(cut, F.lit("[aeiouy]+"), F.lit(0))), F.lit(1)))


def readability(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Counts and the Flesch, Flesch-Kincaid, fog, ARI, Coleman-Liau and type-token scores; null without words."""
    t = F.col(text)
    b = df.select(*keep, words(t).alias("_w"), F.greatest(F.size(sentences(t)), F.lit(1)).alias("n_sentences"), F.length(F.regexp_replace(t, r"\s", "")).alias("n_chars"))
    b = b.withColumn("_s", F.transform("_w", syllables)).withColumn("n_words", F.size("_w"))
    b = b.withColumn("n_syllables", F.aggregate("_s", F.lit(0), lambda a, x: a + x)).withColumn("n_complex", F.size(F.filter("_s", lambda x: x >= 3)))
    w, s = F.col("n_words"), F.col("n_sentences")
    asl, asw = F.try_divide(w, s), F.try_divide("n_syllables", w)
    cpw = F.try_divide("n_chars", w)
    return b.select(
        *keep, "n_words", "n_sentences", "n_syllables", "n_complex",
        F.least(F.greatest(206.835 - 1.015 * asl - 84.6 * asw, F.lit(0.0)), F.lit(100.0)).alias("flesch"),
        F.greatest(0.39 * asl + 11.8 * asw - 15.59, F.lit(0.0)).alias("fk_grade"),
        (0.4 * (asl + 100 * F.try_divide("n_complex", w))).alias("fog"),
        F.greatest(4.71 * cpw + 0.5 * asl - 21.43, F.lit(0.0)).alias("ari"),
        F.greatest(5.88 * cpw - 29.6 * F.try_divide(s, w) - 15.8, F.lit(0.0)).alias("coleman_liau"),
        F.try_divide(F.size(F.array_distinct("_w")), w).alias("ttr"),
    )


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _tally(df: DataFrame, keep: list[str], value) -> DataFrame:
    b = df.withColumn("_v", F.filter(F.transform("_w", value), lambda v: v.isNotNull()))
    return b.select(*keep, F.aggregate("_v", F.lit(0.0), lambda a, x: a + x).alias("score"), F.size("_v").alias("n_sentiment"), F.coalesce(F.try_divide(F.size("_v"), F.size("_w")), F.lit(0.0)).alias("confidence"))


def sentiment(df: DataFrame, text: str, keep: list[str], negation_window: int = 3) -> DataFrame:
    """(score, n_sentiment, confidence): lexicon scores, the sign turned if a negator stands in the words before."""
    lex = _lookup({**POSITIVE, **NEGATIVE})

    def value(w: Column, i: Column) -> Column:
        before = F.slice(F.col("_w"), F.greatest(i + 1 - negation_window, F.lit(1)), F.least(i, F.lit(negation_window)))
        v = F.try_element_at(lex, w)
        return F.when(v.isNull(), F.lit(None)).when(F.exists(before, lambda x: x.isin(NEGATORS)), -v).otherwise(v)

    return _tally(df.select(*keep, words(text).alias("_w")), keep, value)


def rule_sentiment(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(score, n_sentiment, confidence): lexicon scores times the factor of the nearest intensifier or diminisher among the two words before."""
    lex, factor = _lookup({**POSITIVE, **NEGATIVE}), _lookup({**INTENSIFIERS, **DIMINISHERS})

    def value(w: Column, i: Column) -> Column:
        near = (F.try_element_at(factor, F.get(F.col("_w"), i - j)) for j in (1, 2))
        return F.try_element_at(lex, w) * F.coalesce(*near, F.lit(1.0))

    return _tally(df.select(*keep, words(text).alias("_w")), keep, value)


def npmi_coherence(df: DataFrame, id_col: str, tokens: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, npmi) by document co-occurrence; -1 where a count is 0."""
    terms = sorted({t for p in pairs for t in p})
    flags = df.select(*(F.array_contains(tokens, t).cast("long").alias(f"f{i}") for i, t in enumerate(terms)))
    at = {t: f"f{i}" for i, t in enumerate(terms)}
    sums = flags.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in at.values()), *(F.sum(F.col(at[a]) * F.col(at[b])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    rows = []
    for i, (a, b) in enumerate(pairs):
        pa, pb, pab = (F.col(c) / F.col("n") for c in (at[a], at[b], f"p{i}"))
        v = F.when((F.col(f"p{i}") == 0), -1.0).when(F.col(f"p{i}") == F.col("n"), 1.0).otherwise(F.log(pab / (pa * pb)) / -F.log(pab))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("npmi")))
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bigram_model(df: DataFrame, tokens: Column) -> DataFrame:
    """(a, b, n, prob): add-one bigram probabilities over sentences with start and end marks."""
    t = df.select(F.concat(F.array(F.lit("<s>")), tokens, F.array(F.lit("</s>"))).alias("t"))
    big = t.select(F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    ctx = big.groupBy("a").agg(F.sum("n").alias("_c"))
    v = t.select(F.explode("t").alias("w")).agg(F.countDistinct("w").alias("_v"))
    return big.join(ctx, "a").crossJoin(F.broadcast(v)).select("a", "b", "n", ((F.col("n") + 1) / (F.col("_c") + F.col("_v"))).alias("prob"))  # v: one row


def _best_sentences(s: DataFrame, score: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, summary): the k sentences s(id, pos, s) of the greatest score(id, pos, score) in their order (ties: earlier)."""
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "pos")
    top = score.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).join(s, [id_col, "pos"])
    return top.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("summary"))


def _sentences_of(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Sentences (id, pos, s) and their terms (id, pos, t)."""
    s = df.select(id_col, F.posexplode(sentences(text)).alias("pos", "s"))
    return s, s.select(id_col, "pos", F.explode(words("s")).alias("t"))


def lead_summary(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, summary): the k sentences whose words are on average most frequent in the text, in their order (ties: earlier)."""
    s, terms = _sentences_of(df, id_col, text)
    tf = terms.groupBy(id_col, "t").agg(F.count("*").alias("c"))
    score = terms.join(tf, [id_col, "t"]).groupBy(id_col, "pos").agg(F.round(F.avg("c"), 9).alias("score"))
    return _best_sentences(s, score, id_col, k)


def _sentence_vectors(terms: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, t, w): tf-idf of the words of each sentence among the sentences of its text, L2-normalised."""
    tf = terms.groupBy(id_col, "pos", "t").agg(F.count("*").alias("tf"))
    n = tf.groupBy(id_col).agg(F.count_distinct("pos").alias("n"))
    df_ = tf.groupBy(id_col, "t").agg(F.count("*").alias("df"))
    v = tf.join(df_, [id_col, "t"]).join(n, id_col).withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = v.groupBy(id_col, "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, [id_col, "pos"]).select(id_col, "pos", "t", (F.col("w") / F.col("norm")).alias("w"))


def centroid_summary(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, summary): the k sentences closest (cosine of tf-idf) to the mean sentence of their text, in their order (ties: earlier)."""
    s, terms = _sentences_of(df, id_col, text)
    v = _sentence_vectors(terms, id_col)
    centre = v.groupBy(id_col, "t").agg(F.sum("w").alias("c"))
    size = centre.groupBy(id_col).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    score = v.join(centre, [id_col, "t"]).groupBy(id_col, "pos").agg(F.sum(F.col("w") * F.col("c")).alias("d")).join(size, id_col).select(id_col, "pos", F.round(F.col("d") / F.col("norm"), 9).alias("score"))
    return _best_sentences(s, score, id_col, k)


def textrank_summary(df: DataFrame, id_col: str, text: str, k: int, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, summary): the k sentences of the greatest rank in the graph of cosine similarities between a text's sentences.

    Similarities come from shared words (no pair without one), and each text's ranks are iterated inside its row: the
    state is the sentences of one text.
    """
    s, terms = _sentences_of(df, id_col, text)
    v = _sentence_vectors(terms, id_col)
    a, b = (v.select(id_col, "t", F.col("pos").alias(c), F.col("w").alias(f"w{c}")) for c in "ab")
    sim = a.join(b, [id_col, "t"]).where("a <> b").groupBy(id_col, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    out = sim.groupBy(id_col, F.col("a").alias("x")).agg(F.sum("w").alias("total"))
    edges = sim.join(out.withColumnRenamed("x", "a"), [id_col, "a"]).select(id_col, "a", "b", (F.col("w") / F.col("total")).alias("p"))
    into = edges.groupBy(id_col, "b").agg(F.collect_list(F.struct("a", "p")).alias("into"))  # the sentences of one text
    m = s.select(id_col, F.col("pos").alias("b")).join(into, [id_col, "b"], "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("b", "into"))).alias("rows"))
    n = F.size("rows")
    none = F.array().cast("array<struct<a:int,p:double>>")
    step = lambda r: F.transform("rows", lambda x: (F.lit(1 - damping) / n) + damping * F.aggregate(F.coalesce(x["into"], none), F.lit(0.0), lambda t, e: t + e["p"] * F.get(r, e["a"])))
    rank = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("rows", lambda _: F.lit(1.0) / n), lambda r, _: step(r))
    score = m.withColumn("rank", rank).select(id_col, F.posexplode("rank").alias("pos", "score")).withColumn("score", F.round("score", 9))
    return _best_sentences(s, score, id_col, k)


def keywords(df: DataFrame, id_col: str, tokens: Column, k: int) -> DataFrame:
    """(id, rank, term, weight): the k terms of the greatest tf-idf of each text (ties: the smaller term)."""
    tf = df.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    v = tf.join(df_, "term").crossJoin(F.broadcast(n)).select(id_col, "term", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 8).alias("weight"))  # n: one row
    w = Window.partitionBy(id_col).orderBy(F.desc("weight"), "term")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(id_col, "rank", "term", "weight")


def most_frequent_terms(df: DataFrame, id_col: str, tokens: Column, k: int) -> DataFrame:
    """(term, df): the k terms that the most texts hold (ties: the smaller term): a vocabulary of bounded size."""
    return df.select(id_col, F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(k)


def language_profiles(df: DataFrame, lang: str, text: str, k: int = 300) -> DataFrame:
    """(lang, gram, rank): the k most frequent character trigrams of each language's texts (ties: the smaller gram), rank from 0."""
    g = df.select(F.col(lang).alias("lang"), F.explode(char_ngrams(F.lower(F.col(text)), 3)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return g.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("lang", "gram", "rank")


def detect_language(df: DataFrame, id_col: str, text: str, profiles: DataFrame, k: int = 300) -> DataFrame:
    """(id, lang, distance): the profile of the least out-of-place distance to the text's own ranking of trigrams (ties: the smaller name).

    A trigram that a profile lacks counts k. ``profiles`` has k rows a language, a bounded size.
    """
    own = df.select(id_col, F.explode(char_ngrams(F.lower(F.col(text)), 3)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("n"))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "gram")
    own = own.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k)
    size = own.groupBy(id_col).agg(F.count("*").alias("m"))
    met = own.join(F.broadcast(profiles), "gram").groupBy(id_col, "lang").agg(F.sum(F.abs(F.col("r") - F.col("rank")) - k).alias("less"))
    langs = profiles.select("lang").distinct()
    every = size.join(F.broadcast(langs), F.lit(True)).join(met, [id_col, "lang"], "left")  # langs: a row a language
    d = every.select(id_col, "lang", (F.col("m") * k + F.coalesce("less", F.lit(0))).alias("distance"))
    return d.groupBy(id_col).agg(F.min(F.struct("distance", "lang")).alias("x")).select(id_col, "x.lang", "x.distance")


def jaro(a, b) -> Column:
    """Jaro similarity by array expressions: each character of a takes the first free equal one of b within reach."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    taken = F.lit("\x00")  # no text holds it

    def take(s: Column, i: Column) -> Column:
        lo = F.greatest(i - reach, F.lit(1))
        c = F.substr(a, i, F.lit(1))
        p = F.position(c, F.substr(s["rest"], lo, F.least(m, i + reach) - lo + 1))
        hit = (p > 0) & (lo <= m)
        return F.struct(F.when(hit, F.overlay(s["rest"], taken, (lo + p - 1), F.lit(1))).otherwise(s["rest"]).alias("rest"), F.when(hit, F.concat(s["hits"], c)).otherwise(s["hits"]).alias("hits"))

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(steps, F.struct(b.alias("rest"), F.lit("").alias("hits")), take)
    spots = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    met = F.filter(spots, lambda j: F.substr(done["rest"], j, F.lit(1)) == taken)
    k = F.length(done["hits"])
    swaps = F.size(F.filter(F.transform(met, lambda j, i: F.substr(b, j, F.lit(1)) != F.substr(done["hits"], i + 1, F.lit(1))), lambda x: x)) / 2
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, 1.0).when((n == 0) | (m == 0) | (k == 0), 0.0).otherwise((k / n + k / m + (k - swaps) / k) / 3)


def jaro_winkler(a, b, prefix_weight: float = 0.1) -> Column:
    """Jaro similarity raised by up to four equal first characters; null if a side is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    j = jaro(a, b)
    same = F.lit(0)
    for i in range(4, 0, -1):
        both = (F.length(a) >= i) & (F.length(b) >= i)
        same = F.when(both & (F.substr(a, F.lit(1), F.lit(i)) == F.substr(b, F.lit(1), F.lit(i))), F.greatest(same, F.lit(i))).otherwise(same)
    return j + prefix_weight * same * (1 - j)


def _edit_table(costs: tuple[float, float, float, float], transpose: bool):
    insert, delete, substitute, swap = costs

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        """All pairs of a batch at once: one cell of the table is one numpy operation over the pairs."""
        out = np.full(len(x), np.nan)
        some = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        order = sorted(some, key=lambda i: (len(x.iat[i]), len(y.iat[i])))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            a, b = ([np.array([ord(c) for c in s.iat[i]], np.int64) for i in part] for s in (x, y))
            n, m = np.array([len(v) for v in a]), np.array([len(v) for v in b])
            pad = lambda vs, fill: np.stack([np.r_[v, np.full(max(map(len, vs)) - len(v), fill)] for v in vs])
            p, q = pad(a, -1), pad(b, -2)
            rows = [np.tile(np.arange(q.shape[1] + 1) * insert, (len(part), 1)).astype(float)]
            last = rows[0][np.arange(len(part)), m].copy()
            for i in range(1, p.shape[1] + 1):
                row = np.empty_like(rows[0])
                row[:, 0] = i * delete
                for j in range(1, q.shape[1] + 1):
                    same = p[:, i - 1] == q[:, j - 1]
                    v = np.minimum(np.minimum(rows[-1][:, j] + delete, row[:, j - 1] + insert), rows[-1][:, j - 1] + np.where(same, 0.0, substitute))
                    if transpose and i > 1 and j > 1:
                        cross = (p[:, i - 1] == q[:, j - 2]) & (p[:, i - 2] == q[:, j - 1])
                        v = np.where(cross, np.minimum(v, rows[-2][:, j - 2] + swap), v)
                    row[:, j] = v
                rows = [rows[-1], row]
                last = np.where(n == i, row[np.arange(len(part)), m], last)
            out[part] = last
        return pd.Series(out).where(pd.Series(out).notna(), None).astype("float64")

    return run


def weighted_levenshtein(a, b, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> Column:
    """Edit distance with costs of operations (an Arrow-batched function: no built-in one has costs); null if a side is null."""
    return F.pandas_udf(_edit_table((insert, delete, substitute, 0.0), False), "double")(a, b)


def weighted_damerau(a, b, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, transpose: float = 1.0) -> Column:
    """Edit distance with costs, where neighbours may change places (no text between them edited twice)."""
    return F.pandas_udf(_edit_table((insert, delete, substitute, transpose), True), "double")(a, b)


def topic_diversity(topics: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """(diversity): share of distinct words among all words of the topics."""
    t = topics.select(F.explode(words_col).alias("w"))
    return t.agg(F.try_divide(F.count_distinct("w"), F.count("*")).alias("diversity"))


def topic_distances(topics: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """(a, b, distance): Jaccard distance of the words of two topics (a < b); topics are few by nature and meet by shared words."""
    sets = topics.select(F.col(id_col).alias("id"), F.array_distinct(words_col).alias("w"))
    e = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("w"))
    x, y = (e.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), "w") for c in "ab")
    met = x.join(y, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return met.select("a", "b", (1 - F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("distance"))
