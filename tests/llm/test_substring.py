import hashlib
import random

from pyspark.sql import functions as F

from quarry.llm import substring


def brute(rows, window):
    """doc_id -> (n_words, n_removed, sha) by a dictionary of windows."""
    words = {d: ([] if t is None else t.encode().split()) for d, t in rows}
    first = {}
    for d in sorted(words):
        for p in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][p : p + window]), (d, p))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (d, p):
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice("ab") * r.randint(1, 3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(60):
        t = " ".join(f"w{r.randint(0, 5000)}" for _ in range(r.randint(0, 120)))
        k = r.randint(0, 5)
        if k == 0:
            t = t + "\n" + passage + " " + t
        if k == 1:
            t = " ".join(word() for _ in range(80))
        if k == 2:
            t = " x" + t + "\x1c y\x0bz"
        rows.append((i * 7, t))
    rows += [(1, rows[3][1]), (2, rows[4][1]), (1000, None), (1001, ""), (1002, passage), (1003, passage + " x"), (1004, "x " * 400)]
    return rows


def test_matches_brute_force(spark):
    for window, packet in ((20, 64), (20, 1 << 20), (7, 100), (4, 1 << 20)):
        rows = texts(window)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        old, substring.PACKET_WORDS = substring.PACKET_WORDS, packet
        try:
            got = {r[0]: tuple(r[1:]) for r in substring.digests(docs, window).collect()}
        finally:
            substring.PACKET_WORDS = old
        assert got == brute(rows, window)


def test_nulls_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(None, "a " * 50, 1, [1]), (5, "a " * 50, 2, None), (6, "q", 3, [2])], "doc_id long, text string, n int, spans array<int>")
    got = {r.doc_id: r for r in substring.digests(docs).collect()}
    assert got[None].n_removed == 0 and got[5].n_removed == 49 and got[6].n_words == 1
    assert substring.digests(docs.where("false")).count() == 0


def test_remove_keeps_untouched_text(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", "x"), (2, "k " * 30, "y")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert got[1].text == "a  b\nc" and got[1].source == "x"
    assert got[2]._n_removed == 29 and got[2].text == "k"
