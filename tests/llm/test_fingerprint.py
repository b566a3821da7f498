import hashlib
import random

import numpy as np

from quarry.llm import fingerprint as fp


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = fp.prints([t, e, nxt])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.text_of(a), fp.text_of(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_edited_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 500), "".join(r.choice("ab é😀\n") for _ in range(r.randint(0, 300)))) for _ in range(150)]
    rows += [(9000, None), (9001, ""), (None, "null id"), (9002, "x" * 5000), (9003, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("*", "1 AS part", "true AS guest", "2 AS key").repartition(7)
    got = sorted(map(tuple, fp.edited(docs).collect()), key=str)
    assert got == brute(rows)
    assert fp.edited(docs.where("false")).count() == 0
    one = fp.edited(docs.where("doc_id = 9002")).first()
    assert one.near_next == 1.0


M = (1 << 64) - 1


def slow_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def slow_name(xs):
    """Hash of a phrase, from its definition."""
    b = 0x9E3779B97F4A7C15 | 3
    return slow_mix((sum(x * pow(b, i, 1 << 64) for i, x in enumerate(xs)) + len(xs) * 0xD6E8FEB86659FD93) & M)


def slow_parse(x):
    """One level, symbol by symbol: runs, four tosses, local maxima."""
    runs = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    x = [v if k == 1 else slow_mix((v ^ (k * 0xA0761D6478BD642F)) & M) for v, k in runs]
    lab = [v & 0xFFFFFFFF for v in x]
    for bits in (32, 8, 8, 8):
        out = []
        for i, v in enumerate(lab):
            d = v ^ lab[i - 1] if i else v
            at = min((d & -d).bit_length() - 1 if d else bits, bits - 1)
            out.append((2 * at + (v >> at & 1)) & 0xFF)
        lab = out
    cuts = [i for i in range(len(x)) if i == 0 or (lab[i] >= lab[i - 1] and i + 1 < len(x) and lab[i] > lab[i + 1])]
    return [slow_name(x[a:b]) for a, b in zip(cuts, cuts[1:] + [len(x)])]


def test_parsing_matches_a_slow_parser():
    r = random.Random(11)
    texts = ["", "x", "xx", "xyx", "aaaa bbbb", "é😀é😀"] + ["".join(r.choice("etaoin shr\né") for _ in range(r.randint(1, 260))) for _ in range(60)]
    for t, got in zip(texts, fp.prints(texts)):
        x, names = [ord(c) for c in t], set()
        for level in range(3):
            x = slow_parse(x)
            if level:
                names |= {slow_mix(v ^ level) >> 32 for v in x}
        assert got.tolist() == sorted(names)[: fp.K]


def test_equal_substrings_share_phrases_at_any_offset():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    body = " ".join(word() for _ in range(400))
    for shift in ("", "x", "some other start of the text ", "é" * 37):
        a, b = fp.prints([body, shift + body])
        assert fp.likeness(a, b) > 0.85
    other = " ".join(word() for _ in range(400))
    assert fp.likeness(*fp.prints([body, other])) < 0.2


def test_phrases_are_short_and_cover_the_text():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 40, 20000).astype(np.uint64)
    names, off = fp.parse(x, np.array([0, 5000, 5000, 20000]))
    assert off[0] == 0 and off[1] == off[2] and off[-1] == len(names)
    assert 20000 / 6 < len(names) < 20000 / 2


def test_fingerprints_of_equal_texts(spark):
    docs = spark.createDataFrame([(1, "abc " * 9), (2, "abc " * 9), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert got[1] == got[2] != "" and got[3] == got[4] == ""
    assert fp.likeness(fp.sketch_of(got[1]), fp.sketch_of(got[2])) == 1.0


def test_a_text_knows_nothing_of_its_neighbours():
    r = random.Random(3)
    texts = ["".join(r.choice("abcd  \né") for _ in range(r.randint(0, 200))) for _ in range(60)] + ["", "x", "xx", "xy"]
    together = fp.prints(texts)
    assert all(np.array_equal(a, fp.prints([t])[0]) for a, t in zip(together, texts))
    assert all(np.array_equal(a, b) for a, b in zip(together, fp.prints(texts[::-1])[::-1]))


def test_near_copies_are_alike_at_every_length():
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    mean = {}
    for n, m in ((94, 88), (100, 94), (112, 106), (100, 67)):
        pairs = [(t, t[:m]) for t in (" ".join(word() for _ in range(n))[:n] for _ in range(100))]
        mean[n, m] = np.mean([fp.likeness(*fp.prints([a, b])) for a, b in pairs])
    assert min(mean[94, 88], mean[100, 94], mean[112, 106]) > 0.7 and mean[100, 67] > 0.45
