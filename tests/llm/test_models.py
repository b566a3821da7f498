"""Language, toxicity, mixing and SentencePiece: held-out accuracy, brute force and round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import crf, mixing, piecefst, toxicity

SYL = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ein", "lich", "ö"], "fr": ["eau", "que", "ment", "é", "les"]}


def words(r, lang, n):
    return [("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3)))) for _ in range(n)]


def lang_rows(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(words(r, lang, r.randint(5, 60))) + r.choice(["", "\nOk."]), lang) for i in range(n) for lang in [r.choice(list(SYL))]]


def test_languages(spark):
    rows = lang_rows(240, 1) + [(1000, None, "en"), (1001, "", "de"), (1002, " 12 ...", None), (1003, "éa", None), (None, "the and the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score").repartition(3)
    got = {r.doc_id: r for r in crf.identify(df).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001].score == 0 and got[None].lang_pred == "en"
    held = [d for d, _, _ in rows[:240] if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and all(got[d].held_out == (d in set(held)) for d in range(240))
    truth = {d: x for d, _, x in rows}
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.95
    assert crf.identify(df.where("doc_id > 2000")).count() == 0
    assert crf.fit(df, F.lit(True), max_rows=3).langs == ["de", "en", "fr"]  # every language, whatever the bound
    with pytest.raises(ValueError):
        crf.fit(df, F.lit(True), max_rows=2)
    long = df.where("doc_id = 3").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 3000))
    assert {x.lang_pred for x in crf.predict(long.unionAll(long), crf.fit(df, F.lit(True))).collect()} == {rows[3][2]}
    none = df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in crf.identify(none).collect()} == {"und"}


def test_code_switch_and_posteriors():
    r = random.Random(2)
    rows = lang_rows(200, 3)
    m = crf.train([t for _, t, _ in rows], [x for _, _, x in rows])
    text = words(r, "en", 30) + words(r, "de", 30) + words(r, "fr", 30)
    data = " ".join(text).encode()
    p, first = crf.label(m, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert np.allclose(p.sum(1), 1, atol=1e-4) and first.tolist() == [0, 90]
    said = [m.langs[i] for i in p.argmax(1)]
    assert np.mean([a == b for a, b in zip(said, ["en"] * 30 + ["de"] * 30 + ["fr"] * 30)]) > 0.9


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    m = crf.Model(["a", "b", "c"], np.zeros(1 << 16, np.uint64))
    m.move, m.first = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    e = rng.normal(size=(7, 3)).astype(np.float32)
    got, moves, heads = m.posteriors(e, np.array([0, 4]), np.array([4, 3]), True)
    for at, n in ((0, 4), (4, 3)):
        want, total = np.zeros((n, 3)), 0.0
        for y in product(range(3), repeat=n):
            w = np.exp(m.first[y[0]] + sum(e[at + t, y[t]] for t in range(n)) + sum(m.move[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            for t in range(n):
                want[t, y[t]] += w
        assert np.allclose(got[at : at + n], want / total, atol=1e-5)
    assert moves.sum() == pytest.approx(5) and heads.sum() == pytest.approx(2)


def test_toxicity(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        w = words(r, r.choice(list(SYL)), r.randint(3, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randint(0, len(w)), r.choice(["vilex", "grumph"]) + r.choice(["", "!", "ing"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "vilex grumph vilex")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.judge(docs, lab).collect()}
    assert (got[900].score, got[901].score, got[901].predicted) == (0, 0, 0)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in labels if i in set(held)]) > 0.9
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.score for x in toxicity.judge(docs, lab.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.judge(docs.where("false"), lab).count() == 0
    twice = toxicity.score(docs.unionAll(docs).withColumn("_toxicity", F.lit("x")), None)
    assert twice.count() == 2 * len(rows) and twice.columns.count("_toxicity") == 1


def test_toxicity_of_short_wordless_and_long_texts():
    r = random.Random(6)
    clean = [" ".join(words(r, "en", r.choice([3, 40]))) for _ in range(60)]
    toxic = [" ".join(words(r, "en", 3) + ["vilex"] + words(r, "en", 2)) for _ in range(60)]  # all shorter than a window
    net = toxicity.train(clean + toxic, [0] * 60 + [1] * 60)
    texts = [" ".join(words(r, "en", 4) + ["vilex"]), " ".join(words(r, "en", 5)), " ".join(words(r, "en", 70000) + ["vilex"]), "", "?!"]
    raw = [t.encode() for t in texts]
    p = toxicity.score_texts(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert p[0] > 0.7 > p[1] and p[2] > 0.7 and p[3] == p[4] == 0
    assert toxicity.train(["?", "", "!"], [0, 1, 1]) is None and toxicity.train(["word", "!!"], [0, 1]) is None


def brute_score(net, text):
    """A text's score word by word, in plain loops."""
    w = [x for x in "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()]
    data, best = text.encode(), 0.0
    word, gram, starts, first = toxicity.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    vec = net.inputs(net.rows(word), gram, starts)
    assert len(w) == len(vec)
    sig = lambda x: 1 / (1 + np.exp(-x))
    h_ = toxicity.HIDDEN

    def run(xs, k):
        h, out = np.zeros(h_), []
        for x in xs:
            g, u = x @ net.w["w" + k] + net.w["b" + k], h @ net.w["u" + k]
            z, q = sig(g[:h_] + u[:h_]), sig(g[h_ : 2 * h_] + u[h_ : 2 * h_])
            c = np.tanh(g[2 * h_ :] + q * u[2 * h_ :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    last = max(len(vec) - toxicity.WINDOW, 0)
    for at in sorted({*range(0, last, toxicity.STRIDE), last}) if len(vec) else []:
        xs = vec[at : at + toxicity.WINDOW]
        s = [np.concatenate(p) for p in zip(run(xs, "f"), run(xs[::-1], "b")[::-1])]
        e = np.exp([v @ net.w["att"] for v in s])
        best = max(best, float(sig((e / e.sum()) @ np.array(s) @ net.w["out"] + net.w["bias"])[0]))
    return best


def test_toxicity_scores_match_plain_loops():
    r = random.Random(7)
    net = toxicity.Network(np.sort(np.random.default_rng(3).integers(1, 1 << 62, 40).astype(np.uint64)))
    texts = ["", "One", " ".join(words(r, "de", 31)), " ".join(words(r, "fr", 75)), "a-b, c!" * 9]
    raw = [t.encode() for t in texts]
    got = toxicity.score_texts(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got == pytest.approx([brute_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_gradients_and_windows():
    rng = np.random.default_rng(1)
    net = toxicity.Network(np.array([1 << 50, 2 << 50], np.uint64))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rows, gram, starts = np.array([1, 0, 2, 1, 0, 2]), rng.integers(1, 50, 12), np.arange(0, 12, 2)
    idx, y = np.arange(6).reshape(2, 3).T, np.array([1.0, 0.0])
    loss = lambda: float(-np.mean(y * np.log(p := net.pool(np.concatenate([net.scan(net.inputs(rows, gram, starts) @ net.w["wf"] + net.w["bf"], "f", idx), net.scan(net.inputs(rows, gram, starts) @ net.w["wb"] + net.w["bb"], "b", idx[::-1])[::-1]], 2))[0]) + (1 - y) * np.log(1 - p)))
    g = net.gradients(rows, gram, starts, idx, y)
    for k in ("word", "wf", "ub", "att", "out", "bias"):
        flat, at = net.w[k].reshape(-1), int(np.abs(g[k]).reshape(-1).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert g[k].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-5)
    text, at, size = toxicity.windows(np.array([0, 0, 5, 5 + 100]))
    assert text.tolist() == [1] + [2] * 6 and at[-1] + size[-1] == 105 and size[0] == 5
    assert set(np.concatenate([np.arange(a, a + n) for a, n in zip(at, size)])) == set(range(105))


def brute_rates(groups, target, most):
    p, t = np.array([g[0] for g in groups]), np.array([g[1] for g in groups], float)
    x = np.ones(len(t))
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p / t.sum()).max()
    for _ in range(20000):
        miss = ((x * t) @ p - target) / t.sum()
        x = np.clip(x - step * p @ miss, 0, most if most is not None else np.inf)
    return x


def test_rates_match_brute_force(spark):
    groups = [([0.0, 1.0], 700), ([0.25, 0.75], 100), ([0.75, 0.25], 50), ([1.0, 0.0], 150)]
    df = spark.createDataFrame(groups, "_p array<double>, _tokens long")
    for target, most in (([100.0, 900.0], None), ([50.0, 780.0], 1.0), ([20.0, 980.0], 1.0)):  # the last is out of reach
        got = {tuple(r._p): r.rate for r in mixing.fit_rates(df, target, most).collect()}
        want = brute_rates(groups, np.array(target), most)
        assert np.allclose([got[tuple(p)] for p, _ in groups], want, atol=0.02)
    assert mixing.fit_rates(df.where("false"), [1.0, 1.0]).count() == 0


def test_mixing_reaches_the_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(words(r, "en", 40)) if i % 5 else " ".join(["spam!!!"] * 40)) for i in range(200)] + [(500, None), (501, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS rate", "1 AS _k")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    m = mixing.mix(docs, labels, "quality", {1: 0.9, 0: 0.1}).collect()
    n = sum(x._tokens for x in m)
    assert len(m) == 203 and all(x._rate >= 0 and abs(sum(x._p) - 1) < 1e-9 for x in m)
    for k, share in ((0, 0.1), (1, 0.9)):
        assert sum(x._rate * x._tokens * x._p[k] for x in m) / n == pytest.approx(share, abs=0.002)
    capped = mixing.mix(docs.withColumn("_rate", F.lit(5)).withColumn("_p", F.lit("x")), labels, "quality", {1: 0.9, 0: 0.1}, most=1.0).collect()
    got = [sum(x._rate * x._tokens * x._p[k] for x in capped) for k in (0, 1)]
    assert got[1] / sum(got) == pytest.approx(0.9, abs=0.01) and max(x._rate for x in capped) <= 1 and got[1] > 0.97 * sum(x._tokens * x._p[1] for x in capped)
    few = mixing.mix(docs, labels, "quality", {1: 0.6, 0: 0.4}, most=1.0).collect()  # the second domain gives what it has
    assert min(x._rate for x in few if x._tokens) > 0.97
    assert mixing.mix(docs.where("false"), labels, "quality", {1: 1.0}).count() == 0
    assert {x._rate for x in mixing.mix(docs, labels.where("quality = 1"), "quality", {1: 1.0}).collect()} == {1.0}


TEXTS = ["", " ", "Hello  world", "a\n\n\tb ", "naïve ﬁ ½ 中文 😀", "x" * 300, "    " * 30 + "deep", "https://e.org/a?b=c&d", "Привет 안녕 \x00\x01", "word," * 50]


def test_pieces_match_the_library():
    spm = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    fst = piecefst.compiled(open(piecefst.default_model(), "rb").read())
    sp = spm.SentencePieceProcessor(model_file=piecefst.default_model())
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abcdetn ,.é\n▁ß-()12") for _ in range(r.randint(0, 80))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(fst.encode(t), np.int32).tolist()
        assert ids == sp.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")


def test_pieces_round_trip(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string").selectExpr("*", "1 AS ids")
    enc = piecefst.encode(docs)
    back = {r.doc_id: r.text for r in piecefst.decode(enc).collect()}
    assert back == {**dict(enumerate(TEXTS)), 99: None}
    assert piecefst.encode(docs.where("false")).count() == 0 and piecefst.encode(docs.unionAll(docs)).count() == 2 * docs.count()
    d = {r.doc_id: r for r in piecefst.digests(docs).collect()}
    assert d[99].n_tokens == 0 and d[99].round_trip is None and all(d[i].round_trip for i in range(len(TEXTS)))


def field(number: int, value: bytes) -> bytes:
    """A field of a protocol buffer message; a message that follows another one is merged with it."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | 2) + varint(len(value)) + value


def check_model(model: bytes, texts: list[str]) -> None:
    import sentencepiece as spm

    fst, sp = piecefst.Transducer(model), spm.SentencePieceProcessor(model_proto=model)
    for t in texts:
        assert np.frombuffer(fst.encode(t), np.int32).tolist() == sp.encode(t), repr(t)


def test_models_with_normaliser_user_pieces_and_unigrams():
    spm = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    model = open(piecefst.default_model(), "rb").read()
    r = random.Random(13)
    texts = [t for t in TEXTS if "\x00" not in t] + ["ﬁne  ａｂｃ　１２３ ½ Å e\u0301 가", " \t x \n", "①②  ㎏ ½"] + ["".join(r.choice("abcdetn ,.éﬁａ½\u0301\u3000ß-()12") for _ in range(r.randint(0, 60))) for _ in range(200)]
    map_ = dict(piecefst._fields(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    rules = model + field(3, map_ + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1]))  # dummy prefix, squeezed and escaped white space
    check_model(rules, texts)
    user = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5, 0, 0, 0, 0, 3 << 3, 4])) for p in ("<sep>", "qxz", "<sepx>"))
    mixed = [t[: len(t) // 2] + r.choice(["<sep>", "qxz", "<sepx>", "<se"]) + t[len(t) // 2 :] for t in texts]
    check_model(model + user, mixed)
    check_model(rules + user, mixed)
    unigram = model + field(2, bytes([3 << 3, 1]))
    check_model(unigram, texts)
    check_model(unigram + user, mixed)


def test_bpe_path_is_the_merges():
    pytest.importorskip("public_tokenizers")
    fst = piecefst.compiled(open(piecefst.default_model(), "rb").read())
    r = random.Random(14)
    for _ in range(300):
        s = "".join(r.choice("aeinrst▁") for _ in range(r.randint(1, 14)))
        assert [fst.pieces[k] for k in fst.by_levels(s)] == fst.merged(s)


def test_unigram_path_is_the_best():
    fst = piecefst.Transducer.__new__(piecefst.Transducer)
    fst.model_type, fst.fallback = piecefst.UNIGRAM, False
    fst.pieces, fst.scores = ["<unk>", "a", "b", "ab", "ba", "aba"], [0.0, -1.0, -1.2, -1.9, -2.5, -2.8]
    fst.unknown, fst.low = 0, -20.0
    fst.trie = {}
    for i, p in enumerate(fst.pieces[1:], 1):
        node = fst.trie
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i

    def best(s):
        if not s:
            return 0.0
        return max(fst.scores[i] + best(s[len(p) :]) for i, p in enumerate(fst.pieces) if i and s.startswith(p))

    for s in ("ab", "aba", "abab", "bbaab", "ababab"):
        assert sum(fst.scores[i] for i in fst.by_positions(s)) == pytest.approx(best(s))
