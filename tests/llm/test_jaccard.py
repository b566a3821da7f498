import random

from quarry.llm import jaccard
from quarry.llm.components import connected_components


def shingles(t, k):
    w = [] if t is None else bytes(t.encode()).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    s = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(s):
        for e, b in s[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return {d: (len(a), root(d)) for d, a in s}


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        w = [f"w{r.randint(0, 900)}" for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 25)):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = f"x{r.randint(0, 40)}"
            t = r.choice([" ", "\n"]).join(v)
            rows.append(t.upper() if r.random() < 0.2 else t)
    rows += [None, "", " \t", "one", "ONE", "one two", "é é", "É É", "a b c d e", "a  b c d\x0be"]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows))


def test_matches_brute_force(spark):
    for k, percent in ((5, 80), (2, 60)):
        rows = corpus(percent)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_chains_of_shortened_copies(spark):
    rows = []
    for seed in range(80):
        r = random.Random(seed)
        w = [f"s{seed}w{i}" for i in range(r.randint(60, 140))]
        cuts = [(0, len(w)), (0, len(w) - r.randint(3, 9)), (r.randint(8, 20), len(w) - r.randint(3, 9))]
        cuts += [(r.randint(0, 24), len(w) - r.randint(0, 24)) for _ in range(r.randint(0, 4))]
        rows += [" ".join(w[a:b]) for a, b in cuts]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    want = brute(rows, 5, 80)
    assert {d for d in want if got[d] != want[d]} == set()


def test_crowded_lists_by_difference(spark, monkeypatch):
    """A family of copies around the threshold: nodes outside the largest component meet by their differences from its hub."""
    monkeypatch.setattr(jaccard, "CROWD", 3)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 20)
    monkeypatch.setattr(jaccard, "HOT", 0)
    rows = []
    for seed, size in ((1, 110), (2, 70), (3, 40)):
        r = random.Random(seed)
        w = [f"s{seed}w{i}" for i in range(size)]
        for i in range(90):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 2, 3, 3, 4])):
                k = r.randrange(len(v))
                v[k : k + r.randint(0, 2)] = [r.choice([f"x{seed}-{r.randint(0, 3)}", f"y{seed}-{i}"])] * r.randint(0, 2)
            rows.append(" ".join(v[r.choice([0, 0, 0, 3]) : len(v) - r.choice([0, 0, 4])]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    called, plain = [], jaccard.JaccardJoin._by_difference
    monkeypatch.setattr(jaccard.JaccardJoin, "_by_difference", lambda *a: called.append(1) or plain(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    want = brute(rows, 5, 80)
    assert called and {d for d in want if got[d] != want[d]} == set()
    assert len({c for _, c in want.values()}) > 10


def test_long_texts_and_repeated_rows(spark):
    r = random.Random(9)
    long = [f"w{r.randint(0, 30000)}" for _ in range(60000)]
    rows = [(5, " ".join(long)), (6, " ".join(long[:59000])), (7, " ".join(long[30000:])), (7, " ".join(long[30000:])), (7, "other text of this id"), (8, "other text of this id")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = [len(shingles(t, 5)) for _, t in rows]
    assert got == sorted([(5, n[0], 5), (6, n[1], 5), (7, n[2], 7), (7, n[3], 7), (7, 1, 7), (8, 1, 7)])


def test_empty_null_ids_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (4, "a b c", 2), (9, "A b c", 3), (9, "q", 3)], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert got == [(4, 4), (9, 4), (9, 9), (None, None)]
    assert jaccard.components(docs.where("false")).count() == 0
    assert jaccard.components(docs.limit(1)).count() == 1


def test_sets_of_null_ids_link_documents(spark):
    w = [f"w{i}" for i in range(104)]
    copies = [(i, " ".join(w + [f"x{i}a", f"x{i}b"])) for i in range(20)]  # 100 n-grams and two of their own
    v = [f"v{i}" for i in range(104)]
    bridge = [(100, " ".join(v[:92])), (None, " ".join(v)), (101, " ".join(v[14:]))]
    rows = [*copies, (None, " ".join(w)), (None, " ".join(w)), *bridge]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert got == sorted([(i, 0) for i in range(20)] + [(None, None)] * 3 + [(100, 100), (101, 100)], key=str)


def test_components_of_chains_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 600)] + [(None, 3), (8, 8)]
    r.shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(500, 600)}}
