import math
import random

from quarry.llm import topk


def brute(rows, queries, k, scale=1024):
    def q(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * x) if math.isfinite(scale * x) else (1 << 64) * (1 if x > 0 else -1))) for x in v]

    rows = [(i, q(v)) for i, v in rows if i is not None and q(v) is not None]
    out = {}
    for qi in {i for i, _ in rows} & set(queries):
        own = min(v for i, v in rows if i == qi)
        best = {}
        for i, v in rows:
            if i != qi and len(v) == len(own):
                s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, v))))
                best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[(qi, r)] = (i, s)
    return out


def test_matches_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(20)]) for i in range(400)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(80)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (None, hot), (2004, []), (2005, [1e300] + [0.0] * 19), (3, rows[5][1]), (2006, [2.0, 1.0]), (2007, [1.0, 1.0]), (2008, [-1e300] + [3.0] * 19), (2009, [2e9] * 10 + [-2e9] * 10), (2010, [2e9] * 10 + [-1.9e9] * 10)]
    queries = {0, 3, 50, 100, 1003, 2001, 2004, 2006, 2005, 2009}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score").repartition(3)
    monkeypatch.setattr(topk, "ROWS", 64)
    for block in (4096, 3):
        got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, df.where(df.vec_id.isin(list(queries))), 10, block=block).collect()}
        assert got == brute(rows, queries, 10)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0
