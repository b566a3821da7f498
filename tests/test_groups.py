"""Operators on tables with many rows of one place, vertex or label: they may not make all pairs of a group on the way."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, flow, geometry, graph, relational


def _places(seed, n):
    r = random.Random(seed)
    return [(i, float(r.randint(0, 6)) / 2, float(r.randint(0, 6)) / 2) for i in range(n)] + [(n, None, 1.0)]


def test_near_pairs_of_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(relational, "HEAP", 4)
    pts = _places(1, 120)
    p = spark.createDataFrame(pts, "id long, x double, y double")
    got = sorted((r.a, r.b, round(r.dist, 9)) for r in relational.near_pairs(p, "x", "y", 0.75).collect())
    assert got == sorted((a[0], b[0], round(d, 9)) for a, b in combinations(pts[:-1], 2) if (d := math.dist(a[1:], b[1:])) <= 0.75)
    # nine rows a point: the driver must not get them
    assert "Broadcast" not in relational.grid_join(p, p, "x", "y", 0.75)._jdf.queryExecution().executedPlan().toString()


def test_line_degrees_of_a_star(spark):
    r = random.Random(3)
    es = [(i, r.randint(0, 9), r.randint(0, 9)) for i in range(60)] + [(60, None, 3)]
    e = spark.createDataFrame(es, "id long, src long, dst long")
    want = {i: sum(1 for j, c, d in es if j > i and {a, b} & {c, d} - {None}) for i, a, b in es}
    assert {x.id: x.later for x in graph.line_degrees(e).collect()} == want
    n = 200_000  # 2 x 10^10 pairs
    star = spark.range(n).select("id", F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.line_degrees(star).agg(F.sum("later")).first()[0] == n * (n - 1) // 2


def test_boxes_of_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(relational, "HEAP", 4)
    r = random.Random(5)
    boxes = [(i, x := r.randint(0, 5) / 2, y := r.randint(0, 5) / 2, x + r.choice([0.25, 1.0]), y + 0.5) for i in range(80)] + [(80, None, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, relational.box_join(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.75).collect()))
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    assert got == sorted((p[0], q[0]) for p in boxes[:-1:2] for q in boxes[1::2] if meet(p, q))


def test_contains_many_sides(spark):
    n = 40_000  # a comb: all its sides cross all heights, 1.6 x 10^9 pairs of a point and a side
    v = spark.range(n).select(F.lit("c").alias("b"), "id", F.col("id").cast("double").alias("x"), (F.col("id") % 2 * 10).cast("double").alias("y"))
    p = spark.range(n).select("id", F.lit("c").alias("b"), (F.col("id") + 0.25).alias("x"), (F.col("id") % 9 + 0.5).alias("y"))
    p = p.unionByName(spark.createDataFrame([(-1, "c", None, 1.0), (-2, "c", 1.0, None), (-3, "d", 1.0, 1.0)], "id long, b string, x double, y double"))
    got = {r.id: r.inside for r in geometry.contains(p, geometry.edges(v, "b", "id", "x", "y"), "b", 5.0).collect()}
    assert len(got) == n + 3 and not any(got[i] for i in (-1, -2, -3))
    for i in range(0, n - 2, 97):
        y = i % 9 + 0.5
        cut = i + (y / 10 if i % 2 == 0 else 1 - y / 10)  # side i crosses the height here; later ones to the right; the last side closes from x = n - 1, y = 10
        k = (cut > i + 0.25) + (n - 2 - i) + ((0 - (n - 1)) * (y - 10) / (0 - 10) + (n - 1) > i + 0.25)
        assert got[i] == (k % 2 == 1), i


@pytest.mark.parametrize("seed,eps,least", [(1, 0.5, 10), (2, 0.75, 14), (3, 0.5, 1)])
def test_dbscan_of_crowded_places(spark, seed, eps, least):
    pts = _places(seed, 150)
    near = {a[0]: [b[0] for b in pts if b[0] != a[0] and None not in (a[1], b[1]) and math.dist(a[1:], b[1:]) <= eps] for a in pts}
    core = {i for i in near if len(near[i]) + 1 >= least}
    want = {}
    for i in sorted(core):
        todo = [] if i in want else [i]
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += [k for k in near[j] if k in core]
    want |= {i: min((want[j] for j in near[i] if j in core), default=-1) for i in near if i not in core}
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", "x", "y", eps, least).collect()}
    assert got == {i: (c, i in core) for i, c in want.items()}


def test_copies_of_one_point(spark):
    n = 100_000  # 10^10 pairs
    p = spark.range(n).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert cluster.dbscan(p, "id", "x", "y", 1.0, 4).groupBy("cluster", "core").count().collect() == [(0, True, n)]
    assert cluster.leaders(p, "id", "x", "y", 1.0).groupBy("leader").count().collect() == [(0, n)]


@pytest.mark.parametrize("first", [4096, 3])
def test_leaders_of_crowded_places(spark, monkeypatch, first):
    monkeypatch.setattr(cluster, "FIRST", first)
    pts, want, led = _places(7, 150), {}, []
    for i, x, y in pts:
        near = min(((math.dist((x, y), (a, b)), j) for j, a, b in led), default=(math.inf, None)) if x is not None else (math.inf, None)
        if near[0] > 0.8:
            want[i] = i
            led += [(i, x, y)] if x is not None else []
        else:
            want[i] = near[1]
    assert dict(cluster.leaders(spark.createDataFrame(pts, "id long, x double, y double"), "id", "x", "y", 0.8).collect()) == want


def test_label_distances(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(90, 5)).astype("float32").astype(float) * 8
    v[40:60] = v[3]  # copies are at distance 0
    lab = [None if i == 7 else int(x) for i, x in enumerate(r.integers(0, 4, 90))]
    rows = [(i, lab[i], None if i == 11 else [float(x) for x in v[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, l int, v array<float>")
    want = {}
    for i, j in combinations(range(90), 2):
        k = tuple(sorted((lab[i], lab[j]))) if None not in (lab[i], lab[j]) else (lab[i] if lab[j] is None else lab[j],) * 2
        want.setdefault(k, []).append(None if 11 in (i, j) else math.dist(v[i], v[j]))
    monkeypatch.setattr(flow, "STRIP", 7)
    for blocks in (1, 3):
        got = {(x.a, x.b): x for x in flow.label_distances(df, "id", "l", "v", blocks).collect()}
        assert set(got) == set(want)
        for k, d in want.items():
            e = [x for x in d if x is not None]
            assert (got[k].n, got[k].nearest) == (len(d), pytest.approx(min(e), abs=1e-12)) and got[k].mean == pytest.approx(sum(e) / len(e), abs=1e-7) and got[k].farthest == pytest.approx(max(e))
    # every pair in a table, in pieces
    got = {(x.a, x.b): x.dist for x in flow.pairwise_distances(df, "id", "v", 3).collect()}
    assert len(got) == 90 * 89 // 2 and all(got[i, j] is None if 11 in (i, j) else got[i, j] == pytest.approx(math.dist(v[i], v[j])) for i, j in combinations(range(90), 2))


def test_matmul_dense_and_sparse_pieces(spark, monkeypatch):
    for k, v in {"ROWS": 5, "COLS": 3, "TERMS": 7, "PARTS": 2, "ENTRIES": 60}.items():
        monkeypatch.setattr(relational, k, v)
    r = random.Random(8)
    dense = [(i, j, float(r.randint(-3, 3))) for i in range(13) for j in range(10)]
    thin = [(100 + i, r.randint(0, 400), float(r.randint(1, 5))) for i in range(60)] + [(100, 7, 2.0), (100, 7, 3.0), (101, None, 1.0), (102, 7, None)]
    rows = dense + thin
    a = spark.createDataFrame(rows, "i long, j long, v double")
    want = {}
    for i, k, v in rows:
        for j, m, w in rows:
            if k == m and None not in (k, v, w):
                want[i, j] = want.get((i, j), 0.0) + v * w
    for block in (4, 4096):
        got = relational.matmul(a, relational.transpose(a), block).collect()
        assert len(got) == len({(x.i, x.j) for x in got}) and {(x.i, x.j): x.v for x in got} == {k: v for k, v in want.items() if v}


def test_centralities_by_source_and_by_level(spark, monkeypatch):
    r = random.Random(9)
    e = spark.createDataFrame([(r.randint(0, 29), r.randint(0, 29)) for _ in range(70)] + [(40, 41), (41, 42), (None, 3)], "src long, dst long")
    asked = graph.vertices(e).where("id % 3 <> 1").unionByName(spark.createDataFrame([(99,)], "id long"))  # 99 is not in the graph
    near = lambda f: {x[0]: pytest.approx(x[1]) for x in f(e, asked).collect()}
    whole = near(graph.closeness), near(graph.betweenness)
    assert whole[0][99] == 0
    monkeypatch.setattr(graph, "WHOLE", 3)
    assert graph._by_source(e, asked, None, "id long") is None
    assert {x[0]: x[1] for x in graph.closeness(e, asked).collect()} == whole[0]
    assert {x[0]: x[1] for x in graph.betweenness(e, asked).collect()} == whole[1]


def _plain_centralities(es):
    """Closeness and betweenness of every vertex, by plain breadth-first search."""
    vs = {v for e in es for v in e}
    to = {v: sorted({b for a, b in es if a == v and b != v}) for v in vs}
    close, between = {}, dict.fromkeys(vs, 0.0)
    for s in vs:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for a in order:
            for b in to[a]:
                if b not in dist:
                    dist[b], paths[b] = dist[a] + 1, 0
                    order.append(b)
                if dist[b] == dist[a] + 1:
                    paths[b] += paths[a]
        k, t = len(dist) - 1, sum(dist.values())
        close[s] = k / t * k / (len(vs) - 1) if t else 0.0
        dep = dict.fromkeys(order, 0.0)
        for a in reversed(order):
            dep[a] = sum(paths[a] / paths[b] * (1 + dep[b]) for b in to[a] if dist[b] == dist[a] + 1)
            between[a] += dep[a] if a != s else 0
    return close, between


def _acts(spark, path, users):
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").write.parquet(f"{path}/events.parquet")
    return {(a, b) for a, b in zip(users, users[1:]) if a != b}


def test_betweenness_is_of_all_sources(spark, tmp_path):
    from quarry.plans import registry

    r = random.Random(4)
    es = _acts(spark, tmp_path, [r.choice([r.randint(0, 40), r.randint(0, 5)]) for _ in range(90)] + list(range(100, 112)))  # a chain at the end
    got = {x[0]: x[1] for x in registry.QUERIES["graph_betweenness"](spark, str(tmp_path)).collect()}
    assert got == {v: pytest.approx(x, abs=1e-6) for v, x in _plain_centralities(es)[1].items()}


def test_closeness_is_of_all_vertices(spark, tmp_path):
    from quarry.plans import registry

    r = random.Random(6)
    es = _acts(spark, tmp_path, [r.choice([r.randint(0, 200), r.randint(0, 5)]) for _ in range(400)] + list(range(300, 307)))
    got = {x[0]: x[1] for x in registry.QUERIES["graph_closeness"](spark, str(tmp_path)).collect()}
    assert len(got) > 128 and got == {v: pytest.approx(x, abs=1e-8) for v, x in _plain_centralities(es)[0].items()}


def test_label_distances_far_from_the_origin(spark):
    v = [[1e6 + (i * k % 7) / 1024 for k in range(1, 5)] for i in range(40)]  # inner products lose such differences
    rows = [(i, i % 3, x) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (None, 0, v[0]), (40, 7, [math.inf] * 4), (41, 8, [math.inf] * 4)], "id long, l int, v array<double>")
    want = {}
    for (i, a, x), (j, b, y) in combinations(rows, 2):
        want.setdefault((min(a, b), max(a, b)), []).append(math.dist(x, y))
    got = {(x.a, x.b): x for x in flow.label_distances(df, "id", "l", "v", 3).collect()}
    assert {k for k in got if max(k) < 7} == set(want)
    for k, d in want.items():
        assert (got[k].n, got[k].nearest, got[k].mean, got[k].farthest) == (len(d), pytest.approx(min(d), rel=1e-12), pytest.approx(sum(d) / len(d), rel=1e-12), pytest.approx(max(d), rel=1e-12))
    assert got[0, 7].nearest == got[0, 7].mean == math.inf and math.isnan(got[7, 8].nearest) and math.isnan(got[7, 8].farthest)
