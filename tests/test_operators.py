"""Hand fixtures: definitions, nulls, ties and empty input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import cluster, graph, metrics, relational, sampling, series, stats, text


def one(df):
    return df.first()


def col(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_dispersion_fixtures(spark):
    assert one(stats.mad(col(spark, map(float, range(1, 10))), "x")).mad == 2
    g = spark.createDataFrame([("a", 5.0)] * 4 + [("b", float(i)) for i in range(1, 6)], "g string, x double")
    got = dict(stats.gini(g, "x", "g").collect())
    assert got["a"] == pytest.approx(0) and 0 < got["b"] < 1
    x = col(spark, [2.0, 4, 4, 4, 5, 5, 7, 9])
    assert one(stats.dispersion(x, "x")).cv == pytest.approx(0.4, abs=0.1)
    assert one(stats.describe(x, "x")).sem == pytest.approx(0.707, abs=0.1)


def test_outliers_and_histogram(spark):
    x = col(spark, [1.0, 2, 3, 4, 5, 100])
    assert [r.x for r in stats.zscore_outliers(x, "x", 2.0).collect()] == [100]
    h = stats.histogram(col(spark, [1.0, 2, 3, 4, 5]), "x", 5).collect()
    assert sum(r.n for r in h) == 5 and {r.bin for r in h} == set(range(5))
    assert stats.histogram(col(spark, []), "x", 5).count() == 0


def test_rank_tests(spark):
    rows = [(s, t, float(v)) for s, r in enumerate([(1, 5, 9), (2, 6, 10), (3, 7, 11), (4, 8, 12)]) for t, v in enumerate(r)]
    assert one(stats.friedman(spark.createDataFrame(rows, "s int, t int, x double"), "s", "t", "x")).chi2 == pytest.approx(8)
    two = [("a", v) for v in (1.0, 1.1, 1.2, 0.9, 1.0)] + [("b", v) for v in (1.0, 3.0, 5.0, 7.0, 9.0)]
    assert one(stats.levene(spark.createDataFrame(two, "g string, x double"), "x", "g")).w > 5.32
    c = stats.chi2_gof(spark.createDataFrame([(o, 15.0) for o in (16, 18, 16, 14, 12, 12)], "o int, e double"), "o", "e")
    assert one(c).chi2 == pytest.approx(2.0)
    assert stats.polyfit(spark.createDataFrame([(float(i), 1.0 + 2 * i + 3 * i * i) for i in range(9)], "x double, y double"), "x", "y", 2) == pytest.approx([1, 2, 3])


def test_scalar_edges(spark):
    r = one(spark.range(1).select(scalar.entr(0.0).alias("a"), scalar.entr(-1.0).alias("b"), scalar.rel_entr(0.0, 2.0).alias("c"), scalar.rel_entr(1.0, 0.0).alias("d"), scalar.safe_divide(1, 0).alias("e"), scalar.norm_cdf(1.96).alias("f"), scalar.norm_ppf(0.975).alias("g"), scalar.boxcox(-1.0, 0.5).alias("h"), scalar.inv_boxcox(scalar.boxcox(3.0, 0.5), 0.5).alias("i")))
    assert (r.a, r.b, r.c, r.d, r.e, r.h) == (0, -math.inf, 0, math.inf, None, None)
    assert r.f == pytest.approx(0.975, abs=1e-4) and r.g == pytest.approx(1.96, abs=1e-3) and r.i == pytest.approx(3)


def test_text_fixtures(spark):
    d = spark.createDataFrame([("kitten", "sitting"), ("hello", "hello"), ("", "hello"), ("", "")], "a string, b string")
    assert [r[0] for r in d.select(F.levenshtein("a", "b")).collect()] == [3, 0, 5, 0]
    assert [r[0] for r in d.select(scalar.levenshtein_ratio("a", "b")).collect()][1:] == [0, 1, 0]
    t = spark.createDataFrame([("Hello, world! This is a test.",), (None,), ("  ",)], "t string")
    assert [r[0] for r in t.select(text.clean("t", ["is", "a"])).collect()][0] == "Hello world This test"
    assert [r[0] for r in t.select(F.size(text.words("t"))).collect()] == [6, 0, 0]
    assert [r[0] for r in t.select(text.ngrams(text.words("t"), 2)).collect()][0][:2] == ["hello world", "world this"]
    s = spark.createDataFrame([("This is a simple test. It has short sentences. Words are small.",)], "t string")
    r = one(text.readability(s, "t", []))
    assert (r.n_words, r.n_sentences) == (12, 3) and r.n_syllables >= 12
    f = spark.createDataFrame([(1, "I am not happy"), (2, "happy sad"), (3, "unknown")], "i int, t string")
    assert {r.i: r.score for r in text.sentiment(f, "t", ["i"]).collect()} == {1: -2.0, 2: 0.0, 3: 0.0}
    pairs = spark.createDataFrame([("MARTHA", "MARHTA"), ("", ""), ("a", ""), ("a", "b"), (None, "a")], "a string, b string")
    jw = [r.v for r in pairs.select(text.jaro_winkler("a", "b").alias("v")).collect()]
    assert jw[0] == pytest.approx(0.9611, abs=1e-4) and jw[1:] == [1, 0, 0, None]
    assert {w: v for w, v in text.POSITIVE.items() if w in ("happy", "nice")} == {"happy": 2.0, "nice": 1.0} and text.NEGATIVE["sad"] == -2.0
    d = spark.createDataFrame([("kitten", "sitting"), ("ab", "ba"), ("", "abc"), (None, "x")], "a string, b string")
    assert [r.v for r in d.select(text.weighted_levenshtein("a", "b", 2.0, 1.0, 1.5).alias("v")).collect()] == [5.0, 3.0, 6.0, None]
    assert [r.v for r in d.select(text.weighted_damerau("a", "b", transpose=0.5).alias("v")).collect()] == [3.0, 0.5, 3.0, None]


def test_series_fixtures(spark):
    d = spark.createDataFrame([("k", i, float(i)) for i in range(1, 11)], "k string, i int, x double")
    assert sorted(r["mean"] for r in series.moving(d, ["k"], "i", "x", 3).collect()) == [float(v) for v in range(2, 10)]
    g = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("z", 0, None)], "k string, i int, x double")
    assert [r.filled for r in series.linear_fill(g, ["k"], "i", "x").orderBy("k", "i").collect()] == [1, 1, 2, 3, 4, 4, None]
    s = spark.createDataFrame([("k", i, 10 + i * 0.5 + [3.0, -1.0, -2.0][i % 3]) for i in range(30)], "k string, i int, x double")
    r = series.decompose(s, ["k"], "i", "x", 3).where("trend IS NOT NULL").collect()
    assert all(abs(v.resid) < 1e-9 for v in r)
    q = series.stl(s, ["k"], "i", "x", 3).collect()
    assert max(abs(v.x - v.trend - v.seasonal - v.resid) for v in q) < 1e-9


def test_sampling_fixtures(spark):
    d = spark.range(5).withColumn("y", F.col("id") % 2)
    s = sampling.train_test_split(d, "id", 0.4).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 3, "test": 2}
    with pytest.raises(ValueError):
        sampling.stratified_sample(d, "id", "y", 6)
    assert sampling.time_series_split(10, 3, 2, 1) == [(2, 3, 5), (4, 5, 7), (6, 7, 9)]
    folds = [r.fold for r in sampling.k_fold(spark.range(11), "id", 3).orderBy("id").collect()]
    assert folds == [0] * 4 + [1] * 4 + [2] * 3
    c = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert [tuple(r) for r in sampling.min_max(c, ["a", "b"]).collect()] == [(0.5, 0.0), (0.5, 1.0)]
    assert [r.a for r in sampling.standardize(c, ["a"]).collect()] == [0.0, 0.0]


def test_metric_fixtures(spark):
    b = spark.createDataFrame(list(zip([1, 0, 1, 0, 1, 0], [1, 0, 0, 0, 1, 1])), "y int, p int")
    r = one(metrics.binary(b, "y", "p"))
    assert [r.accuracy, r.precision, r.recall, r.f1] == pytest.approx([2 / 3] * 4)
    k = spark.createDataFrame([("s", i, y, s) for i, (y, s) in enumerate(zip([1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5]))], "q string, l int, y int, s double")
    r = one(metrics.ranking(k, "q", "l", "y", "s"))
    assert (r.coverage_error, r.lrap, r.ranking_loss) == (2, 1, 0)
    c = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 2, 2], [0, 0, 0, 1, 1, 1])), "t int, p int, q int")
    assert one(metrics.clustering(c, "t", "p")).ari == pytest.approx(1)
    assert 0 < one(metrics.clustering(c, "t", "q")).ari < 1
    x = spark.createDataFrame([("a", [1.0, 1.0], 0), ("b", [1.5, 1.5], 0), ("c", [5.0, 5.0], 1), ("d", [5.5, 5.5], 1)], "i string, v array<double>, l int")
    assert cluster.silhouette(x, "l", "v") > 0.5


def test_graph_fixtures(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "src string, dst string")
    r = {x.id: x["rank"] for x in graph.pagerank(e, iterations=30).collect()}
    assert min(r.values()) > 0 and sum(r.values()) == pytest.approx(1)
    m = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0), ("A", "C", 3.0), ("C", "D", 1.0)], "src string, dst string, weight double")
    f = graph.spanning_forest(m).collect()
    assert len(f) == 3 and sum(x.weight for x in f) == 4
    assert {x.id: x.dist for x in graph.shortest_paths(m, "A").collect()} == {"A": 0, "B": 1, "C": 3, "D": 4}
    k = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("D", "B"), ("E", "D")], "src string, dst string")
    assert dict(graph.core_numbers(k).collect()) == {"A": 2, "B": 2, "C": 2, "D": 2, "E": 1}
    t = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "src string, dst string")
    assert dict(graph.topological_levels(t).collect()) == {"A": 0, "B": 1, "C": 1, "D": 2}
    with pytest.raises(ValueError):
        graph.topological_levels(e)
    assert graph.euler_type(t) == "circuit"


def test_dbscan(spark):
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)] + [(10, 50.0, 0.0), (11, 50.5, 0.0), (12, 51.0, 0.0), (20, 99.0, 9.0)], "id long, x double, y double")
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(p, "id", "x", "y", 1.0, 3).collect()}
    assert got[20] == (-1, False) and {got[i][0] for i in range(5)} == {1} and got[0] == (1, False) and {got[i][0] for i in (10, 11, 12)} == {10}


def test_validation(spark):
    d = spark.createDataFrame([(1, 1000), (2, 1010), (3, 1005), (4, 1020)], "i int, t int").withColumn("k", F.lit(1))
    assert [r.violation for r in relational.temporal_violations(d, ["k"], "i", "t").collect()] == ["monotonic"]
    m = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert {r.column: r.n_missing for r in relational.missing(m).collect()} == {"x": 2, "s": 1}
    with pytest.raises(Exception, match="unknown branch"):
        relational.branch(d, F.lit("zz"), {"a": lambda x: x}).collect()


def test_grid_join_matches_all_pairs(spark):
    rng = np.random.default_rng(0)
    pts = rng.uniform(0, 5, (60, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {(r.l_id, r.r_id) for r in relational.grid_join(p, p, "x", "y", 0.7).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if np.hypot(*(pts[i] - pts[j])) <= 0.7}


def test_graph_rounds_go_to_the_end(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, weight double")
    far = {i: i for i in range(7)}
    assert dict(graph.bfs(e, 0).collect()) == dict(graph.bfs(e, 0, limit=6).collect()) == far
    assert dict(graph.shortest_paths(e, 0).collect()) == dict(graph.shortest_paths(e, 0, limit=6).collect()) == far
    for f in (graph.bfs, graph.shortest_paths):
        with pytest.raises(ValueError):
            f(e, 0, limit=5)


def test_whole_graph_has_every_supplier_and_part(spark, tmp_path):
    from quarry.plans import models, registry

    rows = [(o, o % 7, o % 130) for o in range(1, 400)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = {2 * s for _, s, _ in rows} | {2 * p + 1 for _, _, p in rows}
    assert {r.id for r in registry.QUERIES["graph_core_numbers"](spark, str(tmp_path)).collect()} == ids
    edges = models._all_edges(spark, str(tmp_path))
    assert {r.id for r in graph.label_propagation(edges, 2).collect()} == ids
    assert graph.spanning_forest(edges.withColumn("weight", F.lit(1.0) + (F.col("src") * 7 + F.col("dst")) % 5)).count() == len(ids) - 1  # one component


def test_centralities_of_small_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5), (5, 4)], "src int, dst int")
    everyone = graph.vertices(e)
    b = {r.id: r.betweenness for r in graph.betweenness(e, everyone).collect()}
    assert b == {1: 0.0, 2: 3.0, 3: 1.0, 4: 0.0, 5: 1.0}  # directed paths through each vertex
    d = graph.diameter_radius(e).first()
    assert (d.diameter, d.radius) == (3, 2)
    c = {r.id: r.closeness for r in graph.closeness(e, everyone).collect()}
    assert c[4] == 0 and c[1] == pytest.approx(4 / 8 * 4 / 4)
    two = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)], "src int, dst int")
    assert dict(graph.strong_components(two).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    k4 = spark.createDataFrame([(i, j) for i in range(4) for j in range(i)], "src int, dst int")
    assert {round(r.score, 6) for r in graph.eigenvector(k4, 5).collect()} == {0.5}
    core = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("D", "B"), ("E", "D")], "src string, dst string")
    assert dict(graph.core_numbers(core).collect()) == {"A": 2, "B": 2, "C": 2, "D": 2, "E": 1}
