"""Formats, online kernels and operators whose fixtures are small tables."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, flow, sampling, selection, state, stats
from quarry.sources import files
from quarry.streaming import online


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.svm").write_text("1 1:0.5 3:2 # note\n\n-1 2:1.5\n0\n")
    got = files.read_libsvm(spark, str(tmp_path / "a.svm")).collect()
    assert [(r.label, r.indices, r["values"]) for r in got] == [(1.0, [1, 3], [0.5, 2.0]), (-1.0, [2], [1.5]), (0.0, [], [])]
    (tmp_path / "a.jsonl").write_text('{"a": {"b": {"c": 1}, "d": [1, 2]}, "e": "x"}\n')
    j = files.read_nested_json(spark, str(tmp_path / "a.jsonl"))
    assert j.columns == ["a.b.c", "a.d", "e"] and tuple(j.first()) == (1, [1, 2], "x")
    (tmp_path / "g.adj").write_text("# graph\na b c\nb\n\nc a\n")
    assert sorted(map(tuple, files.read_adjacency(spark, str(tmp_path / "g.adj")).collect())) == [("a", "b"), ("a", "c"), ("c", "a")]
    (tmp_path / "g.dot").write_text('digraph g {\n a -> "b c" [weight=2.5];\n x -- y;\n n;\n}\n')
    assert sorted(map(tuple, files.read_dot(spark, str(tmp_path / "g.dot")).collect())) == [("a", "b c", 2.5, True), ("x", "y", None, False)]
    (tmp_path / "g.gml").write_text("graph [\n node [ id 1 ]\n edge [\n source 1\n target 2\n weight 0.5 ]\n edge [ source 2 target 3 ]\n]")
    assert sorted(map(tuple, files.read_gml(spark, str(tmp_path / "g.gml")).collect())) == [("1", "2", 0.5), ("2", "3", None)]
    (tmp_path / "g.graphml").write_text('<graphml><graph><edge source="a" target="b"/><edge id="e" source="b" target="c"></edge></graph></graphml>')
    assert sorted(map(tuple, files.read_graphml(spark, str(tmp_path / "g.graphml")).collect())) == [("a", "b"), ("b", "c")]
    (tmp_path / "l.txt").write_text("x\ny\nz\n")
    assert [(r.line, r.value) for r in files.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == [(0, "x"), (1, "y"), (2, "z")]


def test_binary_formats_and_manifest(spark, tmp_path):
    i, j, v = np.array([0, 2]), np.array([1, 0]), np.array([1.5, -2.0])
    (tmp_path / "m.npz").write_bytes(files.sparse_npz_bytes(i, j, v, (3, 2)))
    assert sorted(map(tuple, files.read_sparse_npz(spark, str(tmp_path / "m.npz")).collect())) == [(0, 1, 1.5), (2, 0, -2.0)]
    (tmp_path / "m.mat").write_bytes(files.mat4_bytes({"a": np.array([[1.0, 2.0], [3.0, 4.0]]), "b": np.array([7.0])}))
    assert sorted(map(tuple, files.read_mat4(spark, str(tmp_path / "m.mat")).collect())) == [("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 0, 3.0), ("a", 1, 1, 4.0), ("b", 0, 0, 7.0)]
    data = np.array([1, 2, 3], "<f4").tobytes()
    head = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [3], "data_offsets": [0, 12]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + data)
    r = files.read_safetensors(spark, str(tmp_path / "m.safetensors")).first()
    assert (r.name, r.dtype, r["shape"], r["values"]) == ("w", "F32", [3], [1.0, 2.0, 3.0])
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a").write_text("a")
    (folder / "b").write_text("b")
    then = spark.createDataFrame(files.manifest(spark, str(folder)).collect())
    assert files.verify(spark, str(folder), then).count() == 0
    (folder / "a").write_text("changed")
    (folder / "b").unlink()
    (folder / "c").write_text("c")
    assert sorted(map(tuple, files.verify(spark, str(folder), then).collect())) == [("a", "changed"), ("b", "missing"), ("c", "new")]


def test_chunks(spark):
    got = files.map_chunks(spark.range(10).coalesce(1), 4, lambda c: c.agg(["sum", "size"]).T.rename(columns={"size": "n"})[["sum", "n"]], "sum long, n long").collect()
    assert [tuple(r) for r in got] == [(6, 4), (22, 4), (17, 2)]
    one = flow.chunk_reduce(spark.range(1, 9), ["id"], 3, {"s": F.sum("id")})
    assert sum(r.s for r in one.collect()) == 36 and one.count() == 3


def test_online_kernels():
    kept: list[float] = []
    r = random.Random(1)
    for k in range(50):
        m, v, odd = online.history(kept, float(k % 5), size=20)
        assert not odd and m == pytest.approx(np.mean(kept)) and (k == 0 or v == pytest.approx(np.var(kept, ddof=1)))
    assert len(kept) == 20 and online.history(kept, 100.0)[2]
    window: list[float] = []
    assert not any(online.adwin(window, r.gauss(0, 1)) for _ in range(150))
    assert any([online.adwin(window, r.gauss(5, 1)) for _ in range(60)]) and sum(v < 2 for v in window) <= 4
    s: dict = {}
    assert all(online.eddm(s, k % 20 == 0) != "drift" for k in range(1200))
    assert "drift" in [online.eddm(s, k % 2 == 0) for k in range(2000)]
    d, far = online.ks_drift([1, 2, 3, 4] * 20, [1, 2, 3, 4] * 20)
    assert d == 0 and not far and online.ks_drift(list(range(50)), [x + 40 for x in range(50)])[1] and online.ks_drift([], [1.0]) == (0.0, False)
    assert [online.vote(x) for x in (["none"] * 3, ["drift", "drift", "none"], ["drift", "warning", "none"], [])] == ["none", "drift", "warning", "none"]


def test_history_stream(spark, tmp_path):
    rows = [(f"k{i % 2}", i, float(i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "k string, t int, x double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, t int, x double").parquet(str(tmp_path / "in"))
    q = online.history_metrics(src, "k", "t", "x").writeStream.format("memory").queryName("hist").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {x.key: x for x in spark.table("hist").orderBy("n").collect()}
    for k in ("k0", "k1"):
        xs = [x for key, _, x in rows if key == k]
        assert got[k].n == 30 and got[k].mean == pytest.approx(np.mean(xs)) and not got[k].drift
    seen = []
    online.for_each_batch(src, lambda b, i: seen.append(b.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == 60
    v = {x.term: (x.n, x["df"]) for x in online.streaming_vocabulary(spark.createDataFrame([("a b a",), ("b",), (None,)], "t string"), F.split("t", " ")).collect()}
    assert v == {"a": (2, 1), "b": (2, 2)}


def test_leaders_match_the_sequential_rule(spark):
    r = random.Random(4)
    pts = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(150)]
    want, leaders = {}, []
    for i, x, y in pts:
        near = min(((math.dist((x, y), (a, b)), j) for j, a, b in leaders), default=(math.inf, None))
        if near[0] > 1.5:
            leaders.append((i, x, y))
            want[i] = i
        else:
            want[i] = near[1]
    got = dict(cluster.leaders(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 1.5).collect())
    assert got == want
    with pytest.raises(ValueError):
        cluster.leaders(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 0.0)


def test_sampling_errors_and_replacement(spark):
    d = spark.createDataFrame([(i, w) for i, w in enumerate([0.1, 0.1, 0.1, 0.8, 0.9, 1.0])], "id int, w double")
    assert {r.id for r in sampling.importance_sample(d, "id", "w", 3, 42).collect()} <= set(range(6)) and sampling.importance_sample(d, "id", "w", 3, 42).count() == 3
    for bad in (d.withColumn("w", F.col("w") - 0.5), d.withColumn("w", F.lit(0.0))):
        with pytest.raises(ValueError):
            sampling.importance_sample(bad, "id", "w", 2)
    with pytest.raises(ValueError):
        sampling.random_sample(d, "id", 7)
    assert sampling.random_sample(d, "id", 7, replacement=True).count() == 7
    b = sampling.bootstrap(d, "id", 5, 3, 1)
    assert {r["count"] for r in b.groupBy("replicate").count().collect()} == {5}
    draws = sampling.importance_sample(d, "id", "w", 3000, 1, True).groupBy("id").count().collect()
    share = {r.id: r["count"] / 3000 for r in draws}
    assert share[5] == pytest.approx(1 / 3, abs=0.05) and share[0] == pytest.approx(1 / 30, abs=0.02)


def test_order_statistics_and_tau(spark):
    r = random.Random(6)
    xs = [round(r.gauss(0, 3), 2) for _ in range(400)] + [None, 1e9]
    d = spark.createDataFrame([(x, None if x is None else round(x + r.gauss(0, 2), 1), i % 3) for i, x in enumerate(xs)], "x double, y double, g int")
    v = np.array([x for x in xs if x is not None])
    q = state.quantiles(d, "x", [0.0, 0.3, 0.5, 1.0]).first()
    assert list(q) == pytest.approx(list(np.quantile(v, [0.0, 0.3, 0.5, 1.0])))
    pairs = [(p.x, p.y) for p in d.where("x IS NOT NULL").collect()]
    con = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(pairs) for b in pairs[:i])
    n0 = sum(a[0] != b[0] for i, a in enumerate(pairs) for b in pairs[:i])
    n1 = sum(a[1] != b[1] for i, a in enumerate(pairs) for b in pairs[:i])
    assert stats.kendall_tau_b(d, "x", "y").first()[0] == pytest.approx(con / math.sqrt(n0 * n1))
    assert state.quantiles(d.where("false"), "x", [0.5]).count() == 0 or state.quantiles(d.where("false"), "x", [0.5]).first()[0] is None


def test_pipeline_reports_and_names_steps(spark):
    p = flow.Pipeline().filter("id > 2").inspect("after").map_each({"b": F.col("id") * 2})
    assert p.run(spark.range(6)).collect()[-1].b == 10 and p.seen["after"].get["rows"] == 3
    with pytest.raises(Exception) as e:
        flow.Pipeline().stage("broken", lambda d: d.select("nothing").collect()).run(spark.range(2))
    assert any("broken" in n for n in e.value.__notes__)


def test_select_k_best(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "column string, score double")
    assert selection.select_k_best(s, 2) == ["b", "c"]
