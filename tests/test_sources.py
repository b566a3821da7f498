import json

import numpy as np

from quarry.sources import files


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", "# note\na;b\n1;x\nNA;y\n")
    d = files.read_csv(spark, p, "a int, b string", ";", True, "#", "NA")
    assert [tuple(r) for r in d.collect()] == [(1, "x"), (None, "y")]
    files.write_csv(d, str(tmp_path / "out"), quote_all=True)
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2


def test_arff(spark, tmp_path):
    p = put(tmp_path / "a.arff", "% c\n@relation r\n@attribute x numeric\n@attribute 'k' {red, blue}\n@attribute s string\n\n@data\n1.5,red,'a, b'\n?,blue,?\n")
    assert [tuple(r) for r in files.read_arff(spark, p).collect()] == [(1.5, "red", "a, b"), (None, "blue", None)]


def test_graph_files(spark, tmp_path):
    p = put(tmp_path / "e.txt", "# head\n\na b 1.5\nb c x\nc a 2\nlone\n")
    assert sorted(map(tuple, files.read_edge_list(spark, p, True).collect())) == [("a", "b", 1.5), ("c", "a", 2.0)]
    assert files.read_edge_list(spark, p).count() == 3
    j = put(tmp_path / "g.json", json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}))
    nodes, edges = files.read_graph_json(spark, j)
    assert nodes.count() == 2 and tuple(edges.first()) == ("a", "b", 1.0)


def test_matrix_market_and_vocabulary(spark, tmp_path):
    p = put(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n1 1 2.0\n3 1 4.0\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, p).collect())) == [(0, 0, 2.0), (0, 2, 4.0), (2, 0, 4.0)]
    v = put(tmp_path / "v.txt", "one\ntwo\nthree\n")
    assert {r.term: r.id for r in files.read_vocabulary(spark, v).collect()} == {"one": 0, "two": 1, "three": 2}


def test_wav_and_checksums(spark, tmp_path):
    x = np.sin(np.arange(200) / 5) / 2
    p = put(tmp_path / "a.wav", files.wav_bytes(x, 8000))
    r = files.read_wav(spark, p).first()
    assert r.rate == 8000 and r.channels == 1 and np.abs(np.array(r.samples) - x).max() < 1e-4
    assert files.checksums(spark, p).first().length == 444


def test_synthetic(spark):
    b = files.make_blobs(spark, 90, [[0.0, 0.0], [50.0, 50.0]], 1.0, 3)
    assert b.groupBy("label").count().count() == 2 and b.where("label = 1 AND x0 < 25").count() == 0
    assert files.make_regression(spark, 10, [1.0, 2.0]).count() == 10
