from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.streaming import metrics, windows

T0 = datetime(2024, 1, 1)


def drain(df, name, mode, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_tumbling_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=i * 7), f"u{i % 3}", float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "ts timestamp, k string, value double").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = drain(windows.tumbling(s, "ts", "1 hour", ["k"], "value", None), "tumble", "complete", spark)
    want = windows.tumbling(d, "ts", "1 hour", ["k"], "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
    assert windows.sliding(d, "ts", "1 hour", "30 minutes", ["k"], "value").agg(F.sum("n")).first()[0] == 120
    assert windows.sessions(d, "ts", "10 minutes", ["k"]).count() == 60
    assert windows.deduplicate(d, "ts", ["k"]).count() == 3


def test_online_metrics_equal_the_kernel(spark, tmp_path):
    rows = [("a", i, float(i % 2), float(i % 2 if i < 60 else 1 - i % 2)) for i in range(100)] + [("b", i, 1.0, 1.0) for i in range(40)]
    d = spark.createDataFrame(rows, "k string, i int, y double, p double").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = {r.key: r for r in drain(metrics.online_metrics(s, "k", "i", "y", "p"), "online", "update", spark)}
    for k in "ab":
        state = metrics.State()
        level, odd = metrics.fold(((y, p) for key, _, y, p in rows if key == k), state)
        assert (got[k].n, got[k].drift, got[k].anomaly, got[k].window) == (state.n, level, odd, state.window)
        assert abs(got[k].accuracy - state.correct / state.n) < 1e-12
    assert got["a"].drift == "drift" and got["b"].drift == "none" and got["b"].accuracy == 1
