import random

from quarry.llm import base


def test_stages_end_to_end(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(1)
    word = lambda: "".join(r.choice(["the", "ing", "tion", "er", "ou", "nd"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(f"pass{i}" for i in range(70))
    rows, labels = [], []
    for i in range(160):
        w = [word() for _ in range(r.randint(40, 120))]
        bad = i % 4 == 0
        if bad:
            w[5] = w[9] = w[20] = w[33] = "vilex"
        t = " ".join(w)
        if i in (33, 66, 99):
            t += " " + passage
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(bad)))
    for k, i in enumerate((11, 13, 14)):
        t = rows[i][1] + (" extra" if k else "")
        rows.append((500 + k, t, "en", "s", len(t)))
    for i in range(600, 640):
        t = "junk!!! $$$ " * 30 + str(i)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 0, 0))
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        docs = base.materialize(stage(spark, docs, str(tmp_path)))
        kept[name] = {x.doc_id: x for x in docs.collect()}
    clean = {i for i in range(160) if i % 4}
    assert clean <= set(kept["toxicity"]) and len(set(kept["toxicity"]) & {i for i in range(0, 160, 4)}) <= 2
    near = kept["near_duplicates"]
    assert clean <= set(near) and not {500, 501, 502} & set(near) and {700, 701} <= set(near)
    cut = kept["substring_dedup"]
    assert "pass3" in cut[33].text and "pass3" not in cut[66].text and cut[66].n_chars == len(cut[66].text)
    mix = kept["mixing"]
    assert len(clean & set(mix)) >= 0.97 * len(clean) and all(x.text == cut[d].text for d, x in mix.items())
    out = kept["sentencepiece"]
    assert set(out) == set(mix) and all(len(x.ids or []) == x.n_tokens for x in out.values())
