import re

from quarry.llm import licences


def brute(text, templates, t):
    if not text:
        return None, 0.0, 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    units = set(low.split("\n")) | set(re.split(r"\n[ \t\r]*\n", low)) | {low}
    found = []
    for u in units:
        g = set(licences.bigrams_of(u))
        best = None
        for name, body in templates:
            b = set(licences.bigrams_of(body))
            s = 2.0 * len(g & b) / (len(g) + len(b)) if g else 0.0
            if s >= t and (best is None or (-s, -len(b), name) < best):
                best = (-s, -len(b), name)
        if best:
            found.append(best)
    return (min(found)[2], -min(found)[0], len(found)) if found else (None, 0.0, 0)


def test_matches_brute_force(spark):
    mit = dict(licences.TEMPLATES[::-1])["MIT"]
    long = licences.TEMPLATES[2][1]
    texts = [None, "", "x", "Released under the MIT License.", "code\nRELEASED under the  mit license\nmore code", long, "\n".join(long.split(". ")), "a b c\n\n" + "\n".join(long.split(", ")) + "\n \nz", mit.replace("under", "with"), "licensed under cc by nc 4 0 and more words", "License " * 300, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0.", "é licensed under cc by 4.0 É", "Permission is hereby granted, free of charge"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS _t")
    for t in (0.8, 0.5):
        got = {r.doc_id: (r.licence, round(r.score, 9), r.n_matches) for r in licences.scan(df, threshold=t).collect()}
        want = {i: brute(x, licences.TEMPLATES, t) for i, x in enumerate(texts)}
        assert got == {i: (a, round(b, 9), c) for i, (a, b, c) in want.items()}


def test_no_templates_and_no_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licences.scan(df, []).first().licence is None
    assert licences.scan(df.where("false")).count() == 0


def test_anchors_cover_every_match():
    words = licences.anchors(licences.TEMPLATES, 0.8)
    for _, body in licences.TEMPLATES:
        g = licences.bigrams_of(body)
        need = licences.size_bounds(len(g), 0.8)[0]
        assert sum(not any(w in x for w in words) for x in g) < need
