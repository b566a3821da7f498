"""The registered queries of this sub-package and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import base, crf, fingerprint, jaccard, licences, mixing, piecefst, substring, topk, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(base.table(spark, sf_dir, "documents"), 20)


QUERIES["op7_substring_dedup"] = op7_substring_dedup
ORACLES["op7_substring_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 19 <= len(w) THEN array_to_string(w[pos:pos + 19], ' ') END AS win FROM e),
r AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS late FROM g),
c AS (SELECT *, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(base.table(spark, sf_dir, "documents"), 5, 80)


QUERIES["op2_ngram_jaccard_join"] = op2_ngram_jaccard_join
ORACLES["op2_ngram_jaccard_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT min(doc_id) AS id, len(g) AS n, g FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
x AS (SELECT id, n, unnest(g) AS gram FROM u),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
y AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT id, id AS root FROM u UNION SELECT c.id, y.b FROM c JOIN y ON c.root = y.a),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.root END AS component_id
FROM s JOIN u ON list_sort(s.g) = u.g JOIN m ON m.id = u.id"""


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings")
    return topk.top_k(e, e.where("vec_id % 100 = 0"), 10, 1024)


QUERIES["op1_exact_top_k"] = op1_exact_top_k
ORACLES["op1_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(base.table(spark, sf_dir, "documents"))


def _licence_sql(templates: list[tuple[str, str]], threshold: float) -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in licences.bigrams_of(text))}])" for name, text in templates)
    return f"""
WITH t(licence, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(string_split(x, chr(10)) || regexp_split_to_array(x, '\\n[ \\t\\r]*\\n') || [x])) AS unit FROM d),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(unit, '[^a-z0-9]+'), lambda z: z <> '') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, unit, licence, len(grams) AS size, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score FROM g, t WHERE len(g) < 4000),
b AS (SELECT doc_id, unit, licence, size, score FROM s WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY score DESC, size DESC, licence) = 1),
m AS (SELECT doc_id, count(*) AS n_matches FROM b GROUP BY doc_id),
f AS (SELECT doc_id, licence, score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, size DESC, licence) = 1)
SELECT d.doc_id, f.licence, coalesce(f.score, 0.0::DOUBLE) AS score, CAST(coalesce(m.n_matches, 0) AS INTEGER) AS n_matches
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)"""


QUERIES["op3_licence_scan"] = op3_licence_scan
ORACLES["op3_licence_scan"] = _licence_sql(licences.TEMPLATES, licences.THRESHOLD)

#: The rules of the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base.table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.html_edges(pages))


QUERIES["op6_url_filter"] = op6_url_filter
# no page of the tables has a redirect or canonical link, so the rules decide alone; the tests hold edges against brute force
ORACLES["op6_url_filter"] = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(x, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, '.' || host AS h FROM p),
b AS (SELECT page_id, host, path, CASE WHEN h LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN h LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/' WHEN h LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN h LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM b"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


#: Shares of the quality domains of the label table in the mix.
QUALITY_WEIGHTS = {1: 0.95, 0: 0.05}


def op8_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs.select("doc_id", "text"), labels, "quality", QUALITY_WEIGHTS)
    return mixed.selectExpr("doc_id", "_tokens AS n_tokens", "_p AS posteriors", "_rate AS rate")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecefst.digests(base.table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(base.table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op4_language_id, op5_toxicity, op8_domain_mixing, op9_sentencepiece, op10_fingerprints)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
