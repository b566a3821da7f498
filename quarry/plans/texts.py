"""Queries over the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import text
from quarry.plans.registry import read, register

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_WORDS = _W.format("text")


@register("text_token_counts", f"SELECT term, count(*) AS n FROM (SELECT unnest({_WORDS}) AS term FROM documents) GROUP BY term")
def text_token_counts(spark, d):
    return text.token_counts(read(spark, d, "documents"), text.words("text"))


@register("text_char_trigrams", "SELECT g AS term, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(p_name, i, 3))) AS g FROM part) GROUP BY g")
def text_char_trigrams(spark, d):
    return text.token_counts(read(spark, d, "part"), text.char_ngrams("p_name", 3))


@register("text_ngrams", f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)
 SELECT conv_id, turn, len(w) AS n_words, greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_grams, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS first_gram FROM w""")
def text_ngrams(spark, d):
    c = read(spark, d, "conversations").withColumn("w", text.words("text"))
    g = c.withColumn("g", text.ngrams(F.col("w"), 2, 3))
    return g.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.size("g").cast("long").alias("n_grams"), F.get("g", F.lit(0)).alias("first_gram"))


@register("text_sentences", r"SELECT conv_id, turn, CAST(len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda s: trim(s) <> '')) AS INTEGER) AS n FROM conversations")
def text_sentences(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(text.sentences("text")).alias("n"))


@register("text_clean", r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]+', '', 'g'), '\s+', ' ', 'g'))) AS h FROM conversations")
def text_clean(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(text.clean("text").cast("binary")).alias("h"))


@register("text_token_filter", f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter({_WORDS}, lambda t: length(t) BETWEEN 3 AND 8 AND regexp_matches(t, '^[a-z]+$') AND NOT list_contains(['the', 'and', 'that'], t))) AS term FROM conversations) GROUP BY term")
def text_token_filter(spark, d):
    t = text.filter_tokens(text.words("text"), 3, 8, "^[a-z]+$", ["the", "and", "that"])
    return text.token_counts(read(spark, d, "conversations"), t)


@register("text_strip_html", r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style)\s*>|<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM pages),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM s)
 SELECT page_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS h FROM e""")
def text_strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.strip_html("html").cast("binary")).alias("h"))


@register("text_mask", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), 'https?://[^\s<>"]+|www\.[^\s<>"]+', '<url>', 'g')) AS h FROM documents""")
def text_mask(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.mask("text").cast("binary")).alias("h"))


@register("text_collocations", f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), p AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM t)
 SELECT x.t AS a, y.t AS b, count(*) AS n FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.i > x.i AND y.i < x.i + 3 GROUP BY 1, 2 HAVING count(*) >= 5""")
def text_collocations(spark, d):
    return text.collocations(read(spark, d, "conversations"), text.words("text"), 3, 5)


@register("text_vocabulary", f"""WITH p AS (SELECT item_id, {_WORDS} AS w FROM benchmark), e AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM p),
 f AS (SELECT term, min(item_id * 1000000 + i) AS k FROM e GROUP BY term) SELECT term, row_number() OVER (ORDER BY k) - 1 AS id FROM f""")
def text_vocabulary(spark, d):
    return text.vocabulary(read(spark, d, "benchmark"), "item_id", text.words("text"))


@register("text_tfidf", f"""WITH e AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM e GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
 w AS (SELECT item_id, term, tf, tf * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n)
 SELECT item_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 8) AS weight FROM w""")
def text_tfidf(spark, d):
    return text.tfidf(read(spark, d, "benchmark"), "item_id", text.words("text")).withColumn("weight", F.round("weight", 8))


@register("text_tfidf_raw", f"""WITH e AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM e GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark)
 SELECT item_id, term, tf, round(tf * ln(n::DOUBLE / df), 8) AS weight FROM tf JOIN df USING (term), n""")
def text_tfidf_raw(spark, d):
    return text.tfidf(read(spark, d, "benchmark"), "item_id", text.words("text"), smooth=False, l2=False, plus_one=False).withColumn("weight", F.round("weight", 8))


@register("text_hashing", f"SELECT item_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens, true AS inside FROM benchmark WHERE len({_WORDS}) > 0")
def text_hashing(spark, d):
    """Sums and ranges of the hashed counts: the hash itself is not SQL's."""
    h = text.hashing_counts(read(spark, d, "benchmark"), "item_id", text.words("text"), 256)
    slot, n = [c for c in h.columns if c != "item_id"][:2]
    return h.groupBy("item_id").agg(F.sum(n).cast("long").alias("n_tokens"), F.min(F.col(slot).between(0, 255)).alias("inside"))


_SYL = "list_transform(w, lambda x: CASE WHEN octet_length(encode(x)) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(x, '(es|ed|e)$', ''), '[aeiouy]+')), 1) END)"


@register("text_readability", rf"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w, greatest(len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda s: trim(s) <> '')), 1)::DOUBLE AS s, length(regexp_replace(text, '\s', '', 'g')) AS c FROM conversations),
 y AS (SELECT *, {_SYL} AS y, len(w)::DOUBLE AS n FROM t), z AS (SELECT *, coalesce(list_sum(y), 0)::DOUBLE AS sy, len(list_filter(y, lambda v: v >= 3))::DOUBLE AS cx FROM y)
 SELECT conv_id, turn, CAST(n AS INTEGER) AS n_words, CAST(s AS INTEGER) AS n_sentences, CAST(sy AS INTEGER) AS n_syllables, CAST(cx AS INTEGER) AS n_complex, round(CASE WHEN n > 0 THEN least(greatest(206.835 - 1.015 * n / s - 84.6 * sy / n, 0), 100) END, 5) AS flesch,
 round(CASE WHEN n > 0 THEN greatest(0.39 * n / s + 11.8 * sy / n - 15.59, 0) END, 5) AS fk_grade, round(CASE WHEN n > 0 THEN 0.4 * (n / s + 100 * cx / n) END, 5) AS fog, round(CASE WHEN n > 0 THEN greatest(4.71 * c / n + 0.5 * n / s - 21.43, 0) END, 5) AS ari,
 round(CASE WHEN n > 0 THEN greatest(5.88 * c / n - 29.6 * s / n - 15.8, 0) END, 5) AS coleman_liau, round(CASE WHEN n > 0 THEN len(list_distinct(w)) / n END, 5) AS ttr FROM z""")
def text_readability(spark, d):
    r = text.readability(read(spark, d, "conversations"), "text", ["conv_id", "turn"])
    return r.select(*(F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


def _map(table):
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in table.items()).replace("'n't'", "'n''t'") + "}"


_LEX = _map({**text.POSITIVE, **text.NEGATIVE})
_TURN = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.NEGATORS) + "]"
_SAID = "SELECT conv_id, turn, round(list_sum(list_concat([0.0::DOUBLE], v)), 6) AS score, CAST(len(v) AS INTEGER) AS n_sentiment, round(CASE WHEN len(w) > 0 THEN len(v) / len(w)::DOUBLE ELSE 0 END, 6) AS confidence FROM v"


def _spiced(spark, d):
    """The conversations, with some sentiment words put among their words: the invented prose has few."""
    spice = F.element_at(F.array(*map(F.lit, [" good", " not very bad", " so nice a fail", " without a love", " the", " really never sad", " slightly ugly"])), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)).cast("int") + 1)
    return read(spark, d, "conversations").withColumn("text", F.concat("text", spice))


_SPICED = "(SELECT conv_id, turn, text || [' good', ' not very bad', ' so nice a fail', ' without a love', ' the', ' really never sad', ' slightly ugly'][(conv_id + turn) % 7 + 1] AS text FROM conversations)"


@register("text_sentiment", f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM {_SPICED}),
 v AS (SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda i: {_LEX}[w[i]] * CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], {_TURN}) THEN -1 ELSE 1 END), lambda x: x IS NOT NULL) AS v FROM t) {_SAID}""")
def text_sentiment(spark, d):
    return text.sentiment(_spiced(spark, d), "text", ["conv_id", "turn"]).withColumns({c: F.round(c, 6) for c in ("score", "confidence")})


@register("text_rule_sentiment", f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM {_SPICED}),
 v AS (SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda i: {_LEX}[w[i]] * coalesce({_map({**text.INTENSIFIERS, **text.DIMINISHERS})}[CASE WHEN i > 1 THEN w[i - 1] END], {_map({**text.INTENSIFIERS, **text.DIMINISHERS})}[CASE WHEN i > 2 THEN w[i - 2] END], 1)), lambda x: x IS NOT NULL) AS v FROM t) {_SAID}""")
def text_rule_sentiment(spark, d):
    return text.rule_sentiment(_spiced(spark, d), "text", ["conv_id", "turn"]).withColumns({c: F.round(c, 6) for c in ("score", "confidence")})


@register("text_npmi", f"""WITH t AS (SELECT {_WORDS} AS w FROM documents), f AS (SELECT list_contains(w, 'the') AS a, list_contains(w, 'and') AS b, list_contains(w, 'idiot') AS c FROM t),
 n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c, count(*) FILTER (a AND b) AS ab, count(*) FILTER (a AND c) AS ac FROM f)
 SELECT 'the' AS a, 'and' AS b, round(CASE WHEN ab = 0 THEN -1 ELSE ln(ab * n / (n.a * n.b)) / -ln(ab / n) END, 6) AS npmi FROM n
 UNION ALL SELECT 'the', 'idiot', round(CASE WHEN ac = 0 THEN -1 ELSE ln(ac * n / (n.a * n.c)) / -ln(ac / n) END, 6) FROM n""")
def text_npmi(spark, d):
    return text.npmi_coherence(read(spark, d, "documents"), "doc_id", text.words("text"), [("the", "and"), ("the", "idiot")]).withColumn("npmi", F.round("npmi", 6))


@register("text_bigram_model", f"""WITH t AS (SELECT list_concat(['<s>'], list_concat({_WORDS}, ['</s>'])) AS t FROM benchmark), b AS (SELECT unnest(t[1:len(t) - 1]) AS a, unnest(t[2:len(t)]) AS b FROM t),
 g AS (SELECT a, b, count(*) AS n FROM b GROUP BY 1, 2), v AS (SELECT count(DISTINCT x) AS v FROM (SELECT unnest(t) AS x FROM t)) SELECT a, b, n, round((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY a) + v), 8) AS prob FROM g, v""")
def text_bigram_model(spark, d):
    return text.bigram_model(read(spark, d, "benchmark"), text.words("text")).withColumn("prob", F.round("prob", 8))


_SENT = r"""WITH s0 AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM benchmark),
 s AS (SELECT item_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM s0), t AS (SELECT item_id, pos, unnest(""" + _W.format("s") + ") AS t FROM s)"
_PICK = """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS r FROM sc)
 SELECT item_id, md5(string_agg(s, ' ' ORDER BY pos)) AS h FROM r JOIN s USING (item_id, pos) WHERE r <= 3 GROUP BY item_id"""
_VEC = """, tf AS (SELECT item_id, pos, t, count(*) AS tf FROM t GROUP BY 1, 2, 3), n AS (SELECT item_id, count(DISTINCT pos) AS n FROM tf GROUP BY 1), d AS (SELECT item_id, t, count(*) AS df FROM tf GROUP BY 1, 2),
 v0 AS (SELECT item_id, pos, t, tf * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN d USING (item_id, t) JOIN n USING (item_id)),
 v AS (SELECT item_id, pos, t, w / sqrt(sum(w * w) OVER (PARTITION BY item_id, pos)) AS w FROM v0)"""


@register("text_lead_summary", _SENT + """, c AS (SELECT item_id, t, count(*) AS c FROM t GROUP BY 1, 2), sc AS (SELECT item_id, pos, round(avg(c), 9) AS score FROM t JOIN c USING (item_id, t) GROUP BY 1, 2)""" + _PICK)
def text_lead_summary(spark, d):
    return text.lead_summary(read(spark, d, "benchmark"), "item_id", "text", 3).select("item_id", F.md5(F.col("summary").cast("binary")).alias("h"))


@register("text_centroid_summary", _SENT + _VEC + """, c AS (SELECT item_id, t, sum(w) AS c FROM v GROUP BY 1, 2), z AS (SELECT item_id, sqrt(sum(c * c)) AS z FROM c GROUP BY 1),
 sc AS (SELECT item_id, pos, round(sum(w * c) / any_value(z), 9) AS score FROM v JOIN c USING (item_id, t) JOIN z USING (item_id) GROUP BY 1, 2)""" + _PICK)
def text_centroid_summary(spark, d):
    return text.centroid_summary(read(spark, d, "benchmark"), "item_id", "text", 3).select("item_id", F.md5(F.col("summary").cast("binary")).alias("h"))


def _rank_sql(rounds: int) -> str:
    out = [""", sim AS (SELECT a.item_id, a.pos AS a, b.pos AS b, sum(a.w * b.w) AS w FROM v a JOIN v b ON a.item_id = b.item_id AND a.t = b.t AND a.pos <> b.pos GROUP BY 1, 2, 3), e AS (SELECT item_id, a, b, w / sum(w) OVER (PARTITION BY item_id, a) AS p FROM sim),
 n0 AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1), r0 AS (SELECT item_id, pos, 1.0::DOUBLE / n AS r FROM s JOIN n0 USING (item_id))"""]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS (SELECT x.item_id, x.pos, 0.15 / any_value(n) + 0.85 * coalesce(sum(e.p * y.r), 0) AS r FROM r{k - 1} x JOIN n0 ON n0.item_id = x.item_id LEFT JOIN e ON e.item_id = x.item_id AND e.b = x.pos LEFT JOIN r{k - 1} y ON y.item_id = x.item_id AND y.pos = e.a GROUP BY 1, 2)")
    return _SENT + _VEC + ", ".join(out) + f", sc AS (SELECT item_id, pos, round(r, 9) AS score FROM r{rounds})" + _PICK


@register("text_textrank_summary", _rank_sql(4))
def text_textrank_summary(spark, d):
    return text.textrank_summary(read(spark, d, "benchmark"), "item_id", "text", 3, rounds=4).select("item_id", F.md5(F.col("summary").cast("binary")).alias("h"))


@register("text_keywords", f"""WITH e AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM e GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
 v AS (SELECT item_id, term, round(tf * ln(n::DOUBLE / df), 8) AS weight FROM tf JOIN df USING (term), n) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, term) AS INTEGER) AS rank, term, weight FROM v QUALIFY rank <= 5""")
def text_keywords(spark, d):
    return text.keywords(read(spark, d, "benchmark"), "item_id", text.words("text"), 5)


@register("text_max_features", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def text_max_features(spark, d):
    return text.most_frequent_terms(read(spark, d, "documents"), "doc_id", text.words("text"), 100)


_TRI = "list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])"


@register("text_language_profiles", f"""WITH g AS (SELECT lang, unnest({_TRI}) AS gram FROM (SELECT lang, string_split(lower(text), '') AS c FROM documents) WHERE len(c) >= 3), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2),
 p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank FROM c QUALIFY rank < 300),
 o0 AS (SELECT conv_id * 1000 + turn AS id, unnest({_TRI}) AS gram FROM (SELECT conv_id, turn, string_split(lower(text), '') AS c FROM conversations) WHERE len(c) >= 3), o1 AS (SELECT id, gram, count(*) AS n FROM o0 GROUP BY 1, 2),
 o AS (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY n DESC, gram) - 1 AS r FROM o1 QUALIFY r < 300), m AS (SELECT id, count(*) AS m FROM o GROUP BY 1),
 x AS (SELECT id, lang, sum(abs(r - rank) - 300) AS less FROM o JOIN p USING (gram) GROUP BY 1, 2), l AS (SELECT DISTINCT lang FROM p),
 d AS (SELECT id, l.lang, CAST(m * 300 + coalesce(less, 0) AS BIGINT) AS distance FROM m CROSS JOIN l LEFT JOIN x USING (id, lang))
 SELECT id, lang, distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, lang) = 1""")
def text_language_profiles(spark, d):
    p = text.language_profiles(read(spark, d, "documents"), "lang", "text")
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return text.detect_language(c, "id", "text", p)


@register("text_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS d, round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 8) AS ratio FROM part")
def text_levenshtein(spark, d):
    return read(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"), F.round(scalar.levenshtein_ratio("p_name", "p_type"), 8).alias("ratio"))


@register("text_jaro_winkler", "SELECT p_partkey, round(jaro_similarity(p_name, p_type), 8) AS jaro FROM part")
def text_jaro_winkler(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(text.jaro("p_name", "p_type"), 8).alias("jaro"))


@register("text_damerau", "SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS DOUBLE) AS plain, CAST(damerau_levenshtein(p_brand, reverse(p_brand)) AS DOUBLE) AS swapped FROM part")
def text_damerau(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", text.weighted_levenshtein("p_name", "p_brand").alias("plain"), text.weighted_damerau(F.col("p_brand"), F.reverse("p_brand")).alias("swapped"))


_TOPICS = f"WITH e AS (SELECT lang, unnest({_WORDS}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT lang, w FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 30)"


@register("text_topics", _TOPICS + """, k AS (SELECT x.lang AS a, y.lang AS b, count(*) AS k FROM t x JOIN t y ON x.w = y.w AND x.lang < y.lang GROUP BY 1, 2)
 SELECT a, b, round(1 - k / (60.0::DOUBLE - k), 8) AS distance FROM k UNION ALL SELECT 'all', 'all', round(count(DISTINCT w) / count(*)::DOUBLE, 8) FROM t""")
def text_topics(spark, d):
    from pyspark.sql import Window

    c = read(spark, d, "documents").select("lang", F.explode(text.words("text")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where("r <= 30")
    topics = top.groupBy("lang").agg(F.collect_list("w").alias("words"))  # 30 words each
    far = text.topic_distances(topics, "lang", "words").withColumn("distance", F.round("distance", 8))
    return far.unionByName(text.topic_diversity(topics, "lang", "words").select(F.lit("all").alias("a"), F.lit("all").alias("b"), F.round("diversity", 8).alias("distance")))


@register("text_jaccard_turns", f"""WITH w AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS w FROM conversations)
 SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 8) AS jaccard FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def text_jaccard_turns(spark, d):
    w = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(text.words("text")).alias("w"))
    b = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(scalar.jaccard("w", "v"), 8).alias("jaccard"))
