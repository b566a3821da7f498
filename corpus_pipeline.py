"""From documents to training tokens: five stages, each on all that the one before it kept.

1. toxicity: documents that the network scores 0.7 or more go.
2. near duplicates: of each group that the n-gram Jaccard join links (five
   words, 0.8), the document with the least id stays.
3. substring dedup: words of repeated 20-word windows go; a document without
   words left goes.
4. mixing: documents stay with their fitted rate (at most 1), so that the
   expected tokens of the quality domains approach the target weights.
5. SentencePiece: the ids of every document.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base, jaccard, mixing, piecefst, substring, toxicity
from quarry.llm.crf import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Target shares of the quality domains.
WEIGHTS = {1: 0.99, 0: 0.01}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from labelled documents outside the held-out fold, drop what scores at least the cut; null texts stay."""
    net = toxicity.fit(docs, base.table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs.select(*COLUMNS), net).where(F.col("_toxicity") < toxicity.CUT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard.keep_first(docs.select(*COLUMNS), 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; n_chars follows the text."""
    cut = substring.remove_repeats(docs.select(*COLUMNS), 20)
    cut = cut.where("_n_removed = 0 OR _n_removed < _n_words")
    return cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by the rates that bring the quality domains to their weights; no document is repeated."""
    mixed = mixing.mix(docs.select(*COLUMNS), base.table(spark, sf_dir, "labels"), "quality", WEIGHTS, most=1.0)
    return mixing.drawn(mixed).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document."""
    ids = piecefst.encode(docs, keep=("doc_id", "lang", "source"))
    return ids.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", cut_repeats), ("mixing", mix_quality), ("sentencepiece", encode)]
#: The trained stages have no SQL equivalent; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = base.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
