"""Corpus pipeline: documents to token ids in five stages, each written and read again before the next.

Rows whose doc_id is null pass the join stage unclassed; rows that repeat a doc_id are judged each by their
own text, and rows equal in both share their fate. Null and empty texts fail the first stage and stay null or
empty in the others. Empty tables give empty results; extra columns go. No stage has a prefix, cap or sample other than the draw of the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, ngram_join, pii, quality_rules
from lectern.llm.common import drop_spooled, spool

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of dropped copies are broadcast up to this many rows; beyond, Spark joins by shuffle.
MOST_BROADCAST = 1_000_000


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    # counted once, beside the texts; learning reads the counts alone
    stats = spool(quality_rules.statistics(docs, list(COLUMNS)), "stage-stats")
    rules = quality_rules.learn(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return stats.where(~quality_rules.base_failed() & quality_rules.verdict(rules).isNull()).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class at five words and a similarity of 0.8."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("_mark"))
    classed = ngram_join.jaccard_components(docs, words=5, percent=80, mark="_mark")
    lost = spool(classed.where("component_id <> doc_id").select("doc_id", F.col("mark").alias("_mark")).distinct(), "stage-copies")
    drop_spooled(spark, classed)
    lost = F.broadcast(lost) if lost.count() <= MOST_BROADCAST else lost
    return docs.join(lost, ["doc_id", "_mark"], "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows."""
    found = pii.find_spans(docs, list(COLUMNS))
    text = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to tempered source, language and topic shares.

    Shares are tempered less than in the query of the operator (0.9 against 0.7): the stage is to even out the
    sources while most of what the stages before kept stays in the corpus.
    """
    return mixing.calibrated(docs.select(*COLUMNS), temper=0.9).where("_kept").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids."""
    out = bpe.encode(docs, bpe.vocabulary_path(), keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", reject_poor),
    ("ngram_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Learned rules and hashed draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spool(out, f"pipeline-{name}")
        drop_spooled(spark, out)
    return docs
