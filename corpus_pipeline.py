"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing, encoding.

Every stage works on all that its predecessor kept. ``STAGES`` are functions of (spark, docs, sf_dir); all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and reads them
back for the next, so a lost executor costs no more than the tasks at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe_transducer, common, mixing, pretokens, quality, shingle_sets, simhash, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words of a shingle.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go; the rest stays as it is."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard 0.8 or more on ``SHINGLE`` words) the document with the smallest id stays."""
    common.ship(spark)
    return simhash.keep_one(docs, shingle_sets.near_duplicates(docs, SHINGLE))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages seen earlier go, and with them characters that lose a byte; no document goes."""
    common.ship(spark)
    left = suffix_dedup.as_text(suffix_dedup.dedup(docs, carry=("lang", "source")))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mix(docs)
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    common.ship(spark)
    path = pretokens.tokenizer_path("byte_bpe_50k.tiktoken")
    done = bpe_transducer.round_trip(docs.select("doc_id", "source", "text"), path)
    return done.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]
#: The fingerprints, the suffix sort and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
