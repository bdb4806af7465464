"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; a run writes each result as
Parquet and reads it again as the next stage's documents. All but the last return the columns of
documents as they came, further ones of any name included.

Null texts count as empty: the quality rules reject them, and no later stage meets one in a run. Taken
for itself, a later stage leaves a null text null, and the last gives it no ids. Repeated rows are judged
alike; near-dedup leaves one of them. Rows with a null id are judged like any other. Empty tables give
empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, line_dedup, mixing, quality_rules, simhash
from wakeline.llm.queries import vocabulary
from wakeline.session import ensure_checkpoint_dir, table

#: SimHash and token ids have no counterpart in SQL; tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one; texts and their lengths change."""
    return line_dedup.keep_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, by operator 6's own rule of four words and four bits: the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and lengths meet their target weights."""
    return mixing.sample_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    keys = {c: F.col(c) for c in ("doc_id", "lang", "source", "n_chars")}
    rows = bpe.encode_decode(docs, vocabulary(), keys, F.col("text"))
    return rows.select(*keys, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("mixture", mixture),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
