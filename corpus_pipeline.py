"""Corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Quality rules drop the documents that they reject; of each group of near copies (word 5-grams, Jaccard 0.75 or
more) the document of the smallest id stays; secrets in the text are replaced by a mark; what remains is packed into
sequences.  Documents without words have no near copies, but the quality rules drop them.

Defined cases: a null text fails the quality rules; null languages and sources are groups of their own; null ids are kept, and are a
group's smallest only where all of its ids are null; of equal ids the smallest digest of the text stays, of repeated rows
one; an empty table gives no rows; texts of any length go whole; extra columns of documents pass through all stages but the
last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.llm import jaccard, packing, quality, secrets
from skyloom.sources.staging import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("secret scans", redact_secrets), ("best-fit packing", pack_sequences)]

#: The estimate, tokens, near copies and packing have no SQL; ``run`` is tested against brute force stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
