"""A training-corpus pipeline over documents: five stages of the corpus operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightwell.llm import decontaminate, exact_dedup, quality, sentencepieces, simhash
from brightwell.llm.common import drop_path, scratch, table, temporary
from brightwell.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the classifier accepts go on. It is fitted on labelled documents among docs."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: that with the largest doc_id."""
    return exact_dedup.unique(docs, keep="max")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 0.8 of their five-word shingles alike stays: that with the smallest doc_id."""
    return simhash.unique(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of what is left."""
    return sentencepieces.tokens(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL cannot train the dictionaries of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again for the next, and what a stage made on its way is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{path}/table")
        docs = spark.read.schema(out.schema).parquet(f"{path}/table")
        if before:
            drop_path(spark, before)
        before = path
    return docs
