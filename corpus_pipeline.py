"""From raw documents to packed training sequences, each stage on all its predecessor kept.

Quality rules drop documents, the n-gram join leaves one document of each group of near copies, decontamination drops documents with benchmark
passages, the secret scan masks what it reports, packing places every document's tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from buylens.llm import decontamination, jaccard, packing, quality, secrets
from buylens.llm.shared import prepared, stored

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word counts and the compression bands accept."""
    prepared(spark)
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that five-word shingles link at a similarity of 0.8 or more."""
    prepared(spark)
    return jaccard.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.cleaned(docs, prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    prepared(spark)
    return secrets.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where its ids lie, and their checksum."""
    prepared(spark)
    return packing.with_crc(packing.packed(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_decontamination),
          ("secret scans", secret_scan), ("best-fit packing", sequence_packing)]

#: Compression, tokenization and packing have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
