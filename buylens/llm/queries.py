"""Registered queries of the subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html, jaccard, lexical, negatives, packing, pii, quality, rans, scoring, secrets, urls
from .shared import prepared


TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic; background: all. Every word of the corpus is a token of its own."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    losses = ("target_loss", "background_loss", "score")
    return scoring.scored(_table(spark, sf_dir, "documents"), good).select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in losses])


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(_table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                       "ratio", "chunk_min", "chunk_max")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1))


#: (verdict, host, path): a listed rule comes before any mined one, the longest first.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels belong to the page of the same number: bad if of low quality or toxic."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
    return urls.judged(pages, labelled, URL_RULES)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_lm_scoring, op3_ngram_jaccard, op4_chat_rotation, op5_quality_rules, op6_html_extraction, op7_rans, op8_packing,
        op9_url_rules, op10_secrets, op11_lexical_search, op12_pii, op13_hard_negatives)}
