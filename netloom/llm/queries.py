"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import chat, exact_dedup, html_text, jaccard_join, mixing, packing, quality_classifier, quality_rules, secret_scan, token_count
from netloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    early = F.xxhash64("doc_id") < 0  # two deliveries, together the whole table
    return secret_scan.by_path(docs, secret_scan.delivered([docs.filter(early), docs.filter(~early)]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.examples(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_classifier.classified(docs, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "low", "toxic", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.with_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_html_extraction, op3_secret_scan, op4_mixing, op5_chat, op6_quality_classifier, op7_exact_dedup, op8_jaccard_join, op9_token_counts, op10_quality_rules)}
ORACLE_SQL: dict[str, str] = {"op3_secret_scan": secret_scan.SQL, "op4_mixing": mixing.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_jaccard_join": jaccard_join.SQL}
