"""A training-corpus pipeline over documents: classify, deduplicate, mix, pack.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netloom.llm import exact_dedup, jaccard_join, mixing, packing, quality_classifier
from netloom.llm.common import Scratch, table, written


#: Columns that stages read; all others are carried under names that no operator uses.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _carried(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """operator(docs) with the columns of docs, whatever these are called."""
    names = [c if c in READ else f"__column_{i}" for i, c in enumerate(docs.columns)]
    return operator(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null or empty text is a text without words; null sources and
    languages are sites of their own; repeated rows stay or go together; an empty table gives an empty one; other columns are
    carried through, whatever their names."""
    return _carried(lambda x: quality_classifier.classified(x, table(spark, sf_dir, "labels")).filter("kept"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id. A null text is the empty text; a null doc_id stays only where all of
    its group are null; of rows repeated with doc_id and text the least stays; empty tables and other columns as before."""
    return _carried(lambda x: exact_dedup.exact_dedup(x, keep="largest"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at similarity 0.8 over five-word shingles, that of the least doc_id (a null one only
    where all are null). Rows without words all stay; empty tables and other columns as before."""
    return _carried(jaccard_join.jaccard_dedup, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix draws: one for each epoch, the last of a source up to its exact cut, whose n_chars follows its
    text. Rows without words are not drawn; a null source is the last source; empty tables and other columns as before."""
    return _carried(lambda x: mixing.drawn(mixing.mixed(x)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences and offsets. A null text is empty: one piece, its end token;
    repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: A fitted classifier and a tokenizer stand in it, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.written(stage(spark, docs, sf_dir), f"stage{i}")
            scratch.drop(f"stage{i - 1}")
        return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
