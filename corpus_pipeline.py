"""A corpus pipeline: tell the language, keep good text, drop near-duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillage.llm import langid, mixing, quality, simhash, spiece
from tillage.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' rows whose language is told with a probability of 0.3 or more.

    Rows with a null text or one without a letter go, as do all rows where none has a language to learn from. Repeated
    rows stay or go together, columns stay as they are, and an empty table gives no rows.
    """
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' rows whose quality score reaches 0.3, the threshold of op2.

    A null text is scored like an empty one, a doc_id without a label like any other. Without labels of both classes
    every row has the same score. Repeated rows stay or go together, columns stay as they are, and an empty table gives no rows.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Candidates meet in an index over the positions of fingerprint bytes and are verified on their texts. Texts without a
    word, null ones too, are copies of each other. Rows that repeat a doc_id become one; rows without a doc_id all stay.
    Columns stay as they are, and an empty table gives no rows.
    """
    return simhash.near_keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once for each copy, dealt to shards and shuffled within them.

    A null source is a source, a null text has no words, rows of a source that repeat a doc_id are taken together.
    Columns stay as they are, and an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids and round_trip of each row of the mix.

    A null or empty text has no ids. Repeated rows give equal rows, further columns are left out, and an empty table gives no rows.
    """
    return spiece.encode_and_check(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_encode", sentencepiece_encode),
]

#: The classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
