"""From raw documents to packed training sequences, in five stages.

Each stage works on everything its predecessor kept. All but the last return the
columns of ``documents``; the last returns the packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaica.llm import langid, mixing, packing, simhash, substring_dedup
from mosaica.llm.common import materialize_table, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter, or a score under one half) go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near duplicates the document of smallest id stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words that stand anywhere else too are cut out; documents that held nothing else go."""
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come up to three times."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, none across documents."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL states the trained language model and XXH64; tests/llm/test_pipeline.py holds each stage and the whole against brute force.
ORACLE_SQL = None
