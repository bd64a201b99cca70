"""From raw documents to packed sequences: the stages of the corpus pipeline, in order.

Every stage works on all rows that the stage before kept, and passes on all columns of the rows
it keeps.  Null and empty texts leave with the first stage, as they have no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tacit.llm import langid, near_dup, packing, quality
from tacit.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on the labelled rows of docs."""
    return langid.keep(docs, langid.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, tokenizer, end_id=1, added=True)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]
# A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
