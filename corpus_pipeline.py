"""A training-data pipeline over ``documents`` in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last keep the columns of documents:

1. language ID: documents without a letter or in no learned language go (without a labelled
   training document none is learned, and only those without a letter go);
2. MinHash near-dedup: of each group of near-duplicates the smallest doc_id stays;
3. temperature mixing: every document stays, those of small sources may come twice;
4. best-two-fit packing: pieces of at most 2048 tokens and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import language_id, mixing, near_dup, packing
from strandloom.llm._shared import stored


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without a learned language only null texts and texts without a letter are rejected."""
    return language_id.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("temperature_mixing", mix_sources),
    ("best_two_fit_packing", pack_sequences),
]

#: Trained models, MinHash and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
