"""From raw documents to token ids: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, mixing, ngram_join, quality, sentence_pieces
from barloom.llm.common import settle
from barloom.llm.queries import BLOCK_CHARS, OTHER_WEIGHT, WEIGHTS, documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ranking = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.drop_rejected(docs, ranking)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar five-word shingle sets (0.8 or more) connect, the one with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return mixing.mixed(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its place in the mix; rows in order of ``place`` are the mix."""
    return sentence_pieces.encode(docs, sentence_pieces.load(sentence_pieces.MODEL), place=mixing.place(docs))


STAGES = [
    ("quality_ranking", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("source_mixing", mixing_stage),
    ("sentence_pieces", encoding_stage),
]

# The learned classifier and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
