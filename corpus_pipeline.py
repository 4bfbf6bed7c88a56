"""The corpus pipeline: five stages from raw documents to encoded training data.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, and
returns a DataFrame that is written as Parquet and read again as the next one's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywort.llm import common, linededup, mixing, ngramjoin, pieces, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.judged(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a document of smaller doc_id holds too."""
    return linededup.deduplicated(docs).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group linked by word 5-gram sets of similarity 0.8 or more."""
    return ngramjoin.representatives(docs, k=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or stretches of them, as often as their sources' quotas take them."""
    return mixing.applied(docs, block_words=BLOCK_WORDS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them."""
    return pieces.encoded(docs).drop("text")


#: Words of the blocks that the mix deals, large enough for coherent stretches.
BLOCK_WORDS = 64

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: No stage but the line dedup has a form in SQL; tests compare the rows of run() with the five stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
