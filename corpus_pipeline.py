"""The corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
back as the next one's ``docs``.  All but the last return the columns of ``docs``, extra ones
too, whatever their names.

Defined results: a document without a text, or without a letter, goes at the first stage; a text
that loses all its lines stays, empty, and is a near duplicate of other empty ones; of repeated
rows one stays; rows without an id come first where repeated lines stay, and stay themselves only
if no near duplicate has an id; ties go to the smallest id; texts of any length are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm.common import materialize, table
from vellumspark.llm.decontam import drop_contaminated
from vellumspark.llm.language import keep_identified
from vellumspark.llm.lines import dedup_lines
from vellumspark.llm.pieces import encode_documents
from vellumspark.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or with mixed evidence go."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of several lines that occurred before."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word Jaccard of 0.8 or more)."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, text, piece ids (little-endian unsigned 32-bit) and the text that they decode to."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has neither the trained language model nor the piece vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
