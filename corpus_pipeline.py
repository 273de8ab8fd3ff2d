"""A training-data pipeline of five stages over the table of documents.

Every stage works on all that its predecessor kept. The first four return the columns of documents; the last one returns
one row for each document of the mix, with its token ids as digests.

Defined results: a null or empty text fails the first stage, as it has too few words; rows without an id pass through (no
stage removes a row for want of one) and rows that share an id are treated as one document; very long texts are taken
whole; of equal texts the one of least id stays; an empty table gives an empty result; other columns are carried to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, lines, mixing, neardup, quality
from quillspark.llm.runtime import Scratch, table, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    tune(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are near-copies of an earlier one."""
    tune(spark)
    return lines.dedup_lines(docs, Scratch(spark, "pipeline-lines"), report=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    tune(spark)
    return neardup.keep_one(docs, Scratch(spark, "pipeline-documents")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    tune(spark)
    return mixing.mix(docs, Scratch(spark, "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as their number and digest, and the digest of the decoded text."""
    tune(spark)
    return bpe.digest(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can't express near-duplicates by signatures, nor the encoder; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
