"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import stages
from tarnfold.llm.common import stored, table


#: Agreeing tokens from which an overlap rejects a document; 1: every overlap that the operator finds.
LEAST_AGREEING = 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach their language's threshold go.

    Labels are learned from the rows whose crc32(doc_id as text) mod 3 is not 1, as in the query of the operator.
    """
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    return stages.without_toxic(docs, table(spark, sf_dir, "labels"), usable)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.75: of each component the least doc_id stays."""
    return stages.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 that start earlier are cut out; every document stays, with what is left of it."""
    return stages.without_repeated_strings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item in LEAST_AGREEING tokens or more go."""
    return stages.without_benchmark(docs, table(spark, sf_dir, "benchmark"), LEAST_AGREEING)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the pieces, their source spans and what they decode to."""
    return stages.encoded(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL can express neither the classifier nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What each makes of nulls, empty, long and repeated rows, clashing columns and
    empty tables is said in llm/stages.py; none fails on them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
