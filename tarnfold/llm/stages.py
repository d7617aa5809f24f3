"""Operators as steps of a corpus pipeline: documents in, documents out, other columns kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .decontam import overlaps
from .ngram_join import near_duplicates
from .sp_codec import digests
from .suffix_dedup import without_repeats
from .toxicity import learned, rejected, score, with_thresholds


def without_toxic(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """Documents that score below their language's threshold.

    Null and empty texts are scored as texts without words; a language without a threshold, or null, has the general
    one. Repeated rows, other columns of any names and an empty table come back as they were.
    """
    ship(docs.sparkSession)
    m = with_thresholds(learned(docs, labels, usable), docs, labels, usable)
    return score(docs, m, "__toxic").where(~rejected(m, "__toxic")).drop("__toxic")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of documents that near-duplicate links connect, that with the least doc_id.

    Rows that share a doc_id but not the text stay together, if either stays; of rows that share both one stays. Null and
    empty texts are linked with nothing and stay, as do null doc_ids that no smaller doc_id is linked with. Columns
    of any names, and empty tables, come back with the schema they had.
    """
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("__rows"))
    kept = stored(kept, "kept").withColumnRenamed("doc_id", "__kept_id")
    met = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")))
    # few ids have more than one row: only those rows are compared
    return met.where("__rows = 1").select(docs.columns).unionByName(met.where("__rows > 1").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def without_repeated_strings(docs: DataFrame) -> DataFrame:
    """Texts without bytes of long strings that start earlier elsewhere; n_chars is counted anew where there is such a column.

    No row goes. A null text stays null, an empty or short one as it was; rows that repeat a doc_id are the same place (see
    without_repeats); other columns of any names and an empty table come back as they were.
    """
    rest = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # whatever their names
    d = docs.withColumnsRenamed(rest).withColumn("__null", F.col("text").isNull())
    out = without_repeats(d, with_text=True, keep=[*rest.values(), "__null"])
    text = F.when(~F.col("__null"), F.col("kept_text"))
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text} | {c: F.col(x) for c, x in rest.items()}
    if "n_chars" in rest:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) for c in docs.columns])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Documents that overlap with no benchmark item in least tokens or more; by default every overlap counts, be the item a single word.

    Null and empty texts overlap with nothing and stay; every row of a doc_id goes if one of its texts overlaps. Repeated
    rows, other columns and empty tables of either kind come back as they were.
    """
    leaks = stored(overlaps(docs, benchmark).where(F.col("agreeing") >= least).select(F.col("doc_id").alias("__leak_id")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__leak_id")), "left_anti")


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of each text's pieces and of what they decode to, one row a row; null and empty texts have no pieces."""
    return digests(docs)
