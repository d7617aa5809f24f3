"""Ingestion steps over tables of documents: line frequencies, incremental loads, fan-out of articles, versions of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .catalogue import lacking


def without_repeating_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shorter: int = 50, blank_too: bool = False) -> DataFrame:
    """(id, text) without lines that, trimmed, are shorter than so many characters and occur so often in their document."""
    d = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line")).withColumn("_l", trimmed(F.col("line")))
    n = F.count("*").over(Window.partitionBy(id_col, "_l"))
    drop = (n >= least) & (F.length("_l") < shorter) & (F.lit(blank_too) | (F.col("_l") != ""))
    d = d.withColumn("_keep", ~drop).groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("pos", "line")))).alias("_a"))
    return d.select(id_col, F.array_join(F.transform("_a", lambda x: x["line"]), "\n").alias(text_col))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("line")).select(id_col, trimmed(F.col("line")).alias("line")).groupBy(id_col, "line").count()


def to_load(new: DataFrame, had: DataFrame, key: list[str], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows to load, and rows that stay: without force what exists is skipped, with it it is replaced."""
    return (new, lacking(had, new.select(*key), key)) if force else (lacking(new, had.select(*key), key), had)


def documents_of(articles: DataFrame) -> DataFrame:
    """One row a section of articles (title, content, sections of title and content); an article without sections is its own."""
    own = F.array(F.struct("title", "content"))
    parts = F.when(F.size(F.coalesce("sections", F.array().cast(articles.schema["sections"].dataType))) > 0, F.col("sections")).otherwise(own)
    return articles.select(F.col("title").alias("article"), F.posexplode(parts).alias("sort_order", "s")).select("article", "sort_order", "s.title", "s.content")


def reindexed(index: DataFrame, changed: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """The index with all rows of changed documents replaced by their new chunks; siblings stay."""
    return lacking(index, changed.select(*key).distinct(), key).unionByName(chunks)


def concatenated(docs: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """Texts of a group in order, with blank lines between."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return docs.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x[text]), "\n\n").alias(text))


def planned(articles: DataFrame) -> DataFrame:
    """What a load of articles would write (articles, documents), without writing it."""
    n = F.greatest(F.size(F.coalesce("sections", F.array().cast(articles.schema["sections"].dataType))), F.lit(1))
    return articles.agg(F.count("*").alias("articles"), F.coalesce(F.sum(n), F.lit(0)).alias("documents"))


def uploaded(files: DataFrame, name: str = "name", text: str = "text", longest: int = 200) -> DataFrame:
    """Uploaded files as drafts: the title is the name, cut; files of other formats, or empty ones, carry their error."""
    from ..sources.routes import routed

    return routed(files, name, text).select(F.substring(name, 1, longest).alias("title"), F.when(F.col("error").isNull(), F.col(text)).alias("content"), F.lit("draft").alias("status"), "format", "error")
