"""Chunks of Markdown by its headings: paths from windows, packing and merging as folds within one document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import without_heading_marks
from ..functions.text import heading_level, heading_title, trimmed


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, level, path, leaf, body) for every heading; text before the first one belongs to none.

    A heading's path holds the titles of the headings that enclose it. It is a leaf if the next one is not deeper.
    """
    d = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    d = d.withColumn("level", heading_level(F.col("line"))).withColumn("title", heading_title(F.col("line")))
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(upto) for k in range(1, 7)]
    d = d.withColumn("section", F.count(F.when(F.col("level") > 0, 1)).over(upto)).select("*", *[c.alias(f"h{k}") for k, c in enumerate(last, 1)])
    heads = d.where("level > 0")
    titles, above = [], F.lit(-1)
    for k in range(1, 7):
        at = F.coalesce(F.col(f"h{k}.pos"), F.lit(-1))
        titles.append(F.when((at > above) & (F.lit(k) <= F.col("level")), F.col(f"h{k}.title")))
        above = F.greatest(above, at)
    order = Window.partitionBy(id_col).orderBy("pos")
    heads = heads.select(id_col, "section", "level", F.array_join(F.array(*titles), " > ").alias("path"), (F.coalesce(F.lead("level").over(order), F.lit(0)) <= F.col("level")).alias("leaf"))
    body = d.where("section > 0 and level = 0").groupBy(id_col, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return heads.join(body, [id_col, "section"], "left").withColumn("body", without_heading_marks(F.coalesce("body", F.lit(""))))


def packed_paragraphs(body: Column, most: int) -> Column:
    """Paragraphs, parted by two line feeds, joined while a chunk, with its trailing blank line, stays under most; a longer one is kept whole."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n\n"), trimmed), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    close = lambda a: F.when(trimmed(a["buf"]) != "", F.concat(a["done"], F.array(trimmed(a["buf"])))).otherwise(a["done"])
    step = lambda a, p: F.when((a["buf"] == "") | (F.length(a["buf"]) + F.length(p) < most), F.struct(a["done"].alias("done"), F.concat(a["buf"], p, F.lit("\n\n")).alias("buf"))).otherwise(F.struct(close(a).alias("done"), F.concat(p, F.lit("\n\n")).alias("buf")))
    return F.aggregate(paragraphs, start, step, close)


def merged_short(chunks: Column, least: int) -> Column:
    """Chunks (path, text) in order: one that is shorter than least takes in the next; the later path that isn't empty stays."""
    kind = "array<struct<path:string,text:string>>"
    start = F.array().cast(kind)

    def step(a: Column, c: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.struct(F.when(c["path"] != "", c["path"]).otherwise(last["path"]).alias("path"), F.concat(last["text"], F.lit("\n\n"), c["text"]).alias("text"))
        return F.when((F.size(a) > 0) & (F.length(last["text"]) < least), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(F.struct(c["path"].alias("path"), c["text"].alias("text")))))

    return F.aggregate(chunks, start, step)


def structural_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 300, most: int = 800) -> DataFrame:
    """(id, chunk_index, path, text) from leaf sections, of which those longer than most are packed by paragraphs, and short chunks merged.

    A document without headings falls back to its paragraphs, packed but not merged.
    """
    found = sections(docs, id_col, text_col).where(F.col("leaf") & (F.col("body") != ""))
    pieces = found.select(id_col, "section", "path", F.posexplode(F.when(F.length("body") > most, packed_paragraphs(F.col("body"), most)).otherwise(F.array("body"))).alias("part", "piece"))
    plain = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).where(~F.exists(F.split("_t", "\n"), lambda line: heading_level(line) > 0))
    plain = plain.select(id_col, F.posexplode(packed_paragraphs(F.col("_t"), most)).alias("chunk_index", "text")).withColumn("path", F.lit(""))
    ordered = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("section", "part", "path", F.col("piece").alias("text")))).alias("_c"))
    merged = ordered.select(id_col, merged_short(F.transform("_c", lambda c: F.struct(c["path"].alias("path"), c["text"].alias("text"))), least).alias("_m"))
    return merged.select(id_col, F.posexplode("_m").alias("chunk_index", "_x")).select(id_col, "chunk_index", "_x.path", "_x.text").unionByName(plain)
