"""The index of documents as one plan with versions: clean, chunk, embed, replace by (material, document); caches know versions.

Everything is added, nothing changed in place: a load writes the chunks of changed documents, then vectors of texts not
embedded yet, and last the log rows that make them count. A load that breaks off leaves files of a version that no log row
names; the next load writes over them. Readers take, of each document, the chunks of its newest log row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_markdown, fixed_chunks
from ..shipping import ship
from ..storage import exists, kept_at
from .catalogue import lacking, newest
from .chunking import structural_chunks

DOCUMENT = ["material_id", "doc_id"]
Chunker = Callable[[DataFrame], DataFrame]


def by_structure(docs: DataFrame) -> DataFrame:
    """(material_id, doc_id, chunk_index, path, text) by headings, or by paragraphs where there are none."""
    chunks = structural_chunks(docs.select(F.struct(*DOCUMENT).alias("_d"), "text"), "_d", "text")
    return chunks.select(*[f"_d.{c}" for c in DOCUMENT], "chunk_index", "path", "text")


def by_size(docs: DataFrame) -> DataFrame:
    """The same by windows of fixed size."""
    d = docs.select(*DOCUMENT, F.posexplode(fixed_chunks(F.col("text"))).alias("chunk_index", "text"))
    return d.select(*DOCUMENT, "chunk_index", F.lit("").alias("path"), "text")


class DocumentIndex:
    """An index at a path: log/version=n, chunks/version=n and vectors/version=n, each written once by the load that made n."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, columns: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self._table("log", "material_id string, doc_id long, digest string, deleted boolean, version int")

    def documents(self) -> DataFrame:
        """(material_id, doc_id, digest, deleted, version) as each document's newest log row has it."""
        newest_row = F.max_by(F.struct("digest", "deleted", "version"), "version").alias("r")
        return self.log().groupBy(*DOCUMENT).agg(newest_row).select(*DOCUMENT, "r.*")

    def chunks(self) -> DataFrame:
        """(material_id, doc_id, version, chunk_index, path, text, key) of all documents as they are now."""
        written = self._table("chunks", "material_id string, doc_id long, chunk_index int, path string, text string, key string, version int")
        return written.join(self.documents().where("not deleted").select(*DOCUMENT, "version"), [*DOCUMENT, "version"])

    def vectors(self) -> DataFrame:
        return self._table("vectors", "key string, embedding array<double>, version int").select("key", "embedding")

    def rows(self) -> DataFrame:
        """What a search takes: (chunk_id, material_id, doc_id, text, embedding)."""
        d = self.chunks().join(self.vectors(), "key", "left")
        return d.select(F.xxhash64(*DOCUMENT, "chunk_index").alias("chunk_id"), *DOCUMENT, "path", "text", "embedding")

    def material_versions(self) -> DataFrame:
        """(material_id, index_version): the last load that changed a material, by which its cache entries are held to be valid."""
        return self.log().groupBy("material_id").agg(F.max("version").alias("index_version"))

    def load(self, docs: DataFrame, gone: DataFrame | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, chunker: Chunker = by_structure, force: bool = False, clean: Callable[[Column], Column] = clean_markdown, batch: int = 64) -> int:
        """Take in docs (material_id, doc_id, text) and leave out those of gone (material_id, doc_id); the version that holds afterwards.

        Documents whose clean text is the one they have are passed over, unless forced; others of their material stay as they
        are. Without any change there is no new version. A null text is an empty one; of rows with one
        key the one with the least digest counts. embed is given texts in batches, each different text once ever.
        """
        ship(self.spark)
        last = self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        version, had = last + 1, self.documents()
        d = docs.select(F.col("material_id").cast("string").alias("material_id"), F.col("doc_id").cast("long").alias("doc_id"), clean(F.coalesce("text", F.lit(""))).alias("text"))
        d = d.withColumn("digest", F.md5("text")).groupBy(*DOCUMENT).agg(F.min_by("text", "digest").alias("text"), F.min("digest").alias("digest"))
        same = had.where("not deleted").select(*DOCUMENT, "digest")
        changed = kept_at(d if force else lacking(d, same, [*DOCUMENT, "digest"]), f"{self.path}/changed")
        rows = changed.select(*DOCUMENT, "digest", F.lit(False).alias("deleted"))
        if gone is not None:
            out = gone.select(F.col("material_id").cast("string").alias("material_id"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
            out = lacking(had.where("not deleted").join(out, DOCUMENT, "left_semi"), changed.select(*DOCUMENT), DOCUMENT)
            rows = rows.unionByName(out.select(*DOCUMENT, "digest", F.lit(True).alias("deleted")))
        if rows.isEmpty():
            return last
        chunks = kept_at(chunker(changed).withColumn("key", F.md5("text")).withColumn("chunk_index", F.col("chunk_index").cast("int")), f"{self.path}/chunks/version={version}")
        if embed is not None:
            new = lacking(chunks.groupBy("key").agg(F.first("text").alias("_t")), self.vectors(), "key")

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for i in range(0, len(f), batch):
                        part = f.iloc[i : i + batch]
                        yield pd.DataFrame({"key": part["key"], "embedding": embed(part["_t"].tolist())})

            kept_at(new.mapInPandas(run, "key string, embedding array<double>"), f"{self.path}/vectors/version={version}")
        kept_at(rows, f"{self.path}/log/version={version}")  # from here on the version counts
        return version


def stamped(entries: DataFrame, versions: DataFrame, material: str = "course_id") -> DataFrame:
    """Cache entries to be written, with the version of the index that they were made from."""
    return entries.join(versions.select(F.col("material_id").alias(material), "index_version"), material)


def valid(cache: DataFrame, versions: DataFrame, material: str = "course_id") -> DataFrame:
    """Cache entries of materials that no load has changed since they were written."""
    return cache.join(versions.select(F.col("material_id").alias(material), "index_version"), [material, "index_version"])


def as_of(log: DataFrame, key: list[str], at: Column, written: str = "written_at", expires: str = "expires_at", tie: str = "entry_id") -> DataFrame:
    """A cache log's live entries at a time: of each key the newest written by then, unless it has expired (a null never does)."""
    seen = newest(log.where(F.col(written) <= at), key, [F.desc(written), F.desc(tie)], 1)
    return seen.where(F.col(expires).isNull() | (F.col(expires) > at))


def compacted(log: DataFrame, key: list[str], now: Column, written: str = "written_at", expires: str = "expires_at", tie: str = "entry_id") -> DataFrame:
    """What a cache log must keep so that every reading from now on is the same: live entries, and those written later."""
    return as_of(log, key, now, written, expires, tie).unionByName(log.where(F.col(written) > now))
