"""A stored text index: postings in blocks with maxima, searched by upper bounds so that blocks which can't matter are not read.

Documents are dealt over ranges of about RANGE_DOCS by a hash of their ids; a block holds the postings of one token in one
range, with the greatest frequency and the least document length in it. From these each query has an upper bound of any score
in a range. The ranges of greatest bounds are scored first; the k-th best score that they give rules out all ranges
whose bound is below it, and only postings of the others are read. Scores are Okapi's (k1 = 1.2, b = 0.75), as in
retrieval.text_scores. A changed document rewrites the parts that its range lies in, not the index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept_at, stored
from .catalogue import lacking, newest
from .retrieval import tokens, top

#: Documents of a range, ranges of a folder, folders at most, ranges of greatest bounds that are scored first, and queries that a range lists together.
RANGE_DOCS, PART_RANGES, MOST_PARTS, FIRST, TOGETHER = 64, 32, 4096, 4, 1024
BLOCK = "token string, range long, doc_ids array<long>, tfs array<int>, lens array<int>, n long, most_tf long, least_len long, part int"


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


class TextIndex:
    """An index at a path: lengths (doc_id, len) and blocks, both partitioned by part, and the number of ranges it was made with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks").where("token is not null")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, len long, part int").parquet(f"{self.path}/lengths").where("doc_id is not null")

    def ranges(self) -> int:
        return self.spark.read.parquet(f"{self.path}/ranges").first()[0]

    def parts(self) -> int:
        return _parts(self.ranges())

    def of_tokens(self, wanted: DataFrame) -> DataFrame:
        """The blocks of some tokens (token, each once), dealt by range over as many tasks as there are parts."""
        return self.blocks().select("token", "range", "doc_ids", "tfs", "lens").join(wanted, "token").repartition(self.parts(), "range")

    def search(self, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text", digits: int = 6) -> DataFrame:
        """(query, doc_id, score, rank): the k best documents of each query, ties by doc_id; the same as of all scores."""
        return self.searched(queries, k, query_id, text, digits)[0]

    def searched(self, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text", digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """The results of search, and (query, range, bound, n, read): every range that shares a token with a query, the postings that
        it has for it, and whether they were read."""
        n_docs, total = self.lengths().agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        mean = max(total / n_docs, 1e-9) if n_docs else 1.0
        q = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
        q = stored(q, "query-tokens")  # stored tables have a known size, by which Spark chooses how to join
        heads = self.blocks().select("token", "range", "n", "most_tf", "least_len").join(q.select("token").distinct(), "token")
        df = heads.groupBy("token").agg(F.sum("n").alias("df")).select("token", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        q = stored(q.join(df, "token").withColumn("_few", F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(q.select("query").distinct().count() / TOGETHER))))), "query-tokens")
        bound = F.col("idf") * _weight(F.col("most_tf"), F.col("least_len"), mean)
        bounds = stored(heads.join(q, "token").groupBy("query", "_few", "range").agg(F.sum(bound).alias("bound"), F.sum("n").alias("n")), "bounds")

        def scored(met: DataFrame) -> DataFrame:
            d = met.select("range", "query", "idf", F.explode(F.arrays_zip("doc_ids", "tfs", "lens")).alias("p"))
            weight = F.col("idf") * _weight(F.col("p.tfs"), F.col("p.lens"), mean)
            return d.groupBy("range", "query", F.col("p.doc_ids").alias("doc_id")).agg(F.round(F.sum(weight), digits).alias("score")).drop("range")

        first = stored(newest(bounds, ["query"], [F.desc("bound"), F.col("range")], FIRST), "first")
        wanted = stored(first.select("query", "range").join(q.select("query", "token", "idf"), "query"), "first-blocks")
        early = stored(top(scored(self.blocks().join(wanted, ["token", "range"])), "query", "doc_id", k), "early")
        floor = early.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        rest = lacking(bounds, first.select("query", "range"), ["query", "range"]).join(floor, "query", "left")
        rest = rest.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-digits)).select("query", "_few", "range", "bound", "n")
        # blocks of query tokens move once to the task of their range, where they meet the queries that it may matter to
        near = self.of_tokens(q.select("token").distinct()).join(rest.groupBy("range", "_few").agg(F.collect_set("query").alias("_who")).repartition(self.parts(), "range"), "range")
        met = near.join(q, ["token", "_few"]).where(F.array_contains("_who", F.col("query")))
        late = top(scored(met), "query", "doc_id", k)
        read = first.select("query", "range").unionByName(rest.select("query", "range")).withColumn("read", F.lit(True))
        plan = bounds.join(read, ["query", "range"], "left").withColumn("read", F.coalesce("read", F.lit(False)))
        return top(early.drop("rank").unionByName(late.drop("rank")), "query", "doc_id", k).withColumnRenamed("query", query_id), plan

    def update(self, changed: DataFrame, gone: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> None:
        """Replace or add changed documents and take out those of gone (ids): parts that hold neither stay as they are.

        Parts are made in full before one is replaced, so an update that breaks off can be run again.
        """
        ranges = self.ranges()
        lengths, postings = _postings(changed, ranges, id_col, text)
        ids = changed.select(F.col(id_col).cast("long").alias("doc_id"))
        ids = (ids if gone is None else ids.union(gone.select(F.col(id_col).cast("long").alias("doc_id")))).where("doc_id is not null").distinct()
        ids = stored(ids.withColumn("range", _range(F.col("doc_id"), ranges)).withColumn("part", _part(F.col("range"), ranges)), "changed-ids")
        parts = ids.select("part").distinct()
        out = ids.groupBy("part", "range").agg(F.collect_list("doc_id").alias("_ids")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("range", "_ids"))).alias("_out"))
        columns = ["part", "range", "token", "doc_ids", "tfs", "lens"]
        old = self.blocks().join(parts, "part", "left_semi").select(*columns, F.lit(True).alias("_old"))
        # old and new blocks move once, whole, to the task of their part, where changed ids are taken out
        both = old.unionByName(_blocks(postings).select(*columns, F.lit(False).alias("_old"))).repartition(_parts(ranges), "part").join(out.repartition(_parts(ranges), "part"), "part")
        left = F.coalesce(F.element_at("_out", F.col("range")), F.array().cast("array<long>"))
        kept_of = F.filter(F.arrays_zip("doc_ids", "tfs", "lens"), lambda p: ~F.col("_old") | ~F.array_contains(left, p["doc_ids"]))
        both = both.withColumn("p", kept_of).where(F.size("p") > 0)
        blocks = both.groupBy("part", "range", "token").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
        split = lambda of: F.transform("p", lambda x: x[of])
        blocks = blocks.select("part", "range", "token", split("doc_ids").alias("doc_ids"), split("tfs").alias("tfs"), split("lens").alias("lens"))
        blocks = blocks.withColumns({"n": F.size("doc_ids").cast("long"), "most_tf": F.array_max("tfs").cast("long"), "least_len": F.array_min("lens").cast("long")})
        blocks = stored(blocks.sortWithinPartitions("part", "token", "range"), "blocks")
        # a part that has lost all its rows is written too, empty, else its folder would stay as it was
        bare = parts.select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in BLOCK.removesuffix(", part int").split(", "))], "part")
        blocks = blocks.unionByName(lacking(bare, blocks.select("part").distinct(), "part"))
        kept = stored(lacking(self.lengths().join(parts, "part", "left_semi"), ids, "doc_id").unionByName(lengths), "lengths")
        kept = kept.unionByName(lacking(parts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("len"), "part"), kept.select("part").distinct(), "part"))
        for d, name in ((blocks, "blocks"), (kept.repartition("part"), "lengths")):  # blocks of a part already lie together
            d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/{name}")


def _range(doc_id: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ranges))


def _parts(ranges: int) -> int:
    return min(MOST_PARTS, max(1, math.ceil(ranges / PART_RANGES)))


def _part(of: Column, ranges: int) -> Column:
    return F.pmod(of, F.lit(_parts(ranges))).cast("int")


def _postings(docs: DataFrame, ranges: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, len, part), and (part, range, token, doc_id, tf, len); of rows with one id the least text counts.

    Texts move once, each part to a task of its own, so that a task holds the documents of one part whatever the table's size;
    all that is counted from then on is counted there.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("_x"))
    d = d.withColumn("range", _range(F.col("doc_id"), ranges)).withColumn("part", _part(F.col("range"), ranges)).repartitionById(_parts(ranges), "part")
    d = d.groupBy("part", "range", "doc_id").agg(F.min("_x").alias("_x")).withColumn("_t", tokens(F.col("_x"))).withColumn("len", F.size("_t").cast("long"))
    counts = d.select("part", "range", "doc_id", "len", F.explode("_t").alias("token")).groupBy("part", "range", "token", "doc_id", "len").agg(F.count("*").alias("tf"))
    return d.select("doc_id", "len", "part"), counts.select("part", "range", "token", "doc_id", "tf", "len")


def _blocks(postings: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))))  # documents of one range
    d = postings.groupBy("part", "range", "token").agg(listed.alias("p"), F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"))
    of = lambda name: F.transform("p", lambda x: x[name])
    return d.select("part", "range", "token", of("doc_id").alias("doc_ids"), of("tf").alias("tfs"), of("len").alias("lens"), "n", "most_tf", "least_len")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> TextIndex:
    """Make an index of all documents with an id; a null text has no tokens."""
    ranges = max(1, math.ceil(docs.count() / RANGE_DOCS))
    spark = docs.sparkSession
    kept_at(spark.range(1).select(F.lit(ranges).alias("ranges")), f"{path}/ranges")
    lengths, postings = _postings(docs, ranges, id_col, text)
    _blocks(postings).sortWithinPartitions("part", "token", "range").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    lengths.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/lengths")
    return TextIndex(spark, path)


def containing(index: TextIndex, queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, chunk_id) of the documents that have every token of a query; a query without tokens has none."""
    q = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("_t"))
    q = q.select("query_id", F.size("_t").alias("_n"), F.explode("_t").alias("token"))
    q = stored(q, "query-tokens")
    d = index.of_tokens(q.select("token").distinct()).join(q, "token").select("range", "query_id", "_n", F.explode("doc_ids").alias("chunk_id"))
    return d.groupBy("range", "query_id", "chunk_id").agg(F.count("*").alias("_has"), F.first("_n").alias("_n")).where("_has = _n").select("query_id", "chunk_id")
