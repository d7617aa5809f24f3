"""Retrieval: postings and text scores, exact vector top-k, rank fusion, rerank, caches and their lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.arrays import cosine, reciprocal_rank
from ..functions.text import cache_key
from ..shipping import ship
from ..storage import stored
from .catalogue import newest

#: Rows of a block of vectors.
BLOCK_ROWS = 4096
#: Documents of a task that scores texts.
TASK_DOCS = 1024

#: Words that the text index leaves out.
STOP_WORDS = "a about an are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und www".split()


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf); docs of any length explode within their own task before the first shuffle."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def text_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", scorer: str = "tfidf", on: str | None = None) -> DataFrame:
    """(query, doc, score) for documents that share a token with the query (and the column on, if it is given).

    tfidf: sum of tf * idf^2 with idf = log10(N / df). bm25: Okapi with k1 = 1.2, b = 0.75. A document is tokenised once, and its
    postings of query tokens are kept as one row, from which N, lengths and document frequencies are counted too. Tasks hold about
    TASK_DOCS documents, whatever the table's size, and all scores of a document are made in one of them.
    """
    own = [on] if on else []
    dealt = lambda d: d.repartition(n_tasks, id_col)
    n_tasks = max(1, -(-docs.count() // TASK_DOCS))
    q = stored(queries.select(query_id, *own, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")), "query-tokens")  # of a known size, by which Spark chooses how to join
    wanted = q.select("token").distinct().unionByName(q.sparkSession.range(1).select(F.lit("").alias("token")))  # the empty token stands for the document
    d = dealt(docs.select(id_col, *own, F.coalesce(text_col, F.lit("")).alias("_x"))).select(id_col, *own, tokens(F.col("_x")).alias("_t"))
    d = d.select(id_col, *own, F.size("_t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "_t")).alias("token")).join(wanted, "token", "left_semi")
    d = d.groupBy(id_col, *own, "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    d = d.groupBy(id_col, *own).agg(F.max(F.when(F.col("token") == "", F.col("len"))).alias("len"), F.collect_list(F.when(F.col("token") != "", F.struct("token", "tf"))).alias("postings"))
    d = stored(d, "postings")
    n, total = d.agg(F.count("*"), F.sum("len")).first()
    avg = max((total or 0) / max(n, 1), 1e-9)
    df = d.select(F.explode("postings.token").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    terms = stored(q.join(df, "token"), "query-terms")
    p = dealt(d).select(id_col, *own, "len", F.explode("postings").alias("p")).select(id_col, *own, "len", "p.*")
    if scorer == "bm25":
        weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / avg))
    else:
        weight = F.col("tf") * F.log10(n / F.col("df")) * F.log10(n / F.col("df"))
    return p.join(terms, ["token", *own]).groupBy(query_id, id_col).agg(F.sum(weight).alias("score"))


def top(scores: DataFrame, by: str, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The first k of each query, with rank from 1; ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a list column, and where each list starts and how long it is."""
    size = np.asarray(pc.list_value_length(column)).astype(np.int64)
    return np.asarray(pc.list_flatten(column), dtype=np.float64), np.cumsum(size) - size, size


def _best(chunks: pa.Table, queries: pa.Table, k: int, same: bool, schema: pa.Schema) -> pa.Table:
    """The k best chunks of a block for each query of a block, by rounded cosine and then by id."""
    if not chunks.num_rows or not queries.num_rows:
        return schema.empty_table()
    (c_flat, c_at, c_len), (q_flat, q_at, q_len) = _flat(chunks.column("_c")), _flat(queries.column("_q"))
    ids, asked = chunks.column("chunk_id").to_numpy(), queries.column("query_id").to_numpy()
    allowed = queries.column("_ids").combine_chunks() if "_ids" in queries.column_names else None
    scores = np.zeros((len(asked), len(ids)))  # 0 where lengths differ or a vector has no length
    for n in np.unique(q_len[q_len > 0]):
        a, b = np.flatnonzero(q_len == n), np.flatnonzero(c_len == n)
        if not len(b):
            continue
        q, c = q_flat[q_at[a][:, None] + np.arange(n)], c_flat[c_at[b][:, None] + np.arange(n)]
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
        dots = q @ c.T
        scores[np.ix_(a, b)] = np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)
    scores = np.sign(scores) * np.floor(np.abs(scores) * 1e4 + 0.5) / 1e4
    at, of, got = [], [], []
    for i, row in enumerate(scores):
        may = np.arange(len(ids)) if same else np.flatnonzero(ids != asked[i])
        if allowed is not None:
            may = may[np.isin(ids[may], allowed[i].values.to_numpy())]
        s = row[may]
        if len(s) > k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            may, s = may[near], s[near]
        best = np.lexsort((ids[may], -s))[:k]
        at.append(np.full(len(best), i))
        of.append(may[best])
        got.append(s[best])
    at, of = np.concatenate(at), np.concatenate(of)
    return pa.table([queries.column("query_id").take(pa.array(at)), chunks.column("chunk_id").take(pa.array(of)), pa.array(np.concatenate(got))], schema=schema)


def vector_top(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str, vector: str = "embedding", on: str | None = None, same: bool = False, rows: int = BLOCK_ROWS, allowed: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k (score to 4 places, ties by id) of queries against all chunks (of the query's group, if on names one).

    Both sides are dealt over blocks of about rows rows, a group of any size over several; each pair of blocks is one
    matrix product in a task, of which the k best a query go on. Rows without a vector are left out. Ids are
    numbers. same keeps a chunk whose id is the query's. allowed (query_id, chunk_id) is what else a chunk must be in: it goes
    with the queries, as the ids of each block, so that blocks without any are not compared.
    """
    group = [F.col(on).alias("_on")] if on else [F.lit(0).alias("_on")]
    ship(queries.sparkSession)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_q"), *group).where("_q is not null")
    c = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("_c"), *group).where("_c is not null")
    blocks = lambda d, name: d.groupBy("_on").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = blocks(c, "_cs").join(blocks(q, "_qs"), "_on")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    c = c.join(sizes, "_on").select("_on", own("chunk_id", "_cs").alias("_a"), each("_qs").alias("_b"), "chunk_id", "_c")
    if allowed is None:
        q = q.join(sizes, "_on").select("_on", each("_cs").alias("_a"), own("query_id", "_qs").alias("_b"), "query_id", "_q")
    else:
        q = q.join(sizes, "_on").join(allowed.select("query_id", "chunk_id"), "query_id").withColumn("_a", own("chunk_id", "_cs"))
        ids = q.groupBy("_on", "query_id", "_a").agg(F.collect_set("chunk_id").alias("_ids"), F.first("_q").alias("_q"), F.first("_qs").alias("_qs"))  # at most a block's
        q = ids.select("_on", "_a", own("query_id", "_qs").alias("_b"), "query_id", "_q", "_ids")
    schema = StructType([q.schema["query_id"], c.schema["chunk_id"], StructField("score", DoubleType())])
    arrow, key = to_arrow_schema(schema), ["_on", "_a", "_b"]
    return top(c.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(lambda x, y: _best(x, y, k, same, arrow), schema), "query_id", "chunk_id", k)


def fused(a: DataFrame, b: DataFrame, by: str, id_col: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of vector and text rankings (by, id, score, rank): vector_score, text_score, rrf_score, score and rank.

    The score is the fused one; a query without any text result keeps its vectors' scores and order.
    """
    a, b = a.select(by, id_col, F.col("score").alias("vector_score"), F.col("rank").alias("rank_a")), b.select(by, id_col, F.col("score").alias("text_score"), F.col("rank").alias("rank_b"))
    both = a.join(b, [by, id_col], "full").withColumn("_said", F.max(F.col("rank_b").isNotNull()).over(Window.partitionBy(by)))
    both = both.withColumn("rrf_score", F.when(F.col("_said"), F.round(reciprocal_rank(F.col("rank_a"), constant) + reciprocal_rank(F.col("rank_b"), constant), 8)))
    both = both.withColumn("score", F.coalesce("rrf_score", "vector_score")).withColumn("_order", F.when(~F.col("_said"), F.col("rank_a")))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "_order", id_col)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_said", "_order", "rank_a", "rank_b")


def label(score: Column) -> Column:
    return F.when(score >= 0.7, "高").when(score >= 0.4, "中").otherwise("低")


def quality(results: DataFrame, by: str, score: str, text: str) -> DataFrame:
    """A query's label by its best score, and whether any of its chunks is a short fragment."""
    return results.groupBy(by).agg(F.coalesce(label(F.max(score)), F.lit("空")).alias("recall_quality"), F.when(F.bool_or(F.length(text) < 50), "短碎片").otherwise("正常").alias("chunk_quality"))


def exact_hits(requests: DataFrame, cache: DataFrame, key: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Requests with their unexpired entry, and those without one."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return requests.join(live, key), requests.join(live, key, "left_anti")


def similar_hit(requests: DataFrame, cache: DataFrame, by: list[str], least: float = 0.85, most: int = 10) -> DataFrame:
    """For each request (request_id, vector) the newest of the last entries (entry_id, cached_vector, ts) of its group that is alike."""
    recent = newest(cache, by, [F.desc("ts"), F.col("entry_id")], most)
    near = requests.join(recent, by).withColumn("similarity", F.round(cosine(F.col("vector"), F.col("cached_vector")), 4)).where(F.col("similarity") >= least)
    return newest(near, ["request_id"], [F.desc("ts"), F.col("entry_id")], 1)


def overlap_rerank(question: Column, text: Column) -> Column:
    """The share of the question's tokens that the text has: a default for where no model is at hand."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def reordered(found: DataFrame, scores: DataFrame, by: str = "query_id") -> DataFrame:
    """Candidates (by, ..., rank from 1) in the order of a reranker's scores (by, index from 0, rerank_score); those without one go."""
    d = found.join(scores.select(by, (F.col("index") + 1).alias("rank"), "rerank_score"), [by, "rank"])
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), "rank")
    return d.withColumn("_r", F.row_number().over(w)).drop("rank").withColumnRenamed("_r", "rank")


@dataclass
class Config:
    """What a search does: k results, text ranking beside vectors, rerank of over-fetched candidates; and its caches' rules."""

    k: int = 5
    text: bool = True
    scorer: str = "tfidf"
    rerank: bool = False
    reranker: Callable[[Column, Column], Column] = overlap_rerank
    alike: float = 0.85
    entries: int = 10
    ttl: int = 3600

    @property
    def candidates(self) -> int:
        return min(4 * self.k, 50) if self.rerank else self.k


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config, on: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank, vector_score, text_score, rrf_score, rerank_score) for queries (query_id, text, embedding) over chunks (chunk_id, text, embedding).

    on is a column of both, a course, say: a query then finds chunks of its own alone. A chunk or query without a vector
    takes part in the text ranking; a query without text results keeps the vectors' scores and order. A reranker orders
    more than one candidate; the score stays that of the retrieval. What a search didn't ask for, or a chunk doesn't have, is null.
    """
    n = config.candidates
    found = vector_top(queries, chunks, n, "query_id", "chunk_id", on=on, same=True)
    parts = ["vector_score", "text_score", "rrf_score"]
    if config.text:
        scores = text_scores(chunks, queries, "chunk_id", "text", "query_id", config.scorer, on).withColumn("score", F.round("score", 6))
        found = fused(found, top(scores, "query_id", "chunk_id", n), "query_id", "chunk_id", n)
    else:
        found = found.withColumns({"vector_score": F.col("score"), "text_score": F.lit(None).cast("double"), "rrf_score": F.lit(None).cast("double")})
    found = found.select("query_id", "chunk_id", "score", "rank", *parts)
    if config.rerank:
        d = found.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("text").alias("_c")), "chunk_id")
        scores = d.select("query_id", (F.col("rank") - 1).alias("index"), F.round(config.reranker(F.col("_q"), F.col("_c")), 6).alias("rerank_score"))
        found = reordered(found, scores)
    else:
        found = found.withColumn("rerank_score", F.lit(None).cast("double"))
    return found.where(F.col("rank") <= config.k).select("query_id", "chunk_id", "score", "rank", *parts, "rerank_score")


def confidence(rerank_score: str = "rerank_score", vector_score: str = "vector_score") -> Column:
    """The label of a result by what is comparable between queries: its reranker's score, else its cosine."""
    return label(F.coalesce(F.col(rerank_score), F.col(vector_score), F.lit(0.0)))


@dataclass
class Searched:
    """Results (request_id, chunk_id, score, rank, via: exact, similar or search), and the rows that the caches take in."""

    results: DataFrame
    exact: DataFrame
    recent: DataFrame


def access_pool(has_access: Column) -> Column:
    return F.when(has_access, "full").otherwise("preview")


def exact_key(query: Column, course: Column, access: Column) -> Column:
    return F.concat(F.lit("rag:exact:"), F.md5(F.concat(cache_key(query), F.lit("_"), course.cast("string"))), F.lit(":"), access)


def search(requests: DataFrame, chunks: DataFrame, config: Config, exact: DataFrame, recent: DataFrame, now: Column) -> Searched:
    """A batch of requests (request_id, course_id, text, embedding, has_access) through both caches, then over chunks of their course.

    exact has rows (key, course_id, results, expires_at), recent rows (course_id, access, entry_id, ts, cached_vector, results), where
    results is an array of (chunk_id, score) in order. A request takes the live entry of its key; else, of the newest
    entries of its course and access pool, the newest that is alike; else it searches. Requests of one batch don't see each
    other's entries. Entries to write are those of searched requests: for both caches, newest first by request_id.
    """
    r = requests.withColumn("access", access_pool(F.col("has_access")))
    r = r.withColumn("key", exact_key(F.col("text"), F.col("course_id"), F.col("access")))
    hit, rest = exact_hits(r, exact.select("key", "results", "expires_at"), ["key"], now)
    asked = rest.where("embedding is not null").select("request_id", "course_id", "access", F.col("embedding").alias("vector"))
    alike = similar_hit(asked, recent, ["course_id", "access"], config.alike, config.entries)
    rest = rest.join(alike.select("request_id"), "request_id", "left_anti")
    got = retrieve(rest.select(F.col("request_id").alias("query_id"), "course_id", "text", "embedding"), chunks, config, on="course_id").select(F.col("query_id").alias("request_id"), "chunk_id", "score", "rank")
    told = lambda d, via: d.select("request_id", F.posexplode("results").alias("_p", "_x")).select("request_id", "_x.chunk_id", "_x.score", (F.col("_p") + 1).alias("rank"), F.lit(via).alias("via"))
    results = told(hit, "exact").unionByName(told(alike, "similar")).unionByName(got.withColumn("via", F.lit("search")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    entries = rest.join(got.groupBy("request_id").agg(listed.alias("results")), "request_id")
    until = now + F.expr(f"INTERVAL {config.ttl} SECONDS")
    return Searched(results, entries.select("key", "course_id", "results", until.alias("expires_at")), entries.where("embedding is not null").select("course_id", "access", F.col("request_id").alias("entry_id"), now.alias("ts"), F.col("embedding").alias("cached_vector"), "results"))


def search_each(requests: DataFrame, accessible: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """(request_id, course_id, chunk_id, score, rank): the best of each course that the request's user may read.

    requests (request_id, user_id, text, embedding), accessible (user_id, course_id). Each course is a search of its own,
    and all lists are kept.
    """
    each = requests.join(accessible, "user_id").withColumn("query_id", F.xxhash64("request_id", "course_id"))
    got = retrieve(each.select("query_id", "course_id", "text", "embedding"), chunks, config, on="course_id")
    return got.join(each.select("query_id", "request_id", "course_id"), "query_id").select("request_id", "course_id", "chunk_id", "score", "rank")
