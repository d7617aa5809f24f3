"""Steps that call a model which the caller gives: embeddings with a cache, judgements, extraction, and comparisons of configurations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..functions.arrays import hit_at, precision_at, recall_at
from ..functions.parse import named_score
from ..functions.text import without_fence
from ..shipping import ship
from ..storage import stored
from .catalogue import lacking, remembered
from .evaluation import percentiles
from .retrieval import Config, retrieve, search

#: What a judge scores, from 1 to 5.
SCORES = ["task_complete", "process_reliable", "efficiency", "failure_handling"]


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in without a model: signed counts of hashed words, of length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embedded(docs: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """docs with an embedding each, and the cache (key, embedding) with the new entries: equal texts are embedded once, known ones not at all."""
    ship(docs.sparkSession)
    keyed = docs.withColumn("key", F.md5(text))
    new = lacking(keyed.select("key", F.col(text).alias("_t")).dropDuplicates(["key"]), cache, "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"], "embedding": embed(part["_t"].tolist())})

    cache = cache.select("key", "embedding").unionByName(new.mapInPandas(run, "key string, embedding array<double>"))
    return keyed.join(cache, "key").drop("key"), cache


@F.pandas_udf(BinaryType())
def vector_bytes(v: pd.Series) -> pd.Series:
    """Little-endian float32."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def bytes_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist())


def judgements(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds the four scores of a judge's reply: of its JSON, fenced or not, else of the first digits after their names."""
    body = without_fence(F.col(reply))
    schema = ", ".join(f"{s} int" for s in SCORES) + ", reason string"
    d = replies.withColumn("_j", F.from_json(body, schema))
    return d.select(*replies.columns, *[F.coalesce(F.col(f"_j.{s}"), named_score(F.col(reply), s)).alias(s) for s in SCORES], F.col("_j.reason").alias("reason"))


def extracted_profile(replies: DataFrame, user: str, seq: str, reply: str = "reply", least: float = 0.6) -> DataFrame:
    """(user, mem_key, mem_value, confidence) from replies that map keys to a value and a confidence; weak and empty ones dropped, later ones merged."""
    kind = "map<string,struct<value:string,confidence:double>>"
    d = replies.select(user, seq, F.explode(F.from_json(without_fence(F.col(reply)), kind)).alias("mem_key", "v"))
    d = d.where((F.col("v.confidence") >= least) & (F.coalesce("v.value", F.lit("")) != "")).select(user, seq, "mem_key", F.col("v.value").alias("mem_value"), F.col("v.confidence").alias("confidence"))
    return remembered(d, [user, "mem_key"], "confidence", seq).drop(seq)


def compared(queries: DataFrame, chunks: DataFrame, relevant: DataFrame, configs: dict[str, Config], k: int = 5) -> DataFrame:
    """(config, query_id, precision, recall, hit) of every configuration; relevant has an array of chunk ids a query."""
    out = None
    for name, config in configs.items():
        got = retrieve(queries, chunks, config).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("returned"))
        d = relevant.join(got, "query_id", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<long>")))
        x, y = F.col("returned"), F.col("relevant")
        rows = d.select(F.lit(name).alias("config"), "query_id", precision_at(x, y, k).alias("precision"), recall_at(x, y, k).alias("recall"), hit_at(x, y, k).alias("hit"))
        out = rows if out is None else out.unionByName(rows)
    return out


def matrix(requests: DataFrame, chunks: DataFrame, relevant: DataFrame, configs: dict[str, Config], now: Column, repeats: int = 3, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """An A/B matrix over searches with caches: results (config, call, request_id, via, precision, recall, hit) and latency
    (config, call, repeat, latency_ms).

    Each configuration is searched once to warm up, then repeats times with empty caches (call cold) and once more each time
    with what that search wrote (call cached). requests are those of retrieval.search; relevant has an array of chunk ids a
    request. A latency is a whole batch's, divided by its requests: a batch is what Spark runs. Results are the last repeat's.
    """
    spark = requests.sparkSession
    found = "array<struct<chunk_id:long,score:double>>"
    exact = spark.createDataFrame([], f"key string, course_id long, results {found}, expires_at timestamp")
    recent = spark.createDataFrame([], f"course_id long, access string, entry_id long, ts timestamp, cached_vector array<double>, results {found}")
    n, out, told = max(1, requests.count()), None, []
    for name, config in configs.items():
        search(requests, chunks, config, exact, recent, now).results.write.format("noop").mode("overwrite").save()
        for repeat in range(repeats):
            caches = (exact, recent)
            for call in ("cold", "cached"):
                began = time.monotonic()
                s = search(requests, chunks, config, *caches, now)
                got = stored(s.results, "results")
                told.append((name, call, repeat, (time.monotonic() - began) * 1000 / n))
                if call == "cold":
                    caches = (stored(s.exact, "exact"), stored(s.recent, "recent"))
                if repeat == repeats - 1:
                    lists = got.groupBy("request_id").agg(F.first("via").alias("via"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("returned"))
                    d = relevant.join(lists, "request_id", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<long>")))
                    x, y = F.col("returned"), F.col("relevant")
                    rows = d.select(F.lit(name).alias("config"), F.lit(call).alias("call"), "request_id", "via", precision_at(x, y, k).alias("precision"), recall_at(x, y, k).alias("recall"), hit_at(x, y, k).alias("hit"))
                    out = rows if out is None else out.unionByName(rows)
    return out, spark.createDataFrame(told, "config string, call string, repeat int, latency_ms double")


def summary(results: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Means by configuration, and floor-index percentiles of latency (config, latency_ms) where it was measured."""
    s = results.groupBy("config").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.count("*").alias("n"))
    return s if latency is None else s.join(percentiles(latency, ["config"], "latency_ms"), "config", "left")


def to_do(mode: Column, done: Column, has_access: Column, card_sent: Column) -> Column:
    """What is left to do: shoppers see details, then an offer; readers search what they may read; others' orders are looked up."""
    lacks = lambda tool: ~F.array_contains(done, tool)
    items = F.array(
        F.when((mode == "shopping") & lacks("get_material_detail"), "show details"),
        F.when((mode == "shopping") & ~has_access & ~card_sent, "offer purchase"),
        F.when((mode == "tutoring") & has_access & lacks("search_documents"), "search documents"),
        F.when((mode == "support") & lacks("get_orders"), "look up orders"),
    )
    return F.array_compact(items)
