"""Questions and ground truth made by a model that the caller gives: fixed batches, one retry, dead letters, restarts without repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import exists, kept_at, stored
from .catalogue import lacking
from .retrieval import Config, retrieve

#: Rows that a model is given at once, and how often it may fail.
BATCH, TRIES = 10, 2


def numbered(df: DataFrame, order: list[str | Column], name: str = "no", partitions: int | None = None) -> DataFrame:
    """Adds each row's number, from 1, in the order of all rows: sorted ranges are numbered by themselves, and moved by what
    lies before them, so that no task sees more than its range. Rows that order alike are numbered in any order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a range
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return d.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_at", "_own", "_before")


class Generation:
    """What a model has made, at a path: done (batch, chunk_id, question, no) and dead (batch, tries, error), a folder for each run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}") if exists(self.spark, f"{self.path}/{name}") else self.spark.createDataFrame([], columns)

    def done(self) -> DataFrame:
        return self._table("done", "batch long, chunk_id long, question string, place long, run int")

    def dead(self) -> DataFrame:
        """Batches of which every try so far has failed, as the last run left them."""
        d = self._table("dead", "batch long, tries int, error string, run int")
        last = d.groupBy("batch").agg(F.max_by(F.struct("tries", "error", "run"), "run").alias("r")).select("batch", "r.*")
        return lacking(last, self.done().select("batch").distinct(), "batch")

    def questions(self) -> DataFrame:
        """(query_id, chunk_id, question): ids by batch and place, the same in whatever run a batch was done."""
        return self.done().select(F.format_string("Q%03d", (F.col("batch") - 1) * BATCH + F.col("place")).alias("query_id"), "chunk_id", "question")

    def run(self, chunks: DataFrame, model: Callable[[list[str]], list[str]]) -> int:
        """Make a question for each of chunks (chunk_id, text) that has none; how many batches were tried.

        Chunks are numbered by their ids in batches of BATCH; a batch that is done is not asked for again. A model that raises, or gives
        another number of answers, is asked once more, then the batch is a dead letter and the others go on. Blank answers are left out.
        """
        ship(self.spark)
        batches = numbered(chunks.select("chunk_id", "text"), ["chunk_id"]).withColumn("batch", F.ceil(F.col("no") / BATCH))
        batches = lacking(batches, self.done().select("batch").distinct(), "batch").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("no", "chunk_id", "text"))).alias("rows"))

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for batch, rows in zip(f["batch"], f["rows"], strict=True):
                    error = ""
                    for tries in range(1, TRIES + 1):
                        try:
                            got = model([r["text"] for r in rows])
                            if len(got) != len(rows):
                                raise ValueError(f"{len(got)} answers to {len(rows)} texts")
                        except Exception as x:
                            error = f"{type(x).__name__}: {x}"[:500]
                            continue
                        out += [(batch, r["chunk_id"], q, place, tries, None) for place, (r, q) in enumerate(zip(rows, got, strict=True), 1)]
                        break
                    else:
                        out.append((batch, None, None, None, TRIES, error))
                yield pd.DataFrame(out, columns=["batch", "chunk_id", "question", "place", "tries", "error"]).astype({"chunk_id": "Int64", "place": "Int64"})

        n = max((int(r[0]) for r in self._table("runs", "rows long, run int").agg(F.coalesce(F.max("run"), F.lit(0))).collect()), default=0) + 1
        told = kept_at(batches.repartition("batch").mapInPandas(ask, "batch long, chunk_id long, question string, place long, tries int, error string"), f"{self.path}/told/run={n}")
        kept_at(told.where("error is not null").select("batch", "tries", "error"), f"{self.path}/dead/run={n}")
        kept_at(told.where("error is null and trim(question) <> ''").select("batch", "chunk_id", "question", "place"), f"{self.path}/done/run={n}")
        kept_at(told.agg(F.count("*").alias("rows")), f"{self.path}/runs/run={n}")
        return told.select("batch").distinct().count()


def expanded(queries: DataFrame, chunks: DataFrame, truth: DataFrame, judge: Callable[[list[tuple[str, str]]], list[bool]], k: int = 5, config: Config | None = None) -> DataFrame:
    """(query_id, chunk_id, source): truth (query_id, chunk_id) and what a judge finds relevant among each query's k best chunks.

    The search is that of config without rerank (vectors and text). The judge is given pairs of question and text in batches of BATCH;
    pairs that are known are not asked for. source is given or found.
    """
    ship(queries.sparkSession)
    config = config or Config()
    plain = Config(k=k, text=config.text, scorer=config.scorer)
    found = retrieve(queries, chunks, plain).select("query_id", "chunk_id")
    new = lacking(found, truth, ["query_id", "chunk_id"]).join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("text").alias("_c")), "chunk_id")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), BATCH):
                part = f.iloc[i : i + BATCH]
                yield part[["query_id", "chunk_id"]].assign(ok=judge(list(zip(part["_q"], part["_c"], strict=True))))

    kinds = [new.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")]
    judged = new.mapInPandas(ask, f"query_id {kinds[0]}, chunk_id {kinds[1]}, ok boolean").where("ok")
    given = truth.select("query_id", "chunk_id").distinct().withColumn("source", F.lit("given"))
    return given.unionByName(judged.select("query_id", "chunk_id", F.lit("found").alias("source")))
