"""Queries that run a stream over a table in a few small batches, each with the SQL of the whole table that must give the same rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..storage import fresh
from ..streaming import events, sessions
from .queries import query

#: Batches of a stream, and rows of a file.
BATCHES, FILE_ROWS = 3, 500_000


def in_batches(rows: DataFrame, seq: str, more: DataFrame | None = None) -> DataFrame:
    """A stream of rows in batches of ascending seq, then of more.

    A large batch has several files of ascending seq, written by as many tasks; so rows come in order however files are dealt to triggers.
    """
    spark = rows.sparkSession
    path = fresh(spark, "stream-in")
    least, most, n_rows = rows.agg(F.min(seq), F.max(seq), F.count("*")).first()
    n = max(1, -(-(most - least + 1) // BATCHES)) if least is not None else 1
    files_each = max(1, -(-n_rows // (BATCHES * FILE_ROWS)))
    at = F.floor((F.col(seq) - F.lit(least or 0)) / n)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, seen, began = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), set(), int(time.time() * 1000)
    for i, d in enumerate([*(rows.where(at == i) for i in range(BATCHES)), *([more] if more is not None else [])]):
        (d.coalesce(1) if files_each == 1 else d.repartitionByRange(files_each, seq)).write.mode("append").parquet(path)
        new = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in seen), key=lambda p: p.getName())
        for j, p in enumerate(new):  # files are taken in the order of their times, which may be alike
            seen.add(p.getName())
            fs.setTimes(p, began + 1_000_000 * i + 1000 * j, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_each).parquet(path)


def run_through(stream: DataFrame) -> DataFrame:
    """What a stream appends until its input is used up."""
    spark = stream.sparkSession
    out = fresh(spark, "stream-out")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", fresh(spark, "stream-state")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""SELECT event_id, coalesce(last_value(CASE event_type WHEN 'purchase' THEN 'shopping' WHEN 'error' THEN 'support' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'tutoring') AS mode,
 lag(event_id) OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS supersedes FROM events""")
def streamed_sessions(t):
    """Modes and superseded facts of sessions whose state is kept between batches."""
    e = t("events")
    sessions.with_state_store(e.sparkSession)
    decided = F.when(F.col("event_type") == "purchase", "shopping").when(F.col("event_type") == "error", "support")
    calls = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("source"), decided.alias("decided"))
    return run_through(sessions.sessions(in_batches(calls, "seq"), "tutoring")).select(F.col("seq").alias("event_id"), "mode", "supersedes")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS args FROM events),
 c AS (SELECT *, row_number() OVER (PARTITION BY user_id, args ORDER BY event_id) AS n FROM e WHERE event_type IN ('view', 'click')), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, args ORDER BY event_id) AS n FROM e WHERE event_type IN ('error', 'signup'))
 SELECT c.user_id, c.event_id, c.args, CASE WHEN r.event_id > c.event_id THEN r.event_id END AS result_id FROM c LEFT JOIN r USING (user_id, args, n)""")
def streamed_pairs(t):
    """Calls with their results, as they come, and those that are given up in the end."""
    e = t("events").where(F.col("event_type").isin("view", "click", "error", "signup"))
    sessions.with_state_store(e.sparkSession)
    args = F.get_json_object("props", "$.k").cast("int") % 5
    d = e.select(F.col("user_id").cast("long").alias("run"), args.alias("args"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").isin("view", "click").alias("is_call"), F.timestamp_micros(F.col("event_id") + 1000).alias("ts"))  # beyond the first watermark
    end = d.sparkSession.range(1).select(F.lit(-1).cast("long").alias("run"), F.lit(0).alias("args"), F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("is_call"), F.timestamp_seconds(F.lit(1 << 32)).alias("ts"))  # a time after all others
    wait = 10**12  # in ms: nothing is given up before that time
    out = run_through(sessions.paired(in_batches(d, "seq", end), wait, late="0 seconds")).where("run >= 0")
    return out.select(F.col("run").alias("user_id"), F.col("seq").alias("event_id"), "args", F.col("result_seq").alias("result_id"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS event, replace(coalesce(text, ''), chr(10), ' ') AS data FROM conversations")
def parsed_events(t):
    """Every conversation as an event stream, cut into packets that end anywhere, and put together again."""
    c = t("conversations")
    e = files.server_events(c.select("conv_id", "turn", "role", F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("data")), "role", "data", keep=["conv_id", "turn"])
    e = e.withColumn("value", F.concat(F.lit("\n"), F.expr("substring(value, 1, length(value) - 2)")))  # the end of an event comes with the next one
    size = F.lit(7) + F.col("turn") % 40
    raw = F.encode("value", "UTF-8")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(raw) - 1) / size).cast("int")), lambda i: F.substring(raw, i * size.cast("int") + 1, size.cast("int")))
    p = e.select("conv_id", "turn", F.posexplode(pieces).alias("piece", "data"))
    last = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit(0).alias("piece"), F.lit(b"\n").alias("data"))
    p = p.unionByName(last).withColumn("seq", F.col("turn").cast("long") * 1_000_000_000 + F.col("piece")).withColumn("ms", F.col("turn").cast("long") * 1000)
    return events.parsed(p, "conv_id").select("conv_id", "n", "event", "data")
