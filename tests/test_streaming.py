import datetime as dt
import random

from pyspark.sql import functions as F

from tarnfold.operators import evaluation, replay
from tarnfold.sources import files
from tarnfold.streaming import events, live, sessions


def test_limiter_stream(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("a", s) for s in (1, 2, 3, 4, 70)], "k string, s long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, s long").parquet(src)
    q = live.limited(stream, "k", "s", 3).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    got = sorted((r.s, r.admitted) for r in spark.read.parquet(out).collect())
    assert got == [(1, True), (2, True), (3, True), (4, False), (70, True)]


def test_index_on_change_takes_newest(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id long, version long, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("doc_id long, version long, text string").parquet(src)
    q = live.on_change(stream, lambda d: d.write.mode("append").parquet(out), f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "b"), (2, "c")]


def test_windowed_counts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert live.windowed_counts(d).agg(F.sum("n")).first()[0] == d.count()


def written(spark, path, rows, kind):
    """One more file, later than those before."""
    import glob
    import os

    had = set(glob.glob(f"{path.removeprefix('file://')}/part*"))
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    for f in set(glob.glob(f"{path.removeprefix('file://')}/part*")) - had:
        os.utime(f, (1_700_000_000 + 10 * len(had),) * 2)


def streamed(df, out, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(out)
    assert q.awaitTermination(300)
    return df.sparkSession.read.parquet(out)


def test_sessions_in_small_batches_give_the_windows_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.choice(["s1", "s2", "s3"]), rng.choice(["shopping", "support", None, None])) for i in range(120)]
    kind = "session string, seq long, source string, decided string"
    for i in range(0, 120, 40):
        written(spark, f"file://{tmp_path}/in", rows[i : i + 40], kind)
    sessions.with_state_store(spark)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = streamed(sessions.sessions(stream, "tutoring"), f"file://{tmp_path}/out", tmp_path).collect()
    d = spark.createDataFrame(rows, kind)
    modes = {r.seq: r.mode for r in replay.modes(d, "session", "seq", F.col("decided"), "tutoring").collect()}
    facts = {r.seq for r in replay.facts(d, "session", ["source"], "seq").where("layer = 'fact'").collect()}
    assert {r.seq: r.mode for r in got} == modes and len(got) == 120 and not any(r.ended for r in got)
    assert {r.seq for r in got} - {r.supersedes for r in got} == facts


def test_idle_sessions_end_and_begin_anew(spark, tmp_path):
    kind = "session string, seq long, source string, decided string, ts timestamp"
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    for rows in ([("a", 1, "s", "shopping", at(0)), ("b", 2, "s", None, at(1))], [("b", 3, "s", None, at(90))], [("a", 4, "s", None, at(91))], [("z", 5, "s", None, at(500))]):
        written(spark, f"file://{tmp_path}/in", rows, kind)
    sessions.with_state_store(spark)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = streamed(sessions.sessions(stream, "tutoring", idle_ms=30 * 60_000, ts="ts", late="0 seconds"), f"file://{tmp_path}/out", tmp_path).collect()
    assert {(r.session, r.seq, r.mode, r.supersedes) for r in got if not r.ended and r.session == "a"} == {("a", 1, "shopping", None), ("a", 4, "tutoring", None)}
    assert sorted((r.session, r.mode) for r in got if r.ended) == [("a", "shopping"), ("a", "tutoring"), ("b", "tutoring"), ("b", "tutoring")]


def test_streamed_pairs_are_those_of_the_whole_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.randrange(3), i, rng.random() < 0.55, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=i)) for i in range(150)]
    kind = "run string, args int, seq long, is_call boolean, ts timestamp"
    last = ("end", 0, 10_000, True, dt.datetime(2024, 2, 1, tzinfo=dt.UTC))
    for i in range(0, 150, 50):
        written(spark, f"file://{tmp_path}/in", rows[i : i + 50], kind)
    written(spark, f"file://{tmp_path}/in", [last], kind)
    sessions.with_state_store(spark)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = streamed(sessions.paired(stream, 3_600_000, late="0 seconds"), f"file://{tmp_path}/out", tmp_path).where("run <> 'end'")
    d = spark.createDataFrame(rows, kind)
    want = evaluation.paired(d.where("is_call").select("run", "args", "seq"), d.where("not is_call").select("run", "args", "seq"), "run", "seq", ["args"])
    assert sorted((r.run, r.args, r.seq, r.result_seq or 0) for r in got.collect()) == sorted((r.run, r.args, r.seq, r.result_seq or 0) for r in want.collect())


def test_calls_without_a_result_in_time(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    for calls, results in (([(1, at(0)), (2, at(1)), (3, at(2))], [(1, at(5), "ok")]), ([(9, at(400))], [(2, at(130), "too late"), (9, at(400), "ok")])):
        written(spark, f"file://{tmp_path}/calls", calls, "call_id long, called_at timestamp")
        written(spark, f"file://{tmp_path}/results", results, "call_id long, returned_at timestamp, result string")
    c = spark.readStream.schema("call_id long, called_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/calls")
    r = spark.readStream.schema("call_id long, returned_at timestamp, result string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/results")
    got = {x.call_id: x.result for x in streamed(sessions.answered(c, r), f"file://{tmp_path}/out", tmp_path).collect()}
    assert got == {1: "ok", 2: None, 3: None, 9: "ok"}


def test_events_cut_at_every_byte(spark):
    sent = [("delta", '{"content":"héllo 世界"}'), ("thinking", '{"tool":"search"}'), ("delta", ""), ("done", "{}"), ("delta", "after the end")]
    raw = "".join(r.value for r in files.server_events(spark.createDataFrame([(i, e, d) for i, (e, d) in enumerate(sent)], "i long, e string, d string").orderBy("i"), "e", "d").collect()).encode()
    packets = [(f"cut{i}", k, 10 * k, bytearray(p)) for i in range(len(raw) + 1) for k, p in enumerate((raw[:i], raw[i:]))]
    packets += [("bytes", k, k, bytearray(raw[k : k + 1])) for k in range(len(raw))]
    packets += [("gap", 0, 0, bytearray(raw[:60])), ("gap", 1, 30_001, bytearray(raw[60:])), ("still", 0, 0, bytearray(raw[:60])), ("still", 1, 30_000, bytearray(raw[60:])), ("none", 0, 0, None), ("open", 0, 0, bytearray(b"event: a\ndata: x\ndata: y"))]
    got = {}
    for r in events.parsed(spark.createDataFrame(packets, "connection string, seq long, ms long, data binary")).orderBy("connection", "n").collect():
        assert r.n == len(got.setdefault(r.connection, [])) + 1
        got[r.connection].append((r.event, r.data))
    for c, e in got.items():
        assert e == (sent[:1] if c == "gap" else [("a", "x")] if c == "open" else sent[:4]), c
    assert len(got) == len(raw) + 1 + 4
