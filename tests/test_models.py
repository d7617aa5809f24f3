from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnfold.operators import models
from tarnfold.operators.retrieval import Config


def test_embeddings_are_cached(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    cache = spark.createDataFrame([], "key string, embedding array<double>")
    got, cache = models.embedded(docs, cache, models.hashed_embedder(8))
    rows = {r.doc_id: r.embedding for r in got.collect()}
    assert rows[1] == rows[2] != rows[3] and cache.count() == 2

    def never(texts):
        raise AssertionError("known texts are not embedded again")

    known = spark.createDataFrame(cache.collect(), cache.schema)
    assert models.embedded(docs, known, never)[0].count() == 3


def test_vector_bytes(spark):
    d = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    got = d.select(models.vector_bytes("v").alias("b")).select("b", models.bytes_vector("b").alias("v")).collect()
    assert got[0].v == [1.0, -2.5] and len(got[0].b) == 8 and got[1].v is None


def test_judgements(spark):
    rows = [('```json\n{"task_complete": 4, "process_reliable": 3, "efficiency": 5, "failure_handling": 2, "reason": "ok"}\n```',), ('no json but "efficiency" : 3',), ("nothing",)]
    got = [tuple(r[s] for s in models.SCORES) for r in models.judgements(spark.createDataFrame(rows, "reply string")).collect()]
    assert got == [(4, 3, 5, 2), (0, 0, 3, 0), (0, 0, 0, 0)]


def test_profiles(spark):
    rows = [(1, 1, '{"goal":{"value":"x","confidence":0.9},"level":{"value":"","confidence":1.0}}'), (1, 2, '{"goal":{"value":"y","confidence":0.7},"style":{"value":"z","confidence":0.5}}'), (2, 1, "broken")]
    got = models.extracted_profile(spark.createDataFrame(rows, "u long, s long, reply string"), "u", "s").collect()
    assert [tuple(r) for r in got] == [(1, "goal", "x", 0.9)]


def test_comparison(spark):
    embed = models.hashed_embedder(32)
    texts = ["alpha beta gamma delta", "alpha one two three", "epsilon zeta eta theta", "unrelated words here now"]
    chunks = spark.createDataFrame([(i, t, embed([t])[0]) for i, t in enumerate(texts)], "chunk_id long, text string, embedding array<double>")
    q = spark.createDataFrame([(7, "alpha beta", embed(["alpha beta"])[0])], "query_id long, text string, embedding array<double>")
    rel = spark.createDataFrame([(7, [0])], "query_id long, relevant array<long>")
    res = models.compared(q, chunks, rel, {"plain": Config(k=2, text=False), "fused": Config(k=2), "reranked": Config(k=2, rerank=True)}, 2)
    assert {(r.config, r.precision, r.recall, r.hit) for r in res.collect()} == {(c, 0.5, 1.0, True) for c in ("plain", "fused", "reranked")}
    assert models.summary(res).count() == 3


def test_to_do(spark):
    d = spark.createDataFrame([("shopping", ["get_material_detail"], False, False), ("support", [], True, True)], "m string, t array<string>, a boolean, c boolean")
    assert [r.x for r in d.select(models.to_do(F.col("m"), F.col("t"), F.col("a"), F.col("c")).alias("x")).collect()] == [["offer purchase"], ["look up orders"]]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_matrix_of_cold_and_cached_searches(spark):
    import datetime as dt

    from tarnfold.operators.evaluation import percentiles

    embed = models.hashed_embedder(16)
    texts = ["lists of words", "trees of nodes", "graphs and edges", "words in lists"]
    chunks = spark.createDataFrame([(i, 1, t, embed([t])[0]) for i, t in enumerate(texts)], "chunk_id long, course_id long, text string, embedding array<double>")
    asked = ["words lists", "trees nodes"]
    requests = spark.createDataFrame([(i, 1, t, embed([t])[0], True) for i, t in enumerate(asked)], "request_id long, course_id long, text string, embedding array<double>, has_access boolean")
    relevant = spark.createDataFrame([(0, [0, 3]), (1, [1])], "request_id long, relevant array<long>")
    configs = {"plain": Config(k=2, text=False), "reranked": Config(k=2, rerank=True)}
    results, latency = models.matrix(requests, chunks, relevant, configs, F.lit(dt.datetime(2024, 1, 1)), repeats=1, k=2)
    got = {(r.config, r.call, r.request_id): (r.via, r.hit, r.recall) for r in results.collect()}
    assert len(got) == 8 and all(v[0] == ("search" if c == "cold" else "exact") and v[1] for (_, c, _), v in got.items())
    assert all(got[c, "cold", i][1:] == got[c, "cached", i][1:] for c in configs for i in (0, 1))
    measured = latency.collect()
    assert len(measured) == 4 and all(r.latency_ms > 0 for r in measured)
    assert percentiles(latency, ["config", "call"], "latency_ms").count() == 4
