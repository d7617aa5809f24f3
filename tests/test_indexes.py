"""Stored indexes: recall, versions, and what a load that breaks off leaves, against plain Python."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.functions import parse as P
from tarnfold.functions import text as X
from tarnfold.operators import indexing, text_index, vector_index
from tarnfold.operators import retrieval as R


def embedder(known):
    """One number for each text; a text that is asked for again is an error."""

    def embed(texts):
        for t in texts:
            assert t not in known, t
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "material_id string, doc_id long, text string")


def test_loads_versions_and_siblings(spark, tmp_path):
    index = indexing.DocumentIndex(spark, f"file://{tmp_path}/index")
    assert index.chunks().count() == index.rows().count() == 0 and index.load(docs_of(spark, [])) == 0
    first = [("m", 1, "# a\nfirst"), ("m", 2, "# b\nsecond"), ("n", 1, "**plain** text"), ("n", 2, None), ("n", 3, "# b\nsecond"), ("n", 3, "# b\nsecond")]
    assert index.load(docs_of(spark, first), embed=embedder([])) == 1
    got = lambda: sorted((r.material_id, r.doc_id, r.version, r.text) for r in index.chunks().collect())
    assert got() == [("m", 1, 1, "first"), ("m", 2, 1, "second"), ("n", 1, 1, "plain text"), ("n", 3, 1, "second")]
    known = ["first", "second", "plain text"]
    assert index.load(docs_of(spark, first), embed=embedder(known)) == 1  # again: nothing changes
    assert index.load(docs_of(spark, [("m", 2, "# c\nnew"), ("m", 1, "# a\nfirst")]), embed=embedder(known)) == 2
    assert got() == [("m", 1, 1, "first"), ("m", 2, 2, "new"), ("n", 1, 1, "plain text"), ("n", 3, 1, "second")]
    assert {r.material_id: r.index_version for r in index.material_versions().collect()} == {"m": 2, "n": 1}
    gone = spark.createDataFrame([("n", 1), ("n", 9), ("m", 1)], "material_id string, doc_id long")
    assert index.load(docs_of(spark, [("m", 1, "# a\nfirst")]), gone) == 3  # m 1 came again in the same load: it goes, as it is named
    assert got() == [("m", 2, 2, "new"), ("n", 3, 1, "second")]
    assert index.load(docs_of(spark, [("n", 1, "**plain** text")]), embed=embedder([*known, "new"])) == 4  # back again, its vector is known
    rows = {(r.material_id, r.doc_id): (r.text, r.embedding) for r in index.rows().collect()}
    assert rows == {("m", 2): ("new", [3.0, 1.0]), ("n", 3): ("second", [6.0, 1.0]), ("n", 1): ("plain text", [10.0, 1.0])}
    assert index.load(docs_of(spark, [("n", 3, "# b\nsecond")]), force=True) == 5


def test_a_load_that_breaks_off_counts_for_nothing(spark, tmp_path):
    index = indexing.DocumentIndex(spark, f"file://{tmp_path}/index")
    index.load(docs_of(spark, [("m", 1, "one"), ("m", 2, "two")]), embed=embedder([]))
    before = sorted(map(tuple, index.chunks().collect()))
    with pytest.raises(Exception, match="three"):
        index.load(docs_of(spark, [("m", 1, "three"), ("m", 3, "four")]), embed=embedder(["three"]))
    assert sorted(map(tuple, index.chunks().collect())) == before and index.material_versions().first().index_version == 1
    assert index.load(docs_of(spark, [("m", 1, "five")]), embed=embedder([])) == 2
    assert sorted(r.text for r in index.chunks().collect()) == ["five", "two"] and index.vectors().count() == 3


def test_entries_of_a_changed_material_never_hit(spark, tmp_path):
    index = indexing.DocumentIndex(spark, f"file://{tmp_path}/index")
    index.load(docs_of(spark, [("7", 1, "one"), ("8", 1, "two")]))
    entries = spark.createDataFrame([("k7", "7"), ("k8", "8"), ("k9", "9")], "key string, course_id string")
    cache = indexing.stamped(entries, index.material_versions()).collect()
    cache = spark.createDataFrame(cache)
    live = lambda: sorted(r.key for r in indexing.valid(cache, index.material_versions()).collect())
    assert live() == ["k7", "k8"]
    index.load(docs_of(spark, [("7", 2, "sibling")]))
    assert live() == ["k8"]
    index.load(docs_of(spark, []), spark.createDataFrame([("8", 1)], "material_id string, doc_id long"))
    assert live() == []


def test_cache_log_reads_the_same_after_compaction(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 5)), int(rng.integers(0, 100)), None if i % 5 == 0 else int(rng.integers(0, 150))) for i in range(200)]
    log = spark.createDataFrame(rows, "entry_id long, k long, written_at long, expires_at long")
    want = lambda at: sorted(e for k in range(5) for e, _, _, x in [max((r for r in rows if r[1] == k and r[2] <= at), key=lambda r: (r[2], r[0]), default=(None, 0, 0, 0))] if e is not None and (x is None or x > at))
    for at in (-1, 10, 50, 99, 200):
        log = indexing.compacted(log, ["k"], F.lit(at))
        assert sorted(r.entry_id for r in indexing.as_of(log, ["k"], F.lit(at)).collect()) == want(at)
    assert log.count() <= 5


def test_vector_index_finds_what_an_exact_search_finds(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vector_index.write(e, f"file://{tmp_path}/v", "vec_id")
    asked = e.where("vec_id % 100 = 0")
    pairs = lambda d: {(r.query_id, r.chunk_id, r.score) for r in d.collect()}
    found, exact = pairs(vector_index.search(index, asked, 5, "vec_id")), pairs(R.vector_top(asked, e, 5, "vec_id", "vec_id"))
    assert len(found) == len(exact) == 100 and len(found & exact) >= 90
    everything = vector_index.search(index, asked, 5, "vec_id", probed=1.0, rescored=400)
    assert pairs(everything) == exact


def test_vector_index_of_odd_rows_and_updates(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(1000, None), (1001, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1002, [2.0])]
    rows += [(2000 + i, [9.0, 9.0, 1.0]) for i in range(150)]  # a third is one vector
    kind = "chunk_id long, embedding array<double>"
    d = spark.createDataFrame(rows, kind)
    index = vector_index.write(d, f"file://{tmp_path}/v", lists=6)
    asked = spark.createDataFrame([(5, [1.0, 4.0, 1.0]), (7, None)], "query_id long, embedding array<double>")
    top = lambda ix, **more: [(r.chunk_id, r.score) for r in vector_index.search(ix, asked, 3, probed=1.0, rescored=200, block=40, **more).orderBy("rank").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / np.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if len(a) == len(b) and any(b) else 0.0
    want = lambda rows, own: sorted(((-round(float(cos([1.0, 4.0, 1.0], v)), 4), i) for i, v in rows if v is not None and i is not None and i != own))[:3]
    assert top(index) == [(i, -s) for s, i in want(rows, 5)]
    assert top(index, same=True) == [(i, -s) for s, i in want(rows, None)]
    new = vector_index.updated(index, spark.createDataFrame([(4, [1.0, 4.0, 1.0]), (5000, [1.0, 4.0, 1.01])], kind), f"file://{tmp_path}/w", spark.createDataFrame([(9,), (39,)], "chunk_id long"))
    now = [(i, v) for i, v in rows if i not in (4, 9, 39)] + [(4, [1.0, 4.0, 1.0]), (5000, [1.0, 4.0, 1.01])]
    assert top(new) == [(i, -s) for s, i in want(now, 5)]
    none = vector_index.write(d.limit(0), f"file://{tmp_path}/n")
    assert vector_index.search(none, asked, 3).count() == 0


def scores_by_force(spark, docs, queries):
    s = R.text_scores(spark.createDataFrame(docs, "doc_id long, text string"), queries, scorer="bm25").withColumn("score", F.round("score", 6))
    return [tuple(r) for r in R.top(s, "item_id", "doc_id", 5).select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()]


def test_stored_postings_give_the_same_rows_and_read_fewer(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words[: 20 if i % 50 else 400], rng.integers(1, 60)))) for i in range(2500)] + [(9001, None), (9002, ""), (9003, "the of"), (9004, "word1 " * 30_000)]
    docs += [(7000 + i, "word300 word301 copy") for i in range(900)]
    queries = spark.createDataFrame([(1, "word300 word399 word5"), (2, "word1"), (3, "unknown"), (4, "the"), (5, None), (6, "copy word300 word300"), (7, "word250 word251 word252 word0")], "item_id long, text string")
    index = text_index.write(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/t")
    found, plan = index.searched(queries, 5)
    got = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()]
    assert got == scores_by_force(spark, docs, queries)
    read = {r.query: (r.all, r.read) for r in plan.groupBy("query").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("read")).collect()}
    assert all(b <= a for a, b in read.values()) and read[7][1] < 0.6 * read[7][0], read

    changed, gone = [(5, "word300 word399 word5"), (9004, "short"), (20_000, "unknown thing")], [7000, 7001, 12, 31]
    ids = spark.createDataFrame([(i,) for i in gone], "doc_id long")
    for _ in range(2):  # an update can be run again
        index.update(spark.createDataFrame(changed, "doc_id long, text string"), ids)
        now = [d for d in docs if d[0] not in gone and d[0] not in {c[0] for c in changed}] + changed
        got = [tuple(r) for r in index.search(queries, 5).select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()]
        assert got == scores_by_force(spark, now, queries)


def test_text_index_that_loses_all_its_documents(spark, tmp_path):
    index = text_index.write(spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string"), f"file://{tmp_path}/t")
    queries = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert index.search(queries, 5).count() == 2
    nothing = spark.createDataFrame([], "doc_id long, text string")
    index.update(nothing, spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))
    assert index.search(queries, 5).count() == 0 and index.lengths().count() == 0
    index.update(spark.createDataFrame([(7, "gamma rays")], "doc_id long, text string"))
    assert [r.doc_id for r in index.search(queries, 5).collect()] == [7]
    assert text_index.write(nothing, f"file://{tmp_path}/n").search(queries, 5).count() == 0


def test_hybrid_search_is_an_and_filter(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(["alpha"] * (i % 2) + ["beta"] * (i % 3 == 0) + ["gamma"])) for i in range(120)]
    vectors = {i: rng.standard_normal(4) for i, _ in docs}
    index = text_index.write(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/t")
    asked = spark.createDataFrame([(1000, "alpha beta", [1.0, 0.0, 0.0, 0.0]), (1001, "gamma", [0.0, 1.0, 0.0, 1.0]), (1002, "delta", [1.0, 1.0, 0.0, 0.0]), (1003, "the", [1.0, 0.0, 0.0, 0.0])], "query_id long, text string, embedding array<double>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "chunk_id long, embedding array<double>")
    got = [(r.query_id, r.chunk_id, r.score) for r in R.vector_top(asked, chunks, 4, "query_id", "chunk_id", rows=16, allowed=text_index.containing(index, asked)).orderBy("query_id", "rank").collect()]
    want = []
    for q, words, v in ((1000, {"alpha", "beta"}, [1, 0, 0, 0]), (1001, {"gamma"}, [0, 1, 0, 1])):
        cos = {i: round(float(vectors[i] @ v / np.linalg.norm(vectors[i]) / np.linalg.norm(v)), 4) for i, t in docs if words <= set(t.split())}
        want += [(q, i, s) for i, s in sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert got == want


def test_a_task_makes_the_postings_of_one_part(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("copy word"), F.col("id") % 7).alias("text"))
    ranges = 5 * text_index.PART_RANGES
    lengths, postings = text_index._postings(docs, ranges, "doc_id", "text")
    for d in (lengths, postings):
        held = d.select("part", F.spark_partition_id().alias("task")).distinct().collect()
        assert sorted(r.part for r in held) == list(range(5)) and len({r.task for r in held}) == 5


def moved(spark, run):
    """Rows that the stages of a call have written for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = so_far()
    run()
    return sum(n for k, n in so_far().items() if k not in before)


def test_updates_and_searches_move_blocks_and_not_postings(spark, tmp_path):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("word"), i)), " ")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), words.alias("text"))
    index = text_index.write(docs, f"file://{tmp_path}/t")
    blocks = index.blocks().count()
    assert blocks == 63 * 40
    assert moved(spark, lambda: index.update(docs.where("doc_id % 100 = 0"), docs.where("doc_id % 100 = 1"))) < 6 * blocks  # 160,000 postings
    queries = spark.createDataFrame([(i, "word1 word2 word3") for i in range(20)], "item_id long, text string")
    assert moved(spark, lambda: index.search(queries, 5).collect()) < 6 * blocks  # 80,000 scores
    assert index.lengths().count() == 3960


def test_a_task_scores_a_bounded_number_of_documents(spark):
    n = 6 * R.TASK_DOCS
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha word"), F.col("id") % 7).alias("text"))
    queries = spark.createDataFrame([(1, "alpha word3"), (2, "word5 alpha")], "item_id long, text string")
    held = R.text_scores(docs, queries, scorer="bm25").groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("doc_id").alias("n")).collect()
    assert sum(r.n for r in held) == n  # all scores of a document in one task
    assert max(r.n for r in held) < 1.5 * R.TASK_DOCS


def test_text_of_many_links_is_stripped_in_one_pass(spark):
    d = spark.createDataFrame([("word [link](a) ![pic](b) " * 10_000 + "[open",)], "t string")
    began = time.time()
    got = d.select(P.stripped_markdown(F.col("t")).alias("t")).first().t
    assert got == ("word link  " * 10_000 + "[open") and time.time() - began < 30


def test_odd_characters_are_counted_whatever_their_number(spark):
    rows = [("a" * 95 + "\x01" * 5,), ("a" * 90 + "�" * 10,), ("a" * 91 + "\x0b\x1f\x00" * 3,), ("a" * 49,), (None,)]
    got = [r.ok for r in spark.createDataFrame(rows, "t string").select(X.readable(F.col("t")).alias("ok")).collect()]
    assert got == [True, False, True, False, None]


def test_rows_are_placed_in_steps_of_bounded_size(spark):
    for lists, probes in ((1, 1), (4096, 1), (4096, 3482)):
        n = vector_index.rows_at_once(lists, probes)
        assert n >= 1 and n * lists <= 2_000_000 and n * probes <= 32_768
    d = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id long, embedding array<double>").coalesce(1)
    pivots = np.array([[float(i % 7), 1.0 + i // 7] for i in range(4000)])
    got = vector_index.placed(d, pivots, 3400).groupBy("id").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()
    assert sorted((r.id, r.n, r.last) for r in got) == [(i, 3400, 3400) for i in range(50)]
