"""Batches, retries, dead letters and restarts; ground truth; pages read one by one; numbers without one task."""

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import generation
from tarnfold.operators.retrieval import Config
from tarnfold.sources import files, routes


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_in_the_order_of_all_rows(spark, partitions):
    d = spark.range(0, 500).select(((F.col("id") * 37) % 500).alias("k"), F.lit("x").alias("v"))
    got = generation.numbered(d, ["k"], partitions=partitions).collect()
    assert sorted((r.no, r.k) for r in got) == [(i + 1, i) for i in range(500)]
    assert generation.numbered(d.limit(0), ["k"]).count() == 0


def test_a_failing_model_leaves_dead_letters_and_a_restart_repeats_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(100, 157)], "chunk_id long, text string")
    seen = f"{tmp_path}/seen"

    def model(bad, short=()):
        def ask(texts):
            with open(seen, "a") as f:
                f.write(texts[0] + "\n")
            if texts[0] in bad:
                raise RuntimeError("no answer")
            return [f"Q of {t}" if t != "text 103" else " " for t in texts][: len(texts) - (texts[0] in short)]

        return ask

    g = generation.Generation(spark, f"file://{tmp_path}/g")
    assert g.run(chunks, model({"text 110"}, {"text 150"})) == 6
    want = {(f"Q{i - 99:03d}", i, f"Q of text {i}") for i in range(100, 157) if i != 103}
    broken = {*range(110, 120), *range(150, 157)}
    assert {tuple(r) for r in g.questions().collect()} == {w for w in want if w[1] not in broken}
    assert {(r.batch, r.tries, r.error) for r in g.dead().collect()} == {(2, 2, "RuntimeError: no answer"), (6, 2, "ValueError: 6 answers to 7 texts")}
    asked = open(seen).read().split("\n")
    assert asked.count("text 110") == asked.count("text 150") == 2 and asked.count("text 100") == 1
    assert g.run(chunks, model({"text 150"})) == 2
    assert {r.batch for r in g.dead().collect()} == {6}
    assert g.run(chunks, model(set())) == 1 and g.dead().count() == 0
    assert {tuple(r) for r in g.questions().collect()} == want and g.questions().count() == len(want)
    assert open(seen).read().split("\n").count("text 100") == 1 and g.run(chunks, model(set())) == 0


def test_ground_truth_takes_in_what_the_judge_finds(spark):
    texts = {1: "lists of words", 2: "trees and words", 3: "nothing here", 4: "trees trees"}
    chunks = spark.createDataFrame([(i, t, [float(i), 1.0]) for i, t in texts.items()], "chunk_id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(7, "words", [1.0, 1.0]), (8, "trees", [4.0, 1.0])], "query_id long, text string, embedding array<double>")
    truth = spark.createDataFrame([(7, 1), (7, 1), (8, 3)], "query_id long, chunk_id long")

    def judge(pairs):
        assert ("words", texts[1]) not in pairs  # known
        return [q in t for q, t in pairs]

    got = sorted(tuple(r) for r in generation.expanded(queries, chunks, truth, judge, 4, Config(text=True)).collect())
    assert got == [(7, 1, "given"), (7, 2, "found"), (8, 2, "found"), (8, 3, "given"), (8, 4, "found")]


def test_pages_are_read_one_by_one(spark):
    rows = [("a", b"one|two|three"), ("b", b"bad|last"), ("c", b"!broken"), ("d", b""), ("e", b"bad|bad")]
    d = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")

    def pages(content):
        if content.startswith(b"!"):
            raise OSError("damaged")
        return content.split(b"|") if content else []

    def recognise(image):
        if image == b"bad":
            raise ValueError("unreadable")
        return image.decode().upper()

    texts, quarantine = routes.recognised(d, pages, recognise)
    assert sorted(map(tuple, texts.collect())) == [("a", "ONE\nTWO\nTHREE"), ("b", "LAST")]
    assert sorted((r.path, -1 if r.page is None else r.page, r.error) for r in quarantine.collect()) == [("b", 0, "ValueError: unreadable"), ("c", -1, "OSError: damaged"), ("d", -1, "no pages"), ("e", 0, "ValueError: unreadable"), ("e", 1, "ValueError: unreadable")]


def test_sheet_is_numbered_through(spark, tmp_path):
    d = spark.createDataFrame([(i, f"q{i}", f'a "{i}"') for i in range(40)], "k long, question string, answer string")
    files.write_sheet(d, f"file://{tmp_path}/s", ["k"])
    got = spark.read.option("header", True).option("quote", '"').option("escape", "\\").csv(f"file://{tmp_path}/s")
    assert sorted((int(r.no), r.question) for r in got.collect()) == [(i + 1, f"q{i}") for i in range(40)]
