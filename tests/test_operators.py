"""Operators that SQL does not cover, against plain Python, and small cases of the others."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import arrays as A
from tarnfold.functions import text as X
from tarnfold.operators import catalogue as C
from tarnfold.operators import chunking, evaluation, ingest, replay
from tarnfold.operators import retrieval as R
from tarnfold.sources import files, routes


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<long>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given,want", [((0, 0), (1, 10)), ((-1, 0), (1, 10)), ((5, 20), (5, 20)), ((1, 200), (1, 100)), ((3, 15), (3, 15))])
def test_page(given, want):
    assert C.page(*given) == want


def test_text_functions(spark):
    x = F.col("t")
    assert one(spark, X.half_width(x), t="ＡＢＣ１２３") == "ABC123"
    assert one(spark, X.clean_markdown(x), t="# h\n**b** [链接](u) ![i](u)\n\n\n\n~~s~~ ") == "# h\nb 链接 \n\ns"
    assert one(spark, X.readable(x), t="文" * 25 + "x" * 50) is True
    assert one(spark, X.readable(x), t="abc") is False
    assert one(spark, X.bigrams(x), t="a") == []
    assert one(spark, X.bigrams(x), t="abab") == ["ab", "ba"]
    assert one(spark, X.pieces(x), t="abcdefgh") == ["abc", "def", "gh"]
    assert one(spark, X.pieces(x), t="") == []
    assert one(spark, X.without_page_numbers(x), t="a\n - 12 - \nb 3\n7") == "a\nb 3"
    assert one(spark, X.without_contents_lines(x), t="a ..... 3\nb") == "b"
    assert one(spark, X.merged_lines(x), t="ab\ncd.\n\nEf") == "abcd.\n\nEf"
    assert one(spark, X.fixed_chunks(x, 4, 1), t="abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, X.fixed_chunks(x, 4, 1), t="") == [""]
    assert one(spark, X.without_fence(x), t="```json\n{}\n```") == "{}"
    assert one(spark, X.without_repeating_lines(x), t="h\na\n\nh\n\nb\nh\n\n") == "a\n\n\nb\n\n"
    assert one(spark, X.text_to_markdown(x), t="a\nb\n\n \n\nc") == "a  \nb\n\nc"
    assert one(spark, X.cleaned_answer(x, 5), t=" a [TRANSFER:qa]\u3000 bcdefg") == "a bcd..."
    assert one(spark, X.cleaned_answer(x, 30), t="[TRANSFER:human] b[TRANSFER:customer_service]\x85c\u200b ") == "[TRANSFER:human] b c\u200b"
    assert one(spark, X.text_to_markdown(x), t="\n\na\n \nb\n\n\u3000\n\nc") == "a  \n   \nb\n\nc"
    assert one(spark, X.cache_key(x), t="闭包\u3000的原理\u00a0") == one(spark, X.cache_key(x), t="闭包 原理") == "闭包 原理"


def test_sets_and_ranks(spark):
    r, k = F.col("r"), F.col("k")
    assert one(spark, A.precision_at(r, k, 2), r=[1, 1, 2], k=[1]) == 1.0
    assert one(spark, A.recall_at(r, k, 3), r=[1, 2, 3], k=[]) == 0.0
    assert one(spark, A.hit_at(r, k, 2), r=[5, 6, 1], k=[1]) is False
    assert one(spark, X.jaccard(r, k), r=[], k=[]) == 0.0


def test_limiter_is_a_fold(spark):
    rng = random.Random(3)
    data = sorted((k, rng.randrange(0, 600)) for k in "abc" for _ in range(300))
    want, log, last = [], [], None
    for k, s in data:
        log = [] if k != last else [x for x in log if x > s - 60]
        last = k
        ok = len(log) < 5
        if ok and s not in log:
            log.append(s)
        want.append((k, s, ok))
    got = replay.admitted(spark.createDataFrame(data, "k string, s long").repartition(7), "k", "s", 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def packed(text, most):
    out, buf = [], ""
    for p in text.split("\n\n"):
        p = p.strip()
        if p and (not buf or len(buf) + len(p) < most):
            buf += p + "\n\n"
        elif p:
            out.append(buf.strip())
            buf = p + "\n\n"
    return [*out, buf.strip()] if buf.strip() else out


def chunks_of(text, least, most):
    import re

    found, stack, heads = [], [], []
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if m:
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2].strip()))
            heads.append((level, " > ".join(t for _, t in stack), []))
        elif heads:
            heads[-1][2].append(line)
    if not heads:
        return [("", p) for p in packed(text, most)]
    for i, (level, path, body) in enumerate(heads):
        if i + 1 < len(heads) and heads[i + 1][0] > level:
            continue
        content = re.sub(r"(?m)^#{1,6}\s+", "", "\n".join(body)).strip()
        if content:
            found += [(path, p) for p in (packed(content, most) if len(content) > most else [content])]
    out = []
    for path, p in found:
        if out and len(out[-1][1]) < least:
            out[-1] = (path or out[-1][0], out[-1][1] + "\n\n" + p)
        else:
            out.append((path, p))
    return out


def chunked(df, **sizes):
    got = {}
    for r in chunking.structural_chunks(df, **sizes).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.path, r.text))
    return got


def test_structural_chunks(spark):
    rng = random.Random(5)
    docs = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(0, 25)):
            kind = rng.random()
            lines.append("#" * rng.randrange(1, 5) + f" t{rng.randrange(9)}" if kind < 0.25 and i % 5 else "" if kind < 0.45 else rng.choice([" ", "\u3000", "## ", "\t"]) if kind < 0.55 else "w" * rng.randrange(1, 40))
        docs.append((i, "\n".join(lines)))
    docs += [(100, "# a\n" + "x" * 30 + "\n\n" + "y" * 28), (101, "# a\n" + "x" * 31 + "\n\n" + "y" * 28), (102, "# a\n" + "x" * 10 + "\n\n\n\n\n" + "y" * 9), (103, "p" * 40 + "\n \n" + "q" * 40), (104, ""), (105, None), (106, "# only\n"), (107, "a\n\nb\n\n" + "c" * 70)]
    assert chunked(spark.createDataFrame(docs, "doc_id long, text string"), least=20, most=60) == {i: c for i, t in docs if (c := chunks_of(t or "", 20, 60))}


def test_chunks_of_pages(spark):
    """The query's own rows, all pages of the smallest tables."""
    d = files.page_articles(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    want = {r.doc_id: c for r in d.collect() if (c := chunks_of(r.text, 300, 800))}
    assert chunked(d) == want and len(want) == 50


def test_loops_need_three_alike(spark):
    d = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "abcdef"), (1, 3, "abcdef "), (2, 1, "abc"), (2, 2, "xyz"), (2, 3, "abc")], "r long, s long, t string")
    got = {(r.r, r.s): r.looping for r in replay.loops(d, "r", "s", "t").collect()}
    assert [k for k, v in got.items() if v] == [(1, 3)]


def test_rules(spark):
    call = "array<struct<seq:long,tool:string,args:string,error_code:string,recoverable:boolean>>"
    rows = [("t1", "我要这个", "", True, [(1, "purchase", "{}", None, False), (2, "purchase", "{}", None, False)], ["get_orders"], [], 1), ("t2", "hi", "x" * 501, False, [(1, "a", '{"query":""}', "E", True), (2, "b", "{}", None, False)], [], ["b"], 0), ("t3", "hi", None, True, [], [], [], 3)]
    d = spark.createDataFrame(rows, f"task_id string, input string, answer string, has_access boolean, calls {call}, required array<string>, forbidden array<string>, max_steps int")
    failed = {}
    for r in evaluation.scored(d).where("not passed").collect():
        failed.setdefault(r.task_id, set()).add(r.rule)
    assert failed == {"t1": {"required_tool", "max_steps", "purchase_before_check"}, "t2": {"forbidden_tool", "full_content_leak", "invalid_args"}}
    odd = [("t4", "hello, buy", "", True, [(1, "get_orders", '{"query":" "}', "", True), (2, "purchase", '{"material_id":0,"material_ids":[]}', "NOT_FOUND", True)], [], [], 0)]
    got = Counter((r.rule, r.detail) for r in evaluation.scored(spark.createDataFrame(odd, d.schema)).where("not passed").collect())
    assert got == Counter([("purchase_before_check", "no check"), ("premature_purchase", "not asked for"), ("invalid_args", "query"), ("invalid_args", "material_id"), ("invalid_args", "material_ids")])
    assert {r.task_id: r.passed for r in evaluation.verdicts(evaluation.scored(d)).collect()} == {"t1": False, "t2": False, "t3": True}


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    get = lambda d: sorted(map(tuple, d.select("k", "v").collect()))
    assert get(C.upserted(base, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert get(C.found_or_created(base, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert get(C.updated(base, new, "k")) == [(1, "a"), (2, "B")]
    assert get(C.deleted(base, new, "k")) == [(1, "a")]
    assert [get(x) for x in ingest.to_load(new, base, ["k"])] == [[(3, "c")], [(1, "a"), (2, "b")]]
    assert [get(x) for x in ingest.to_load(new, base, ["k"], force=True)] == [[(2, "B"), (3, "c")], [(1, "a")]]


def test_fusion_keeps_one_sided(spark):
    kind = "q long, c long, score double, rank int"
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 5, 0.3, 1), (2, 4, 0.3, 2)], kind)
    b = spark.createDataFrame([(1, 11, 7.5, 1), (3, 8, 2.0, 1)], kind)
    got = [(r.q, r.c, r["rank"], r.score, r.vector_score, r.text_score, r.rrf_score) for r in R.fused(a, b, "q", "c", 5).orderBy("q", "rank").collect()]
    x, y = round(1 / 62 + 1 / 61, 8), round(1 / 61, 8)
    assert got == [(1, 11, 1, x, 0.8, 7.5, x), (1, 10, 2, y, 0.9, None, y), (2, 5, 1, 0.3, 0.3, None, None), (2, 4, 2, 0.3, 0.3, None, None), (3, 8, 1, y, None, 2.0, y)]


def test_labels_come_from_comparable_scores(spark):
    d = spark.createDataFrame([(1, 0.8, 0.1), (2, None, 0.75), (3, None, 0.5), (4, 0.2, 0.9), (5, None, None)], "i long, rerank_score double, vector_score double")
    assert [r.x for r in d.orderBy("i").select(R.confidence().alias("x")).collect()] == ["高", "高", "中", "低", "低"]


def test_python_functions_run_in_any_folder(tmp_path):
    """Executors find the package though nothing but the driver's own path names it."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("cosine_topk", "rate_limiter", "pages_links"):
    assert e.queries()[name](s, "/root/testdata/sf0.001").count() > 0, name
print("ALL RAN")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ALL RAN" in ran.stdout, ran.stderr[-2000:]


def test_pages_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<html><head><title>T</title><script>x</script></head><body><nav><a href="/n">n</a></nav><article><h1>H</h1><p>a <b>b</b></p></article></body></html>'), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in files.page_articles(pages).collect()}
    assert (got[1].title, got[1].markdown, got[1].links) == ("T", "# H\n\na **b**", []) and got[2].markdown == ""
    html = '<body><p>out</p><div class="sidebar x"><a href="/a"> A </a><a href="/b"></a><a href="/a">again</a></div><div class="content">in<br><div class="ads">no</div><nav>no</nav> <p>more</p></div><main>second</main></body>'
    r = files.page_articles(spark.createDataFrame([(1, html)], pages.schema)).first()
    assert r.markdown == "in\n\n\nmore".replace("\n\n\n", "\n\n") and [tuple(x) for x in r.links] == [("/a", "A")]
    (tmp_path / "a.md").write_text("# x\ny")
    assert [r.text for r in files.text_files(spark, f"file://{tmp_path}/*.md").collect()] == ["# x\ny"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert sorted((r.text or "") for r in files.docx_files(spark, f"file://{tmp_path}/*.docx").collect()) == ["", "one two\nthree\n"]
    base, href = F.col("b"), F.col("h")
    assert [one(spark, X.resolved(href, base), b="http://h/x/y.html", h=h) for h in ("http://z/", "/q", "w.html")] == ["http://z/", "http://h/q", "http://h/x/w.html"]


def test_samples_follow_quotas(spark):
    d = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id long, s string")
    got = {r.s: r["count"] for r in evaluation.sampled(d, "s", "id", 10).groupBy("s").count().collect()}
    assert got == {"a": 8, "b": 1}


def test_questions_and_answers(spark):
    text = "intro\n## Q1: first?\nnot yet\n**追问：early**\nof early\n## Q2: second?\n**参考回答：**\na\n\n**追问：inner**\nb\n---\nlost\n**Q: extra?**\nc\n---\n### skipped\nd\n**追问：own**\n## part\ne\r\n"
    got = [(r.n, r.question, r.answer) for r in routes.questions(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()]
    assert got == [(1, "Q1: first?", ""), (2, "early", "of early"), (3, "Q2: second?", "a\n\n\n追问：innerb"), (4, "extra?", "c\nd"), (5, "own", "e")]


def test_cache_keys_of_particles_and_marks(spark):
    f = lambda s: one(spark, X.cache_key(F.col("s")), s=s)
    assert f("闭包和原理") == f("闭包 原理") == f("《闭包》的“原理”".replace("“", '"').replace("”", '"')) == "闭包 原理" and f("呀嘛") == "呀嘛"


def test_searched_requests_fill_the_caches(spark):
    asked = spark.createDataFrame([(1, 7, "of lists and trees", [1.0, 0.0], True), (2, 7, "lists", [1.0, 0.1], True), (3, 8, "trees", [0.0, 1.0], False), (4, 7, "words alone", None, False)], "request_id long, course_id long, text string, embedding array<float>, has_access boolean")
    chunks = spark.createDataFrame([(10, 7, "lists of words", [1.0, 0.0]), (11, 7, "trees", [0.0, 1.0]), (12, 8, "trees", [0.0, 1.0]), (13, 8, "none here", None)], "chunk_id long, course_id long, text string, embedding array<float>")
    results = "array<struct<chunk_id:long,score:double>>"
    now = F.lit("2024-01-01").cast("timestamp")
    exact = spark.createDataFrame([], f"key string, results {results}, expires_at timestamp")
    recent = spark.createDataFrame([], f"course_id long, access string, entry_id long, ts timestamp, cached_vector array<float>, results {results}")
    first = R.search(asked, chunks, R.Config(k=2, scorer="bm25"), exact, recent, now)
    got = {(r.request_id, r["rank"]): (r.chunk_id, r.via) for r in first.results.collect()}
    assert got[1, 1] == (10, "search") and got[3, 1] == (12, "search") and {k for k, _ in got.values()} == {10, 11, 12} and (4, 1) in got
    late = now + F.expr("INTERVAL 30 MINUTES")
    again = R.search(asked.where("request_id = 1").unionByName(spark.createDataFrame([(5, 7, "anything", [1.0, 0.05], True), (6, 7, "anything", [1.0, 0.05], False)], asked.schema)), chunks, R.Config(k=2), first.exact, first.recent, late)
    via = {r.request_id: r.via for r in again.results.collect()}
    assert via == {1: "exact", 5: "similar", 6: "search"}  # another access level has a pool of its own
    assert [r.request_id for r in R.search(asked.where("request_id = 1"), chunks, R.Config(k=2), first.exact, recent, now + F.expr("INTERVAL 2 HOURS")).results.where("via = 'exact'").collect()] == []


def test_vectors_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(5)] if i % 11 else None) for i in range(200)] + [(500, 0, [0.0] * 5), (501, 1, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "i long, g int, v array<double>")

    def cos(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if len(a) == len(b) and norm else 0.0

    for on in (None, "g"):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in R.vector_top(d.where("i % 10 = 0"), d, 4, "i", "i", "v", on=on, rows=16).collect()}
        want = {}
        for i, g, v in rows:
            if v is not None and i % 10 == 0:
                near = sorted((-round(cos(v, w), 4), k) for k, h, w in rows if w is not None and k != i and (on is None or g == h))
                want |= {(i, n): (k, -s) for n, (s, k) in enumerate(near[:4], 1)}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_sheet_and_traces_are_written(spark, tmp_path):
    d = spark.createDataFrame([(2, "q,2", 'a "x"\ny'), (1, "q1", "a1")], "n long, question string, answer string")
    files.write_sheet(d, f"file://{tmp_path}/sheet", ["n"])
    assert [tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(f"file://{tmp_path}/sheet").select("no", "question").orderBy("no").collect()] == [("1", "q1"), ("2", "q,2")]
    traces = spark.createDataFrame([("t1", 1), ("t2", 2)], "task_id string, n long")
    files.write_by_task(traces, f"file://{tmp_path}/traces")
    files.write_by_task(traces.where("task_id = 't1'").withColumn("n", F.lit(9)), f"file://{tmp_path}/traces")
    assert {(r.task_id, r.n) for r in spark.read.json(f"file://{tmp_path}/traces").collect()} == {("t1", 9), ("t2", 2)}


def test_percentiles_of_ties(spark):
    d = spark.createDataFrame([("a", float(x)) for x in [1, 1, 1, 1, 2, 3, 3, 9, 9, 10]] + [("b", 5.0), ("c", None)], "k string, v double")
    assert {r.k: (r.p50, r.p95, r.p99) for r in evaluation.percentiles(d, ["k"], "v").collect()} == {"a": (3.0, 10.0, 10.0), "b": (5.0, 5.0, 5.0)}


def test_files_of_a_tree(spark):
    rows = [("a.md", "blob", "x"), ("docs/b.md", "blob", "y" * (512 * 1024 + 1)), ("docs/c.md", "blob", "z"), ("docs/vendor/d.md", "blob", ""), ("e/f.md", "blob", ""), ("docs", "tree", "")]
    assert [r.path for r in routes.wanted_files(spark.createDataFrame(rows, "path string, type string, content string")).orderBy("path").collect()] == ["a.md", "docs/c.md"]
