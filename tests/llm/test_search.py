"""Nearest neighbours, divergence audit and hard negatives against brute force, on odd rows and empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnfold.llm import ann, decontam, divergence, hard_negatives, ngram_join, spotsigs

VECTORS = "vec_id long, embedding array<float>, label int, block long, score double, node long, rank int, tile long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 0.5, 2, 3, 4) for i, v, label in rows], VECTORS)


def odd_vectors(n, dims=16, seed=1):
    """Unit vectors in clusters, near and exact copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, dims))
    x = (centres[rng.integers(0, 7, n)] + 0.7 * rng.standard_normal((n, dims))).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # a sixth of all rows is one vector
    x[5:9] = x[4] + np.float32(1e-3)
    rows = [(i, x[i].tolist(), int(rng.integers(0, 10))) for i in range(n)]
    rows += [(None, x[1].tolist(), 1), (n * 100, None, 2), (n * 100 + 100, [0.0] * dims, 3), (n * 100 + 200, [1.0] * (dims - 1) + [None], 4), (n * 100 + 300, [math.nan] + [1.0] * (dims - 1), 5)]
    rows += [(n * 100 + 400, [math.inf] + [1.0] * (dims - 1), 6), (n * 100 + 500, x[3].tolist(), None), (n * 100 + 600, [], 7), rows[2], rows[2]]
    return rows


def taking_part(rows):
    ok = [(i, v, label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return list({r[0]: r for r in ok}.values())


def nearest_by_force(rows, k, every):
    rows = [r for r in taking_part(rows) if any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([np.asarray(r[1], np.float32).astype(float) for r in rows])
    want = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, d)) if j != q][:k]
        want[int(ids[q])] = [(int(ids[j]), d[j]) for j in o]
    return want


def test_nearest_neighbours_of_members(spark):
    rows = odd_vectors(3000)
    got = defaultdict(list)
    for r in sorted(ann.searched(vectors_of(spark, rows), 10, 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    want = nearest_by_force(rows, 10, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 11)) and q not in [i for i, _, _ in found]
        exact = {i: d for i, d in want[q]}
        assert all(abs(s - exact[i]) < 1e-9 for i, s, _ in found if i in exact)
        assert [(s, i) for i, s, _ in found] == sorted((s, i) for i, s, _ in found)
        hits += len({i for i, _, _ in found} & set(exact))
    assert hits >= 0.95 * 10 * len(want)


def test_nearest_neighbours_of_few_rows_are_exact(spark):
    rows = odd_vectors(20)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.searched(vectors_of(spark, rows), 10, 2).collect())
    want = [(q, rank, i) for q, found in nearest_by_force(rows, 10, 2).items() for rank, (i, _) in enumerate(found, 1)]
    assert got == sorted(want)
    assert [(r.query_id, r.vec_id) for r in ann.searched(vectors_of(spark, [(0, [1.0], 1), (7, [2.0], 1)]), 10).collect()] == [(0, 7)]
    for none in ([], [(0, [0.0], 1)], [(0, [1.0], 1)], [(1, [1.0], 1)]):
        assert ann.searched(vectors_of(spark, none)).count() == 0


def test_nearest_neighbours_of_vectors_from_outside(spark):
    rows = odd_vectors(1500, seed=4)
    index = ann.build(vectors_of(spark, rows), 5)
    asked = np.random.default_rng(9).standard_normal((20, 16)).astype(np.float32)
    found = ann.nearest(index, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>"), 5).collect()
    kept = [r for r in taking_part(rows) if any(r[1])]
    ids, x = np.array([r[0] for r in kept]), np.array([np.asarray(r[1], np.float32).astype(float) for r in kept])
    hits = 0
    for i, v in enumerate(asked):
        d = np.sqrt(((x - v.astype(float)) ** 2).sum(1))
        hits += len({int(ids[j]) for j in np.lexsort((ids, d))[:5]} & {r.vec_id for r in found if r.query_id == i})
    assert hits >= 0.9 * 100


# --- divergence


def audit_by_force(rows, least, top):
    docs = [(lang or "", source or "", re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, t) for la, s, t in docs if la == lang]
        df, total, by = Counter(), Counter(), defaultdict(Counter)
        for s, t in own:
            df.update(set(t))
            total.update(t)
            by[s].update(t)
        kept = [t for t in df if df[t] >= least]
        sources, v = sorted({s for s, _ in own}), len(kept)
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(by[s][t], sum(by[s][x] for x in kept)) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total[x] for x in kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, i) for part, found in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, 2, "x", "y") for i, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, rank int, term string, part string")


def test_audit_against_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    rows = [(t, ["en", "de", None, ""][i % 4], ["s1", "s2", "Z", "ß", None][int(rng.integers(0, 5)) if i % 3 else 0]) for i, (_, t) in enumerate(odd * 3)]
    rows += [("A" * 9 + " b" * 400_000 + " c" * 10, "en", "long"), (None, "xx", "one"), ("word", "yy", "a"), ("word", "yy", "b"), (None, "yy", None)]
    rows += [("the same words again, the same", "zz", f"g{i % 3}") for i in range(40)]
    for least, top in ((10, 10), (1, 3)):
        got = sorted(tuple(r) for r in divergence.audited(audit_rows(spark, rows), least, top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == audit_by_force(rows, least, top)
    assert divergence.audited(audit_rows(spark, rows).limit(0)).count() == 0
    assert divergence.audited(audit_rows(spark, [("", "en", "a"), (None, None, None)])).count() == 0


def test_a_shared_path_is_corrected_once(monkeypatch):
    """Three rows through one node of a, b: one combination with the multiplicities' sum, and one for each different end."""
    item = lambda r, p: {"rank": r, "p": p, "p0": 10 * r}
    paths = [[item(1, 100), item(2, 300)], [item(1, 100), item(2, 300), item(3, 5)], [item(1, 100), item(2, 300), item(3, 900)], [item(2, 300)]]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3 + ["zz"], "path": paths, "m": [4, 2, 1, 9]}, pa.schema([("lang", pa.string()), ("path", pa.list_(pa.struct([("rank", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))), ("m", pa.int64())]))
    times = []
    monkeypatch.setattr(divergence, "_apart", lambda p, q: times.append(p.size) or (p - q) * (p - q) // (p + q))
    got = {(r["lang"], r["a"], r["b"]): r["value"] for b in divergence._tree(batch) for r in b.to_pylist()}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    fix = lambda a, b: f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"])
    x, y, z = item(1, 100), item(2, 300), (item(3, 5), item(3, 900))
    assert got == {("en", 1, 2): 7 * fix(x, y), ("en", 1, 3): 2 * fix(x, z[0]) + fix(x, z[1]), ("en", 2, 3): 2 * fix(y, z[0]) + fix(y, z[1])}
    assert sum(times) // 4 <= 1 + 4


# --- hard negatives


def negatives_by_force(rows, every, k, n):
    part = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in taking_part(rows) if label is not None]
    out = []
    for i, label, v in part:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for j, other, w in part if j != i)  # an empty vector counts as zeros
        for s, j, _ in [x for x in scored if x[2]][:k]:
            fit = [(t, m) for t, m, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:n]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("tile, block", [(8192, 8192), (70, 40)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = odd_vectors(700, dims=12, seed=3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.mined(vectors_of(spark, rows), 10, 5, 3).collect())
    assert got == negatives_by_force(rows, 10, 5, 3) and len(got) > 500


def test_hard_negatives_of_odd_tables(spark):
    for none in ([], [(50, None, 1)], [(50, [1.0], None)], [(50, [1.0], 1)], [(0, [1.0], 1), (3, [1.0], 1)]):
        assert hard_negatives.mined(vectors_of(spark, none)).count() == 0
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.9, 0.5], 2), (53, [0.9, 0.5], 3), (54, [0.4, 0.0], 2), (55, [-1.0, 0.0], 2)]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.mined(vectors_of(spark, rows)).collect()) == negatives_by_force(rows, 50, 5, 3) == [(50, 51, 1, 52, 65536, 58880), (50, 51, 2, 53, 65536, 58880)]


def test_boxes_prune_rows_outside_the_window(monkeypatch):
    """Rows along one line: only leaves whose interval meets the window are scored."""
    v = np.stack([np.arange(4096), np.zeros(4096, int)], 1)
    t = pa.table({"vec_id": np.arange(4096), "label": np.full(4096, 2), "v": pa.array(v.tolist())})
    q = pa.table({"query": [7], "own": [-1], "label": [1], "least": [1000], "most": [1100], "v": [[1, 0]]})
    row = {**hard_negatives._tile(t, 0).to_pylist()[0], **hard_negatives._block(q, 0).to_pylist()[0]}
    scored = []
    product = hard_negatives._product
    monkeypatch.setattr(hard_negatives, "_product", lambda a, b: scored.append(len(b)) or product(a, b))
    query, score, ids = hard_negatives._search(row, 3, False)
    assert (query.tolist(), score.tolist(), ids.tolist()) == ([7] * 3, [1100, 1099, 1098], [1100, 1099, 1098])
    assert sum(scored[8:]) <= 2 * hard_negatives.LEAF  # after the bounds of two levels


# --- fingerprint search


def test_signature_search_against_brute_force(spark, docs_of, odd):
    docs = docs_of(odd)
    asked = docs.where("doc_id is null or doc_id % 10 < 6")
    sets = lambda d: [(r.doc_id, frozenset(r.sigs)) for r in spotsigs.with_signatures(d.selectExpr("doc_id", "coalesce(text, '') text"), "text", "sigs").collect()]
    least = lambda ids: min([i for i in ids if i is not None], default=None)
    named = lambda rows: {s: (least([i for i, t in rows if t == s]), sum(t == s for _, t in rows)) for _, s in rows}
    q, d = named(sets(asked)), named(sets(docs))
    for threshold in (0.75, 0.5):
        want = Counter((q[a][0], d[b][0], round(len(a & b) / len(a | b), 9), q[a][1], d[b][1]) for a in q for b in d if len(a & b) >= threshold * len(a | b))
        got = Counter((r.query_id, r.doc_id, round(r.likeness, 9), r.queries, r.documents) for r in spotsigs.linked(asked, docs, threshold).collect())
        assert got == want and len(want) > 20
    assert spotsigs.linked(docs.limit(0), docs).count() == 0 and spotsigs.linked(docs, docs.limit(0)).count() == 0


# --- a third of all rows is one text


def test_hot_texts_in_overlaps_and_near_duplicates(spark, docs_of):
    """A third of the rows holds one benchmark passage among shared boilerplate, exactly or with a word or two changed."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(20))
    boilerplate = " ".join(f"b{rng.randrange(900)}" for _ in range(160))
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 60)))) for i in range(400)]
    rows += [(1000 + i, f"{boilerplate} {passage}") for i in range(120)] + [(2000 + i, f"{boilerplate} own{i} {passage} end{i}") for i in range(60)] + [(3000 + i, f"{boilerplate} " + " ".join(f"x{rng.randrange(4000)}" for _ in range(90))) for i in range(20)]
    bench = spark.createDataFrame([(1, passage), (2, "q1 q2 q3 q4 q5 q6"), (3, boilerplate)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.overlaps(docs_of(rows), bench).collect())
    assert got == Counter((i, item) for i, t in rows for item, p in ((1, passage), (3, boilerplate)) if p in t)

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.split()) >= 5 else {tuple(w)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    classes = {}
    for i, s in sets.items():
        classes.setdefault(frozenset(s), []).append(i)
    kinds = list(classes)
    for a, x in enumerate(kinds):
        for i in classes[x][1:]:
            root[i] = classes[x][0]  # ids ascend
        for y in kinds[:a]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(classes[x][0]), find(classes[y][0])))
                root[q] = p
    want = {i: find(i) for i in sets}
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(rows)).collect()} == want
    assert sum(c == 1000 for c in want.values()) >= 180
