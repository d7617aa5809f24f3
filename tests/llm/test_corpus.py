"""The n-gram join, removal of repeats, language model and pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import lm_score, ngram_join, suffix_dedup, textnum
from tarnfold.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def sets_of(rows):
    return [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset([tuple(w)] if w else []) for _, t in rows]


def component_ids(rows):
    sets = sets_of(rows)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        own = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(own) if own and sets[a] else i))
    return Counter(out)


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(80 if g % 2 else 4000)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.choice([1, 2, 9, 14])):
            x = list(base)
            for _ in range(rng.randrange(0, 1 + len(x) // 12)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(x)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [2048, 4])
def test_near_duplicates(docs_of, odd, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = [(i if i is None else 1000 + i, t) for i, t in odd] + near_copies(chunk)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(rows)).collect())
    assert got == component_ids(rows)


@pytest.mark.parametrize("chunk", [2048, 4])
def test_no_link_is_lost(docs_of, odd, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(i if i is None else 1000 + i, t) for i, t in odd] + near_copies(chunk + 1)
    for g in range(4):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        for k in range(14):  # some pairs link, others only through a third
            x = list(base)
            for _ in range(k % 4):
                x[rng.randrange(120)] = f"e{rng.randrange(9999)}"
            rows += [(5000 + 100 * g + k, " ".join(x))]
    sets = sets_of(rows)
    linked = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    each = Counter(x for pair in linked for x in pair)
    want = Counter((i, len(sets[k]), each[k]) for k, (i, _) in enumerate(rows))
    out = ngram_join.similar(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in out) == want
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        least[s] = min(least.get(s, math.inf), math.inf if i is None else i)
    pairs = {frozenset([sets[a], sets[b]]) for a, b in linked if sets[a] != sets[b]}
    got = ngram_join.links(docs_of(rows)).collect()
    assert Counter(tuple(sorted((r.doc_u, r.doc_v))) for r in got) == Counter(tuple(sorted(least[s] for s in p)) for p in pairs)
    assert len(pairs) > 100 and len({r["class"] for r in out if r["class"] is not None}) == len([s for s in least if s])


def test_a_hot_group_is_searched_in_bounded_parts(docs_of, monkeypatch):
    """Boilerplate in all texts puts them into one list, though few link."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    seen, fetched = [], []
    rng = random.Random(8)
    same = " ".join(f"b{i}" for i in range(80))
    rows = [(i, f"{same} " + " ".join(f"u{i}x{rng.randrange(10**6)}" for _ in range(30))) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 90, 10)]
    names, sets, maps = [], [], []
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        sets.append(np.unique(next(ngram_join.shingled(data, np.array([0, len(data)])))[0]))
        names.append(len(names))
        maps.append(ngram_join.bitmap(sets[-1]))
    import pyarrow as pa

    chunks = -(-len(rows) // 8)
    at = [k % chunks for k in range(len(rows))]
    for a in range(chunks):
        for b in range(a, chunks):
            k = [k for k in range(len(rows)) if at[k] in (a, b)]
            batch = pa.RecordBatch.from_arrays([pa.array([0] * len(k)), pa.array([a] * len(k)), pa.array([b] * len(k)), pa.array([at[x] for x in k]), pa.array([names[x] for x in k]), pa.array([len(sets[x]) for x in k]), pa.array([maps[x] for x in k])], ["hub", "a", "b", "at", "class", "n", "bits"])
            for out in ngram_join._sift(iter([batch])):
                sizes = Counter(out.column("gid").to_pylist())
                fetched += sizes.values()
                seen += out.column("class").to_pylist()
    assert fetched and max(fetched) <= 16 and sum(fetched) < chunks * len(rows) / 3  # texts; before, each outlier went to each chunk
    assert {names[k] for k in range(90, 99)} <= set(seen)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(rows)).collect())
    assert got == component_ids(rows)


def test_near_duplicates_empty(docs_of):
    assert ngram_join.near_duplicates(docs_of([(1, "a")]).where("false")).count() == 0
    got = ngram_join.near_duplicates(docs_of([(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_divide_skip_is_counting():
    rng = np.random.default_rng(3)
    for size in (50, 5000):
        for _ in range(60):
            lists = [np.unique(rng.integers(0, size, rng.integers(1, size))) for _ in range(rng.integers(1, 40))]
            least = int(rng.integers(1, len(lists) + 2))
            counts = np.bincount(np.concatenate(lists), minlength=size)
            found, n = ngram_join.divide_skip(lists, least, size)
            assert found.tolist() == np.flatnonzero(counts >= least).tolist() and n.tolist() == counts[counts >= least].tolist()


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(1, 700), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: int(len(base) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 8), dtype=np.uint64)])) for _ in range(3)]
    sets = sorted((s for s in sets if len(s)), key=len)
    sizes = np.array([len(s) for s in sets])
    pairs = {tuple(p) for p in ngram_join.may_link(sizes, [np.frombuffer(ngram_join.bitmap(s), np.uint64) for s in sets]).tolist()}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (sizes[a] + sizes[b] - n)}
    assert linked and linked <= pairs and len(pairs) < 3 * len(linked)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(-5, 300), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 130)} | {-5: -5, 300: -5}
    assert components(spark.createDataFrame(edges, "u long, v long").where("false")).count() == 0


# --- removal of repeats


def without_repeats(rows, length):
    """Rows in order of (doc_id, as given): first places of all strings, then coverage."""
    order = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    first = {}
    for i, t in order:
        b = t.encode()
        for o in range(len(b) - length + 1):
            w = b[o : o + length]
            first[w] = min(first.get(w, (i, o)), (i, o))
    covered = defaultdict(set)
    for i, t in order:
        b = t.encode()
        for o in range(len(b) - length + 1):
            if first[b[o : o + length]] != (i, o):
                covered[i].update(range(o, o + length))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        cut = covered[-1 if i is None else i]
        kept = bytes(x for k, x in enumerate(b) if k not in cut)
        gone = [k for k in range(len(b)) if k in cut]
        spans = sum(k - 1 not in cut for k in gone)
        out[i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    p = ["".join(rng.choice("ab é\n日x ") for _ in range(rng.randrange(60, 260))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(p)[rng.randrange(0, 40) :] if rng.random() < 0.5 else "".join(rng.choice("cdefgh ") for _ in range(rng.randrange(0, 150))) for _ in range(rng.randrange(1, 5)))
        rows.append((i, t))
    return [*rows, (70, "z" * 700), (71, "ab" * 300), (72, None), (73, ""), (74, "y" * 99), (75, "y" * 100), (76, "y" * 101)]


@pytest.mark.parametrize("hot", [1024, 6, 1])
def test_repeats(docs_of, odd, monkeypatch, hot):
    """Hot triggers whole, in parts, and (from HOT 1 on) window by window."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = passages(hot) + [(1000 + i if i is not None else None, t) for i, t in odd if t is None or len(t) < 20_000]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = suffix_dedup.without_repeats(docs_of([*rows, rows[5]]))
    assert Counter(tuple(r) for r in got.collect()) == without_repeats([*rows, rows[5]], 100)


def test_long_texts_are_parsed_in_segments(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefg ") for _ in range(6000))
    rows = [(1, long), (2, "x" + long[500:4500] + "y"), (3, long)]
    found = [tuple(suffix_dedup.phrases(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0][:3]) for _, t in rows]
    assert found[0] == found[2]
    assert Counter(tuple(r) for r in suffix_dedup.without_repeats(docs_of(rows)).collect()) == without_repeats(rows, 100)
    assert suffix_dedup.without_repeats(docs_of(rows).where("false")).count() == 0


def test_repeated_windows_are_those_of_sorted_ones():
    """Contexts of one trigger with all lengths before and after it, NUL bytes included."""
    rng = random.Random(7)
    core = None
    while core is None:  # 32 bytes that are a trigger, whatever is around them
        x = bytes(rng.choice(b"ab\0") for _ in range(32))
        g, _ = suffix_dedup.designated(np.frombuffer(x * 4, np.uint8), 100, 32)
        core = x if g[0] % suffix_dedup.TRIGGER == 0 else None
    ends = lambda n: bytes(rng.choice(b"a\0") for _ in range(n))
    ctx, seen, want = [], {}, set()
    for d in range(400):
        left, right = (b"\0" * 68 + ends(3))[-rng.randrange(0, 69) :], (ends(2) + b"a" * 68)[: rng.randrange(0, 69)]
        left = b"" if len(left) > 68 else left
        x = left + core + right
        if len(x) < 100:
            continue
        first = suffix_dedup._places([x], 100)[0]
        if any(suffix_dedup._places([x[k : k + 100]], 100)[0] + k != first for k in range(len(x) - 99)):
            continue  # chance gave it another trigger
        ctx.append((d, 7, x))
        for k in range(len(x) - 99):
            w = x[k : k + 100]
            if w in seen:
                want |= {(d, p) for p in range(7 + k, 107 + k)}
            seen.setdefault(w, d)
    doc, lo, data = (list(c) for c in zip(*ctx, strict=True))
    got = suffix_dedup.repeated_windows(np.array(doc), np.array(lo), data, 100)
    assert {(d, p) for d, a, b in zip(*(x.tolist() for x in got), strict=True) for p in range(a, b)} == want and len(ctx) > 50 and want


def test_kept_text(docs_of):
    t = "é" * 130 + "end"
    got = {r.doc_id: (r.kept_text, r.lang) for r in suffix_dedup.without_repeats(docs_of([(1, "a"), (2, "ü" * 49 + "b" * 60), (3, "ü" * 49 + "b" * 60 + "!")]), with_text=True, keep=["lang"]).collect()}
    assert got == {1: ("a", "en"), 2: ("ü" * 49 + "b" * 60, "en"), 3: ("!", "en")} and t


# --- language model


def test_lm(docs_of, odd):
    rows = [*odd, *((2000 + i, t) for i, t in near_copies(5))]
    docs = docs_of(rows)
    got = lm_score.scored_documents(docs).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    toks = [(i, [*words(t), None]) for i, t in rows]

    def count(keep):
        one, two = Counter(), Counter()
        for i, t in toks:
            if keep(fold(i)):
                one.update(t)
                two.update(zip([None, *t], t, strict=False))
        return one, two, sum(one.values()), len(one)

    one, two, n, v = count(lambda f: f != 2)
    k1, k2, kn, kv = count(lambda f: f not in (2, 3))
    steps = Counter()
    for i, t in toks:
        if fold(i) == 3:
            for a, b in zip([None, *t], t, strict=False):
                if k1[a]:
                    p2, p1 = k2[a, b] / k1[a], (k1[b] + 1) / (kn + kv + 1)
                    steps[int(math.log2(k1[a])), round(lm_score.STEPS * math.log2(p2 / p1)) if p2 else -(1 << 20)] += 1
    weights = lm_score.expectation_maximisation([(b, s, c) for (b, s), c in steps.items()])
    want = defaultdict(list)
    for i, t in toks:
        base = [(one[b] + 1) / (n + v + 1) for b in t]
        w = [weights[int(math.log2(one[a]))] if one[a] else 0 for a in [None, *t[:-1]]]
        full = [x * (two[a, b] / one[a] if one[a] else 0) + (1 - x) * p for x, a, b, p in zip(w, [None, *t[:-1]], t, base, strict=True)]
        want[i].append((fold(i) == 2, len(t), sum(one[b] > 0 for b in t), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert have.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(have[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])
    assert lm_score.scored_documents(docs.where("false")).count() == 0


def test_lm_messages_grow_in_line_with_blocks():
    """Rows that blocks and units send, over all levels, for 10 to 10,000 blocks of different keys."""
    rng = np.random.default_rng(3)
    sent = {}
    for blocks in (10, 100, 1000, 10_000):
        steps = lm_score.levels(blocks, blocks // 2, fan=8)
        units = [((0 << lm_score._UNIT_BITS) | b) for b in range(blocks)]
        sent[blocks] = 0
        for step in steps:
            met = set()
            for u in units:
                path, at = u >> lm_score._UNIT_BITS, u & ((1 << lm_score._UNIT_BITS) - 1)
                lo, hi = (path << 64) // step.done, ((path + 1) << 64) // step.done
                keys = np.unique(rng.integers(lo, hi - 1, 40, dtype=np.uint64, endpoint=True))
                ones = np.ones(len(keys), np.int64)
                rows = lm_score._messages(u, path, at, {n: (keys, ones, ones) for n in ("word", "pair")}, False, step)
                assert rows.num_rows <= step.ranges
                sent[blocks] += rows.num_rows
                met |= set(rows.column("unit").to_pylist())
            units = sorted(met)
        assert len({u >> lm_score._UNIT_BITS for u in units}) == len(units)  # each range has come together
        assert sent[blocks] <= 8 * blocks * len(steps) and len(steps) <= 1 + math.log(blocks, 8)


@pytest.mark.parametrize("fan", [2, 3])
def test_lm_over_many_levels(docs_of, odd, fan):
    rows = [*odd, *((2000 + i, t) for i, t in near_copies(6))]
    key = lambda r: (str(r.doc_id), r.kind, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
    one, many = (Counter(map(key, lm_score.interpolated_scores(docs_of(rows), lm_score.folds(), b, f).collect())) for b, f in ((8 << 20, 256), (20_000, fan)))
    assert one == many


def test_lm_without_training(docs_of):
    kind = F.lit(lm_score.HELD_OUT)
    r = lm_score.interpolated_scores(docs_of([(1, "a b")]), kind).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_em_finds_the_better_estimate():
    w = lm_score.expectation_maximisation([(3, 10 * lm_score.STEPS, 900), (3, -(1 << 20), 100), (5, -(1 << 20), 50)])
    assert abs(w[3] - 0.9) < 0.01 and w[5] < 0.01 and w[4] == w[3] and w[0] == 0.5


# --- hashes of words


def test_word_hashes():
    texts = ["a b", "", "  x\x0b\x0cA B\r\n", "aé z a", "b a"]
    data = [t.encode() for t in texts]
    h, first = textnum.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    got = [h[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    names = {}
    for t, x in zip(texts, got, strict=True):
        own = words(t)
        assert len(own) == len(x)
        for w, k in zip(own, x, strict=True):
            assert names.setdefault(w, k) == k
    assert len(set(names.values())) == len(names)


# --- the pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tarnfold.llm import sp_codec, stages
    from tarnfold.llm.decontam import overlaps
    from tarnfold.llm.toxicity import learned, rejected, score, with_thresholds

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    m = with_thresholds(learned(docs, labels, usable), docs, labels, usable)
    left = [(r.doc_id, r.text) for r in score(docs, m, "s").where(~rejected(m, "s")).collect()]
    least = {i: c for i, _, c in component_ids(left)}
    left = sorted((i, t) for i, t in left if least[i] == i)
    cut = {r[0]: r[4] for r in without_repeats(left, 100)}
    first, kept = set(), []
    for i, t in left:
        b, gone = t.encode(), set()
        for o in range(len(b) - 99):
            w = b[o : o + 100]
            if w in first:
                gone.update(range(o, o + 100))
            first.add(w)
        x = bytes(v for k, v in enumerate(b) if k not in gone)
        assert cut[i] == hashlib.sha256(x).hexdigest()
        kept.append((i, x.decode("utf-8", "ignore")))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in overlaps(spark.createDataFrame(kept, "doc_id long, text string"), bench).collect()}
    c = sp_codec.codec(sp_codec.default_path())
    want = sorted((i, hashlib.sha256(c.encode(t.encode()).ids.encode()).hexdigest()) for i, t in kept if i not in leaks)
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(got) > 50
    assert stages.without_benchmark(docs, bench).columns == docs.columns


def kept_texts(rows, length=100):
    """What is left of each text in order of doc_id (null ids first), where every doc_id has one text."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b, gone = (t or "").encode(), set()
        for o in range(len(b) - length + 1):
            if seen.setdefault(b[o : o + length], (i, o)) != (i, o):
                gone.update(range(o, o + length))
        out[i] = None if t is None else bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    return out


def test_stages_on_odd_rows(docs_of, odd, spark):
    """Nulls, empty, long and repeated rows, clashing columns and empty tables: exact rows of every stage."""
    from tarnfold.llm import stages

    d = docs_of(odd)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")  # of one class: nothing is toxic
    bench = spark.createDataFrame([(1, "nothing like any of them here at all"), (2, "one two"), (3, None)], "item_id long, text string")
    alone = {i for i, _, c in component_ids(odd) if i == c}
    whole = Counter(odd)
    once = list({i: (i, t) for i, t in odd if i is not None}.values())  # for the removal of repeats: one text a doc_id
    left = kept_texts(once)
    cases = [
        (d, lambda x: stages.without_toxic(x, labels), whole),
        (d, stages.one_of_each, Counter(x for x in set(odd) if x[0] in alone)),
        (docs_of(once), stages.without_repeated_strings, Counter((i, left[i]) for i, _ in once)),
        (d, lambda x: stages.without_benchmark(x, bench), whole - Counter({(104, "one two"): 1})),  # by default a short item counts as any other
        (d, lambda x: stages.without_benchmark(x, bench, least=3), whole),
    ]
    for docs, stage, want in cases:
        out = stage(docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == want and {r.gid for r in got} == {3}
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        assert stage(docs.where("false")).count() == 0
    assert stages.encoded(d).count() == len(odd)
