"""WARC, token counts, SentencePiece, SpotSigs, licences, decontamination and toxicity on small odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import decontam, license_scan, sp_codec, spotsigs, token_counts, toxicity, warc


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- WARC


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, file string")


def test_warc_round_trip(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "http://www.A.example.com:80/p?q=1#f", big), (2, "http://b.example.com/", big), (3, None, big), (4, "odd\nurl", small), (5, "http://x", small), (6, "u", None), (7, "u", ""), (None, "http://n/", big), (2, "http://b.example.com/", big), (None, "z", "only null" * 200)]
    got = warc.round_trip(pages_of(spark, rows))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        same = [k for k, _, x in rows if (x or "") == (h or "") and k is not None]
        refer = max(same) if len(data) >= 1000 and same and i != max(same) else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refer is not None else "response", refer] += 1
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_warc_lookup_by_two_levels(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i}", f"page {i}") for i in range(300)] + [(1000 + i, "http://hot.example.org/", f"v{i}") for i in range(150)]
    folder, captures = warc.write_warc(pages_of(spark, rows), file_bytes=5000)
    a = warc.Archive(folder, captures, warc.build_index(folder, captures, block_lines=16))
    asked = spark.createDataFrame([("http://h3.example.com/p3",), ("http://HOT.example.org/",), ("http://none/",), ("http://h3.example.com/p3",)], "url string")
    found = warc.read_records(a, warc.lookup(a, asked), with_payload=True)
    got = {r.page_id: bytes(r.payload).partition(b"\r\n\r\n")[2] or bytes(r.payload) for r in found.collect()}
    assert got == {3: b"page 3"} | {1000 + i: f"v{i}".encode() for i in range(150)}
    assert warc.index_lines(a).count() == 450
    asked = spark.createDataFrame([("http://HOT.example.org/", 1007), ("http://HOT.example.org/", 1007), ("http://h3.example.com/p3", 4), ("http://h3.example.com/p3", 3), (None, None)], "url string, page_id long")
    assert sorted(r.page_id for r in warc.lookup(a, asked, "page_id").collect()) == [3, 1007]


def test_warc_copies_of_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "MANY", 4)  # more than a quarter of the pages is hot
    rows = [(i, f"http://a/{i}", ["hot" * 400, "warm" * 300, f"own{i}" * 300][0 if i % 2 else 1 if i % 10 == 0 else 2]) for i in range(60)] + [(100 + i, "u", "") for i in range(40)]
    got = rows_of(warc.round_trip(pages_of(spark, rows)), "page_id", "record_type", "refers_to")
    last = {h: i for i, _, h in rows}
    assert got == Counter((i, "revisit", last[h]) if len(h) >= 1000 and last[h] != i else (i, "response", None) for i, _, h in rows)


def test_warc_of_a_long_payload(spark):
    long = "long é " * 800_000
    got = warc.round_trip(pages_of(spark, [(1, "http://l/", long), (2, "http://l/", long)]))
    n, digest = len(long.encode()), hashlib.sha1(long.encode()).hexdigest()
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "refers_to") == Counter([(1, n, digest, 2), (2, n, digest, None)])


def test_warc_empty(spark):
    assert warc.round_trip(pages_of(spark, [(1, "u", "h")]).where("false")).count() == 0


# --- token counts and SentencePiece


def test_token_counts(docs_of, odd):
    rows = [*odd, (200, "a<|endoftext|>b <|STARTOFTEXT|> x.,y it's, we'LL."), (201, "é ǅ İstanbul ΟΔΟΣ, ª."), (202, "١٢٣ x²y ,., .a, b.c")]
    lib = token_counts.tokenizer(token_counts.default_path())
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert rows_of(token_counts.token_counts(docs_of(rows), n_frequent=20), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(docs_of(rows).where("false")).count() == 0


def test_tokenizers_with_spaces_in_tokens_are_refused():
    import public_tokenizers

    assert token_counts.splits_at_space(token_counts.default_path())
    assert not token_counts.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_cache_may_empty_itself(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 5)
    path = token_counts.default_path()
    lib, of = token_counts.tokenizer(path), token_counts.Lengths(path, b"the of", np.array([1, 1], np.uint16))
    for t in ("a b c the d", "the e f, g. h i", "a the of j k l m n o", "a b c"):
        assert of.count(t.encode()) == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp_codec.default_path())


def test_sentencepiece(docs_of, odd, sp):
    rows = [*odd, (300, "  two  ▁▁ x "), (301, "😀\x00é"), (302, " "), (303, "▁")]
    want, decoded = {}, {}
    for i, t in rows:
        want[i, t or ""] = ids = sp.encode(t or "")
        decoded[i, t or ""] = sp.decode(ids)
    enc = sp_codec.encode(docs_of([(k, t) for k, (_, t) in enumerate(rows)])).collect()
    for r in enc:
        i, t = rows[r.doc_id]
        data = (t or "").encode()
        assert r.ids == want[i, t or ""]
        assert r.starts[1:] == r.ends[:-1] and (not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(data)))
        for p, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            piece = sp.id_to_piece(p)
            assert (bytes([int(piece[3:5], 16)]) if sp.is_byte(p) else piece.encode()) in (data[a:b].replace(b" ", "▁".encode()), "▁".encode() + data[a:b].replace(b" ", "▁".encode()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = rows_of(sp_codec.digests(docs_of(rows)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter((i, len(want[i, t or ""]), sha(",".join(map(str, want[i, t or ""]))), sha(decoded[i, t or ""])) for i, t in rows)
    assert sp_codec.digests(docs_of(rows).where("false")).count() == 0
    back = {r.doc_id: r.text for r in sp_codec.decode(sp_codec.encode(docs_of([(1, "a  b▁c"), (2, None)]))).collect()}
    assert back == {1: "a  b c", 2: ""}


def test_character_map_takes_the_longest_prefix():
    """A double array built by hand for a -> x, ab -> yy, c -> nothing."""
    import struct

    units = [0] * 1024
    def put(parent, byte, base, leaf):  # noqa: E306
        node = parent ^ byte
        units[node] = byte | (leaf << 8) | ((node ^ base) << 10)
        return base
    root = 0x100
    units[0] = root << 10
    a = put(root, ord("a"), 0x200, 1)
    units[0x200] = 0x80000000 | 0  # the leaf's value: a place in the replacements
    put(a, ord("b"), 0x300, 1)
    units[0x300] = 0x80000000 | 2
    put(root, ord("c"), 0x240, 1)
    units[0x240] = 0x80000000 | 5
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yy\0\0"
    m = sp_codec.CharacterMap(blob)
    assert m.apply("abaçc".encode()) == ("yyxç".encode(), [(0, 2), (0, 2), (2, 3), (3, 4), (4, 5)])


# --- SpotSigs


def test_edited_documents(docs_of, odd):
    rows = sorted({(i, t or "") for i, t in odd if i is not None})
    got = {(r.doc_id): r for r in spotsigs.edited_documents(docs_of(rows)).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert not t or r.fingerprint
    assert got[105].fingerprint == got[106].fingerprint == got[3].fingerprint and got[105].near_next == 1
    assert len({got[i].fingerprint for i in range(30)}) == 30
    assert spotsigs.edited_documents(docs_of(odd)).count() == len(odd)
    assert spotsigs.edited_documents(docs_of(odd).where("false")).count() == 0
    assert spotsigs.edited_documents(docs_of([(1, "alone and some words")])).first().near_next == 1


def chains_of(text):
    """SpotSigs by plain loops: the set of chains of a text."""
    import regex

    w = [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split(" ") if x]
    content = [k for k, x in enumerate(w) if x not in spotsigs.ANCHORS]
    every = {k: tuple((w[j] if (n := content.index(k)) is not None and (j := content[n + m] if n + m < len(content) else None) is not None else "") for m in range(3)) for k in content}
    after = {every[k] for k in content if k > 0 and w[k - 1] in spotsigs.ANCHORS}
    return after or set(every.values()) or {text}


def test_likeness_is_that_of_plain_chains(docs_of, odd):
    rows = sorted({(i, t or "") for i, t in odd if i is not None and len(t or "") < 2000})
    got = {r.doc_id: r for r in spotsigs.edited_documents(docs_of(rows)).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        own = chains_of(t)
        assert len(got[i].fingerprint) == 8 * len(own)
        assert got[i].near_edited == pytest.approx(like(own, chains_of(edited))) and got[i].near_next == pytest.approx(like(own, chains_of(nxt)))


def test_next_over_many_ranges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    ids = random.Random(2).sample(range(10_000), 100)
    d = docs_of([(i, f"text {i}") for i in ids])
    got = {r.doc_id: r.nxt for r in spotsigs.with_next(d, "doc_id", "text", {"nxt": "text"}).collect()}
    order = sorted(ids)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_spotsigs_search(docs_of):
    rng = random.Random(4)
    base = [[rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(20)]
    rows = [(i, " ".join(x)) for i, x in enumerate(base)]
    rows += [(100 + i, " ".join([*x[:110], *[f"z{j}" for j in range(i % 5)], *x[110 + i % 5 :]])) for i, x in enumerate(base)]
    d = docs_of(rows)
    links, members = spotsigs.search(d.where("doc_id < 20"), d)
    sets = {r.doc_id: set(r.s) for r in spotsigs.with_signatures(d, "text", "s").select("doc_id", "s").collect()}
    side = {(r.side, r.doc_id): r["class"] for r in members.collect()}
    want = {(side["query", a], side["document", b]) for a in range(20) for b in sets if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.query_class, r["class"]) for r in links.collect()} == want
    found = spotsigs.linked(d.where("doc_id < 20"), d).collect()
    assert {(side["query", r.query_id], side["document", r.doc_id]) for r in found} == want and Counter(r.documents for r in found) == Counter(sum(c == y for (k, _), c in side.items() if k == "document") for _, y in want)


# --- licences and decontamination


def test_licenses(docs_of, odd):
    gpl, mit = license_scan.TEMPLATES["gpl-3.0"], license_scan.TEMPLATES["mit-line"]
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [*odd, (400, f"{filler} {gpl.upper()} {filler}"), (401, filler + "\n" + mit), (402, mit), (403, " ".join(gpl.split()[:10])), (404, f"{filler} {' '.join(gpl.split()[:-3])}"), (405, f"{filler * 900} {license_scan.TEMPLATES['isc']}")]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.licenses(docs_of(rows)).collect()}
    assert got.keys() == {(400, "gpl-3.0"), (401, "mit-line"), (402, "mit-line"), (404, "gpl-3.0"), (405, "isc")}
    assert got[400, "gpl-3.0"] == 1 and 0.75 <= got[404, "gpl-3.0"] < 1
    assert license_scan.licenses(docs_of(rows).where("false")).count() == 0


def test_every_template_is_found_in_a_longer_text(docs_of):
    """Each by its own name, whole, among other words, whatever else it holds of others."""
    filler = " ".join(f"plain{i}" for i in range(70))
    names = list(license_scan.TEMPLATES)
    rows = [(i, f"{filler}\n// {license_scan.TEMPLATES[n].lower()}\n{filler}") for i, n in enumerate(names)]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.licenses(docs_of(rows)).collect()}
    assert all(got[i, n] >= 0.75 for i, n in enumerate(names)) and len(names) >= 30
    exact = license_scan.Templates(license_scan.TEMPLATES).exact
    within = {(a, b) for a, x in zip(names, exact, strict=True) for b, y in zip(names, exact, strict=True) if a != b and len(x & y) >= 0.75 * len(x)}
    assert within == {("apache-2.0-line", "apache-2.0"), ("mit-grant", "mit"), ("bsd", "bsd-2-clause")}  # all others tell licences apart


def test_license_windows_find_all_that_brute_force_finds(docs_of):
    rng = random.Random(9)
    templates = {f"t{i}": " ".join(f"v{rng.randrange(60)}" for _ in range(rng.choice([5, 9, 17, 40, 90]))) for i in range(12)}
    rows, want = [], set()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for d in range(120):
        own = templates[f"t{rng.randrange(12)}"].split()
        own = own[: max(5, int(len(own) * rng.choice([0.5, 0.7, 0.85, 1])))]
        pad = [f"q{rng.randrange(10_000)}" for _ in range(rng.randrange(0, 200))]
        k = rng.randrange(len(pad) + 1)
        words = pad[:k] + own + pad[k:]
        rows.append((d, " ".join(words)))
        for name, t in templates.items():
            s = shingles(t.split())
            # all of a planted stretch lies in one window, so containment in the text is that of the window
            if len(s & shingles(words)) >= 0.75 * len(s):
                want.add((d, name))
    assert {(r.doc_id, r.license) for r in license_scan.licenses(docs_of(rows), templates).collect()} == want


def test_overlaps_with_substitutions_are_those_of_brute_force(spark):
    """All diagonals of all pairs; items of every length from one token."""
    rng = random.Random(12)
    items = [(n, " ".join(f"i{n}w{rng.randrange(40)}" for _ in range(n))) for n in [*range(1, 24), 40]]
    texts = []
    for _, item in items:
        w = item.split()
        gone = [{k for k in range(len(w)) if k % every == every - 1} for every in (3, 4, 5, 6)]
        gone += [{k, k + 1} for k in range(0, len(w), 3)] + [{k, k + 1, k + 2} for k in range(0, len(w), 5)]
        gone += [set(rng.sample(range(len(w)), min(len(w), rng.choice([1, 2, 3, 4, 8])))) for _ in range(12)] + [set()]
        texts += [" ".join(["x"] * rng.randrange(3) + ["sub" if k in g else x for k, x in enumerate(w)] + ["y"] * rng.randrange(3)) for g in gone]
    want = {}
    for d, text in enumerate(texts):
        t = text.split()
        for item, own in items:
            w = own.split()
            best = 0
            for shift in range(1 - len(w), len(t)) if w[0].split("w")[0] in text else ():
                agree = [0 <= shift + k < len(t) and t[shift + k] == x for k, x in enumerate(w)]
                lo, hi = max(0, -shift), min(len(w), len(t) - shift)
                for a in range(lo, hi):
                    n = 0
                    for b in range(a, hi):
                        n += agree[b]
                        if 5 * n >= 4 * (b + 1 - a):
                            best = max(best, n)
            if 5 * best >= min(65, 4 * len(w)):
                want[d, item] = best
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.agreeing for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(texts) / 4 < len(want) < len(texts)


def test_masks_fit_every_overlap_that_counts():
    """Every pattern of agreeing tokens that is enough, of every item length up to 17, has a place for some mask."""
    from itertools import combinations

    for n in range(1, 18):
        least = -(-4 * min(n, 16.25) // 5)
        for gone in range(int(n - least) + 1):
            for x in combinations(range(n), gone):
                agree = "".join("0" if k in x else "1" for k in range(n))
                assert any(all(agree[a + k] == "1" for k, keep in enumerate(m) if keep == "1") for m in decontam.masks_of(n) for a in range(n - len(m) + 1)), agree


def test_filter_rules_out_little_and_loses_nothing(spark):
    h = np.random.default_rng(2).integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    bitmap, bits = decontam.bloom(spark.createDataFrame([(int(x),) for x in h[:20_000].view(np.int64)], "seed long"))
    assert len(decontam.maybe(h[:20_000], bitmap, bits)) == 20_000 and len(decontam.maybe(h[20_000:], bitmap, bits)) < 20


def test_overlaps(spark, docs_of, odd):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([30, 40, 25, 8, 6, 3, 13])] + [(50, None), (51, "")]
    bench = spark.createDataFrame([(*x, "e") for x in [*items, items[0]]], "item_id long, text string, doc_id string")
    filler = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))

    def changed(t, every):
        return " ".join("other" if k % every == every - 1 else w.upper() + "," for k, w in enumerate(t.split()))

    rows = [*odd, (500, f"{filler(50)} {items[0][1]} {filler(50)}"), (501, f"{filler(9)} {changed(items[1][1], 9)}"), (502, items[3][1]), (503, f"x {items[4][1]} y"), (504, items[5][1]), (505, f"{filler(5)} {' '.join(items[2][1].split()[:14])} {filler(5)}"), (506, " ".join(items[2][1].split()[:9])), (507, items[6][1] + " " + items[6][1]), (508, changed(items[0][1], 3))]
    rows += [(509, f"{filler(400_000)} {items[0][1]}"), (510, items[3][1]), (510, items[3][1])]
    want = Counter([(500, 0), (501, 1), (502, 3), (503, 4), (504, 5), (505, 2), (507, 6), (509, 0), (510, 3), (510, 3)])
    got = decontam.overlaps(docs_of(rows), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    row = next(r for r in got if r.doc_id == 501)
    assert row.agreeing == 36 and row.first_token == 9
    assert decontam.overlaps(docs_of(rows).where("false"), bench).count() == 0
    assert decontam.overlaps(docs_of(rows), bench.where("false")).count() == 0


# --- toxicity


def test_toxicity_learns_words_and_stems(spark, docs_of):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(["en", "de"])
        words = [f"{lang}w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            words.insert(rng.randrange(len(words)), f"loweix{rng.randrange(99_999)}," if lang == "de" else rng.choice(["idiotic!", "moronic"]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic, "n"))
    rows += [(2000, None, None), (2001, "", "fr"), (2002, "x" * 50_000, "en"), (None, "enw1", "en"), rows[0]]
    labels += [(None, 1, "n"), (5000, 1, "n"), (3, None, "n")]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, lang string")
    out = toxicity.scored_documents(docs_of(rows), lab).collect()
    assert len(out) == len(rows)
    truth = {i: t for i, t, _ in labels if t is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert wrong <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and all(r.predicted == 0 for r in out if r.doc_id in (None, 2000, 2001, 2002))
    assert toxicity.scored_documents(docs_of(rows).where("false"), lab.where("false")).count() == 0


def test_thresholds_by_language(spark, docs_of):
    m = toxicity.Model(np.zeros((3, toxicity.BUCKETS, toxicity.DIM), np.float32), np.zeros((24, 24), np.float32), np.zeros(24, np.float32), np.zeros(24, np.float32), thresholds={"en": 0.2})
    d = toxicity.score(docs_of([(1, "a", "en"), (2, "a", "fr"), (3, "a", None)]), m, "s")
    assert {r.doc_id: r.x for r in d.select("doc_id", toxicity.rejected(m, "s").alias("x")).collect()} == {1: True, 2: False, 3: False}
    assert d.columns[-1] == "s" and d.select(F.col("toxic_score")).first()[0] == 0.1


def test_scores_are_those_of_plain_loops(spark, docs_of, odd, monkeypatch):
    """The forward pass word by word; a long text is scored in pieces."""
    rng = np.random.default_rng(5)
    f, d, w = toxicity.FILTERS, toxicity.DIM, toxicity.WIDTH
    m = toxicity.Model(rng.normal(0, 1, (3, toxicity.BUCKETS, d)).astype(np.float16).astype(np.float32), (rng.normal(0, 1, (w * d, w * f)) * toxicity._mask()).astype(np.float32), rng.normal(0, 1, w * f).astype(np.float32), rng.normal(0, 0.2, w * f).astype(np.float32), -0.3, 0.4, 0.1)
    m.tables[:, 0] = 0
    rows = [r for r in odd if r[1] is None or len(r[1]) < 900]
    got = {r.doc_id: r.s for r in toxicity.score(docs_of(rows), m, "s").collect()}

    def plain(text):
        ids, _ = toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        x = [[sum(float(m.tables[k, i[k], e]) for k in range(3)) for e in range(d)] for i in ids.tolist()]
        total = m.out_bias
        for c in range(w * f):
            best = max(sum(float(m.filters[j * d + e, c]) * x[i + j][e] for j in range(c // f + 1) for e in range(d)) for i in range(len(x) - 2)) if len(x) > 2 else 0.0
            total += max(0.0, best + float(m.bias[c])) * float(m.out[c])
        return 1 / (1 + np.exp(-(m.scale * total + m.shift)))

    for i, t in rows[::4]:
        assert abs(got[i] - plain((t or "").encode())) < 1e-3
    from tarnfold.llm import textnum

    long = np.frombuffer(" ".join(f"w{k % 977}" for k in range(9000)).encode(), np.uint8)
    whole = m.logits(*toxicity.features(long, np.array([0, len(long)])))
    real = textnum.pieces
    monkeypatch.setattr(toxicity, "pieces", lambda data, inside: real(data, inside, 500))
    assert np.allclose(m.long_logits(long), whole, atol=1e-4) and np.allclose(m.long_logits(long[:4]), m.logits(*toxicity.features(long[:4], np.array([0, 4]))), atol=1e-4)


def test_thresholds_come_from_all_labelled_rows(spark, docs_of):
    words = ["calm", "rude"]
    rows = [(i, f"{words[i % 2]} w{i % 37} x{i % 11}", "en" if i % 3 else "xx") for i in range(600)] + [(1000, "rude", "rare")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(1000, 1)], "doc_id long, toxic int")
    m = toxicity.learned(docs_of(rows), labels, rows=50)
    assert len(m.sample) == 150 and not m.thresholds
    toxicity.with_thresholds(m, docs_of(rows), labels)
    assert set(m.thresholds) == {"en", "xx"} and all(0 < t < 1 for t in m.thresholds.values())
    assert toxicity.threshold(np.array([0] * 5 + [9]), np.array([30] + [0] * 5)) is None
    one = toxicity.learned(docs_of(rows), labels.where("toxic = 0"), rows=50)  # labels of one class
    assert all(r.s < 0.5 for r in toxicity.score(docs_of(rows), one, "s").collect())


def test_training_takes_whole_texts_within_a_bound(spark, docs_of, monkeypatch):
    """What tells toxic texts apart stands at a third of long ones; a bound on a class's characters leaves rows out, not parts."""
    rng = random.Random(8)
    calm = lambda n: " ".join(rng.choice(["calm", "river", "stone", "green", "letter", "window"]) for _ in range(n))
    rows = [(i, calm(1300) + (" grizbolt vexham " if i % 2 else " ") + calm(2600)) for i in range(60)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.learned(docs, labels)
    assert m.sample == list(range(60))
    asked = docs_of([(1, "grizbolt vexham"), (2, calm(10))])
    score = {r.doc_id: r.toxic_score for r in toxicity.score(asked.drop("toxic_score"), m).collect()}
    assert score[1] > 0.7 > score[2]
    one = max(len(t) for _, t in rows)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 5 * one)
    kept = toxicity.learned(docs, labels).sample
    assert all(sum(i % 2 == v for i in kept) == 5 for v in (0, 1))
