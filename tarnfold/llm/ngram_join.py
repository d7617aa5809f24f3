"""Documents whose sets of word shingles have a Jaccard similarity of 0.75 or more, by T-occurrence search.

1. Each text becomes its set of shingle hashes. Equal sets are one class, named by a 128-bit hash of the set, and numbered.
2. Sketches of fixed size count words and shingles of all texts; from them every shingle has a rank, rare words
   first and widely shared shingles last. Two linked sets share one of their n - ceil(0.75 n) + 1 first shingles.
3. Those go to inverted lists. The least class of a list is its hub, and all its classes join the hub's group:
   any two classes that share a list meet in one group, without any pairs being written.
4. Each class has a parity bitmap of about a bit a shingle. Bits in which two differ are no more than the shingles
   that only one has, so most members of a group are seen to link with none; the others make up smaller groups, equal
   ones from several hubs just once. Only these get their texts.
   A hub's group beyond a bounded size is dealt over chunks, and every pair of chunks is sifted apart from the
   others: bitmaps meet, texts don't, and no group after this has more than two chunks' members.
5. In a group the classes are indexed, and DivideSkip finds those that share enough shingles with a query: short
   lists are heap-merged, long ones probed by bisection. Every member is queried, so every link is found; one that
   several groups find belongs to the least of them. So links are counted exactly without being written (similar), or
   written once each (links).
6. Links make components, whose least doc_id every document gets; a group hands on as many as connect its members.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, mapped, parts, ship, stored, texts
from .components import components
from .packs import packed, unpacked
from .textnum import chain, column_bytes, runs, word_hashes

SHINGLE, PERCENT = 5, 75
SKETCH, SKETCH_BLOCKS = 1 << 19, 8
CHUNK, BLOCK_BYTES = 2048, 8 << 20
#: A chunk's shingles, on average over a group: a task holds two chunks' sets.
CHUNK_SHINGLES = 2 << 20


def shingled(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its shingle hashes, in order and with repeats, and the word hashes that each starts at.

    A text of fewer words than n is one shingle; without words it has none.
    """
    words, first = word_hashes(data, offsets)
    all_n = chain(words, n)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            yield all_n[a : b - n + 1], words[a:b]
        elif b > a:
            yield chain(words[a:b], int(b - a)), words[a:b]
        else:
            yield words[:0], words[:0]


def class_of(shingles: np.ndarray) -> bytes:
    """A 128-bit name for a sorted set of hashes."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def group_of(numbers: np.ndarray) -> int:
    """A signed 64-bit name for sorted members; should two groups share one, they are searched together."""
    return int.from_bytes(hashlib.blake2b(numbers.astype("<i8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of how many hashes end in each pattern of so many bits that there is a pattern a shingle, 64 to 65,536."""
    m = 1 << min(16, max(6, (len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_links(sizes: np.ndarray, maps: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """Each member (ascending sizes; maps of 64-bit words) with the later ones whose sizes and bitmaps do not rule a link out."""
    level = np.array([len(m) for m in maps])
    rows = {w: np.stack([m for m in maps if len(m) == w]) for w in np.unique(level)}
    first = {w: int(np.flatnonzero(level == w)[0]) for w in rows}
    for i, m in enumerate(maps[:-1]):
        last = int(np.searchsorted(sizes, 100 * sizes[i] / percent, "right"))
        for w, own in rows.items():  # sizes ascend, so maps of a length are neighbours
            lo, hi = max(i + 1, first[w]), min(last, first[w] + len(own))
            if lo >= hi:
                continue
            others = own[lo - first[w] : hi - first[w]]
            while others.shape[1] > len(m):
                others = others[:, : others.shape[1] // 2] ^ others[:, others.shape[1] // 2 :]
            apart = np.bitwise_count(others ^ m).sum(1, dtype=np.int64)
            # the sets differ in at most (100 - percent) / (100 + percent) of both sizes
            yield i, np.flatnonzero((100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[lo:hi])) + lo


def may_link(sizes: np.ndarray, maps: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """(k, 2) pairs of may_links."""
    out = [np.stack([np.full(len(ok), i), ok], 1) for i, ok in may_links(sizes, maps, percent)]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


_SUMMARY = "doc_id long, n int, name binary, bits binary, block int, counts binary"
_SUMMARY_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("name", pa.binary()), ("bits", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(2 * SKETCH, np.uint32)  # of words, then of shingles
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        n, names, maps = [], [], []
        for i, j in runs(offsets):
            ws, ss = [], []
            for s, w in shingled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                u = np.unique(s)
                ws.append(w)
                ss.append(u)
                n.append(len(u))
                names.append(class_of(u) if len(u) else None)
                maps.append(bitmap(u) if len(u) else None)
            sketch[:SKETCH] += np.bincount(_bucket(np.concatenate(ws)), minlength=SKETCH).astype(np.uint32)
            sketch[SKETCH:] += np.bincount(_bucket(np.concatenate(ss)), minlength=SKETCH).astype(np.uint32)
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(names, pa.binary()), pa.array(maps, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_SUMMARY_ARROW)
    if sketch.any():
        cut = np.split(sketch, SKETCH_BLOCKS)
        rows = [{"block": k, "counts": zlib.compress(x.tobytes(), 1)} for k, x in enumerate(cut)]
        yield pa.RecordBatch.from_pylist(rows, _SUMMARY_ARROW)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sketch blocks, as logarithms: eight steps a factor of two."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
            total[block] = total.get(block, np.uint64(0)) + x
    rows = [{"block": k, "logs": np.minimum(255, np.round(8 * np.log2(1 + x.astype(float)))).astype(np.uint8).tobytes()} for k, x in total.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int32()), ("logs", pa.binary())]))


def summaries(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, name, bits) of every row, and the sketches' logarithms: 2 * SKETCH bytes, whatever the input."""
    both = stored(mapped(texts(docs), _summarise, _SUMMARY), "shingles")
    rows = mapped(both.where("block is not null").select("block", "counts").repartition(SKETCH_BLOCKS, "block"), _summed, "block int, logs binary").collect()
    logs = np.zeros(2 * SKETCH, np.uint8)
    for r in rows:
        part = np.frombuffer(r.logs, np.uint8)
        logs[r.block * len(part) : (r.block + 1) * len(part)] = part
    return both.where("block is null").select("doc_id", "n", "name", "bits"), logs


def classes(by_doc: DataFrame) -> DataFrame:
    """class (a number), name, n, bits, copies, least (doc_id) and doc_id (some row's) of each class of by_doc."""
    row = F.struct("doc_id", "n", "bits")
    one = by_doc.where("n > 0").groupBy("name").agg(F.min_by(row, "doc_id").alias("x"), F.first(row).alias("y"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    one = one.select("name", F.coalesce("x", "y").alias("x"), "least", "copies")
    return stored(one.select(F.monotonically_increasing_id().alias("class"), "name", "x.doc_id", "x.n", "x.bits", "copies", "least"), "classes")


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def ranks(s: np.ndarray, words: np.ndarray, logs: np.ndarray, hot: int) -> np.ndarray:
    """64-bit ranks of shingles, in a global order: widely shared ones last, then by how frequent their words are, then by hash."""
    k = min(SHINGLE, len(words))
    of = logs[:SKETCH][_bucket(words)].astype(np.uint64)
    score = np.zeros(len(s), np.uint64)
    for i in range(k):
        score += of[i : i + len(s)]
    score |= (logs[SKETCH:][_bucket(s)] > hot).astype(np.uint64) << np.uint64(11)
    return (score << np.uint64(52)) | (s >> np.uint64(12))


def _first_shingles(batches: Iterator[pa.RecordBatch], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = logs[SKETCH:]
    hot = int(np.median(some)) + 24 if len(some) else 255  # eight times the usual count of a bucket
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for i, j in runs(offsets):
            keys, names, sizes, met = [], [], [], set()
            for s, w in shingled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                if not len(s):
                    continue
                u, at = np.unique(s, return_index=True)
                name = class_of(u)
                if name in met:
                    continue
                met.add(name)
                r = ranks(s, w, logs, hot)[at]
                p = len(u) - needed(len(u)) + 1
                keys.append(np.partition(r, p - 1)[:p] if p < len(r) else r)
                names.append(name)
                sizes.append(p)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))], ["key", "name"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, name): with each class that shares its list with another, the list's least class."""
    key, hub = None, np.zeros(2, ">u8")
    for batch in batches:
        if not batch.num_rows:
            continue
        k, c = np.asarray(batch.column(0)), column_bytes(batch.column(1))[0].reshape(-1, 16).view(">u8")
        start = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
        hubs = np.where((at >= 0)[:, None], c[at], hub)
        other = (c != hubs).any(1)
        pairs = np.concatenate([hubs[other], c[other]], 1)
        pairs = np.unique(np.concatenate([pairs, pairs[:, [0, 1, 0, 1]]]), axis=0) if len(pairs) else pairs
        key, hub = k[-1], hubs[-1]
        if len(pairs):
            data = np.ascontiguousarray(pairs.astype(">u8")).view("S16")
            yield pa.RecordBatch.from_arrays([_binary(data[:, 0]), _binary(data[:, 1])], ["hub", "name"])


def _binary(names: np.ndarray) -> pa.Array:
    """An Arrow array of names of 16 bytes."""
    ends = np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(names).tobytes())])


#: Entries of short lists that are merged by a heap in Python.
HEAPED = 30_000


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of at least so many of the ascending lists, and their numbers, by merging them through a heap.

    As in MergeSkip, least - 1 lists at the top of the heap move on together to where the next may still reach the count.
    Beyond HEAPED entries the same merge is left to numpy's stable sort, which merges ascending runs: a heap in Python
    takes about a microsecond an entry.
    """
    if sum(map(len, lists)) > HEAPED:
        both = np.sort(np.concatenate(lists), kind="stable")
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n = np.diff(np.append(at, len(both)))
        return both[at][n >= least], n[n >= least]
    lists = [x.tolist() for x in lists if len(x)]
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found.append(top)
            counts.append(len(popped))
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            to = max(top + 1, heap[0][0])
        for _, k, at in popped:
            at = bisect_left(lists[k], to, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return np.array(found, np.int64), np.array(counts, np.int64)


def divide_skip(lists: list[np.ndarray], least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (below size) of at least so many of the ascending lists, and in how many each is."""
    none = np.zeros(0, np.int64)
    if len(lists) < least:
        return none, none
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(least - 1, int(least / (0.0085 * math.log2(longest + 1) + 1)), sum(len(x) > 64 for x in lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found, counts = merged(short, max(1, least - n_long))
    for x in long:
        if not len(found):
            break
        at = np.minimum(np.searchsorted(x, found), len(x) - 1)
        counts = counts + (x[at] == found)
    keep = counts >= least
    return found[keep], counts[keep]


class Index:
    """Inverted lists over sets in memory."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.docs = values[order], docs[order]
        self.keys, self.at = np.unique(values, return_index=True)
        self.at = np.append(self.at, len(values))

    def links(self, s: np.ndarray, percent: int = PERCENT, apart: int = 1) -> np.ndarray:
        """Members that link with the set s; lists of fewer than apart entries can only hold s itself."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        i = i[self.keys[i] == s]
        i = i[self.at[i + 1] - self.at[i] >= apart]
        found, counts = divide_skip([self.docs[a:b] for a, b in zip(self.at[i], self.at[i + 1], strict=True)], max(1, needed(len(s), percent)), len(self.sizes))
        return found[100 * counts >= percent * (len(s) + self.sizes[found] - counts)]


class Joined:
    """Sets of the members of one group that links join."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def links_of_group(sets: list[np.ndarray], lower: list[list[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Each member with the later ones that link with it, but for links that belong to a lower group of both."""
    index = Index(sets)
    inside: dict[int, list[int]] = {}
    for i, groups in enumerate(lower):
        for g in groups:
            inside.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        found = index.links(s, apart=2)
        found = found[found > i]
        if len(found) and lower[i]:
            elsewhere = np.zeros(len(sets), bool)
            for g in lower[i]:
                elsewhere[inside[g]] = True
            found = found[~elsewhere[found]]
        if len(found):
            yield i, found


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in key]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


_GROUP = "gid long, class long"
_GROUP_ARROW = pa.schema([("gid", pa.int64()), ("class", pa.int64())])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, a, b, at, class, n, bits) sorted by hub and pair of chunks a, b: the groups of members that may link.

    The members of a pair of chunks fall into those that bitmaps connect across it (within it, where a is b); such a
    group is named by its members, so that equal ones coincide.
    """
    rows: list[tuple] = []
    for g in _grouped(batches, ["hub", "a", "b"]):
        if g.num_rows < 2:
            continue
        sizes = g.column("n").to_numpy()
        order = np.argsort(sizes, kind="stable")
        names, at = g.column("class").to_numpy()[order], g.column("at").to_numpy()[order]
        across = g.column("a")[0].as_py() != g.column("b")[0].as_py()
        maps = [np.frombuffer(g.column("bits")[int(k)].as_py(), np.uint64) for k in order]
        label, linked = np.arange(len(names)), np.zeros(len(names), bool)
        for i, ok in may_links(sizes[order].astype(np.int64), maps):
            if across:
                ok = ok[at[ok] != at[i]]
            if len(ok):
                linked[i] = linked[ok] = True
                met = np.unique(label[np.append(ok, i)])
                if len(met) > 1:
                    to = np.arange(len(names))
                    to[met] = met[0]
                    label = to[label]
        groups: dict[int, list[int]] = {}
        for x in np.flatnonzero(linked).tolist():
            groups.setdefault(int(label[x]), []).append(x)
        for own in groups.values():
            ids = np.sort(names[own])
            gid = group_of(ids)
            rows += [(gid, int(x)) for x in ids]
        if len(rows) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GROUP_ARROW, strict=True)], schema=_GROUP_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GROUP_ARROW, strict=True)], schema=_GROUP_ARROW)


_MEMBER = _GROUP + ", copies long, gids array<long>, text binary"
_MEMBER_ARROW = pa.schema([*_GROUP_ARROW, ("copies", pa.int64()), ("gids", pa.list_(pa.int64())), ("text", pa.binary())])
_ZSTD = pa.Codec("zstd", 3)


def _fetch(packs: pa.Table, members: pa.Table) -> pa.Table:
    """Members with the compressed texts (after their lengths) of a block's documents."""
    if not members.num_rows or not packs.num_rows:
        return _MEMBER_ARROW.empty_table()
    wanted = set(members.column("doc_id").to_pylist())
    docs = unpacked(packs.column("pack"))
    found: dict[tuple[int, int], bytes] = {}
    ids, text = docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).combine_chunks()
    for k, d in enumerate(ids):
        if d in wanted:
            x = text[k].as_py() or b""
            data = np.frombuffer(x, np.uint8)
            name = class_of(np.unique(next(shingled(data, np.array([0, len(x)])))[0]))
            found[d, name] = len(x).to_bytes(8, "little") + _ZSTD.compress(x, asbytes=True)
    texts_ = [found[k] for k in zip(members.column("doc_id").to_pylist(), members.column("name").to_pylist(), strict=True)]
    return members.select([f.name for f in _MEMBER_ARROW][:-1]).append_column("text", pa.array(texts_, pa.binary())).cast(_MEMBER_ARROW)


#: Links as classes u and v, and how many classes and rows a class links with through its group.
_FOUND = "u long, v long, class long, classes long, rows long"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("u", "v", "class", "classes", "rows")])


def _search(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Members sorted by group: every link, or each member's counts and as many links as connect what is linked."""
    for g in _grouped(batches, ["gid"]):
        if g.num_rows < 2:
            continue
        sets = []
        for x in g.column("text").to_pylist():
            data = np.frombuffer(_ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), np.uint8)
            sets.append(np.unique(next(shingled(data, np.array([0, len(data)])))[0]))
        names, copies, gid = g.column("class").to_numpy(), g.column("copies").to_numpy(), g.column("gid")[0].as_py()
        lower = [[x for x in xs if x < gid] for xs in g.column("gids").to_pylist()]
        joined = Joined(len(names))
        counts = np.zeros((2, len(names)), np.int64)
        u, v = [], []
        for i, found in links_of_group(sets, lower):
            if not every:
                counts[0, i] += len(found)
                counts[1, i] += copies[found].sum()
                counts[0, found] += 1
                counts[1, found] += copies[i]
                new = []
                for k in found.tolist():
                    if joined.root(i) != joined.root(k):
                        joined.join(i, k)
                        new.append(k)
                found = np.array(new, np.int64)
            u.append(np.full(len(found), names[i]))
            v.append(names[found])
            if every:  # a member's links at a time, however many a group has
                yield pa.RecordBatch.from_arrays([pa.array(u.pop()), pa.array(v.pop()), *[pa.nulls(len(found), pa.int64())] * 3], schema=_FOUND_ARROW)
        if u:
            got = np.flatnonzero(counts[0])
            u, v = np.concatenate(u), np.concatenate(v)
            none = [pa.nulls(len(u), pa.int64()), pa.nulls(len(got), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[none[0]] * 3], schema=_FOUND_ARROW)
            yield pa.RecordBatch.from_arrays([none[1], none[1], pa.array(names[got]), pa.array(counts[0, got]), pa.array(counts[1, got])], schema=_FOUND_ARROW)


def searched(docs: DataFrame, one: DataFrame, logs: np.ndarray, every: bool = False) -> DataFrame:
    """Rows of _search: every link between classes once; or links enough to connect all that are linked, and counts of all."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(logs)
    n = parts(spark)
    d = texts(docs)
    lists = mapped(d.select("text"), lambda b: _first_shingles(b, shared.value), "key long, name binary")
    members = mapped(lists.repartition(n, "key").sortWithinPartitions("key", "name"), _hubs, "hub binary, name binary").distinct()
    members = members.join(one.select("name", "class"), "name").select(F.xxhash64("hub").alias("hub"), "class")  # a hub's name only groups
    members = stored(members.distinct(), "members")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
    large = stored(members.join(one.select("class", "n"), "class").groupBy("hub").agg(chunks.alias("chunks")).where("chunks > 1"), "chunks")
    dealt = members.join(large, "hub", "left").join(one.select("class", "n", "bits"), "class").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "at").alias("a"), F.greatest(k, "at").alias("b")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("hub", "pair.a", "pair.b", "at", "class", "n", "bits")
    groups = stored(mapped(dealt.repartition(n, "hub", "a", "b").sortWithinPartitions("hub", "a", "b"), _sift, _GROUP).dropDuplicates(["gid", "class"]), "groups")
    size = d.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-size // BLOCK_BYTES))))
    of = groups.groupBy("class").agg(F.collect_list("gid").alias("gids"))  # no more than a text's first shingles and chunks
    wanted = groups.join(of, "class").join(one.select("class", "name", "doc_id", "copies"), "class").withColumn("block", block)
    found = packed(d.withColumn("block", block)).groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(by_group(_fetch), _MEMBER)
    return stored(mapped(found.repartition(n, "gid").sortWithinPartitions("gid"), lambda b: _search(b, every), _FOUND), "links")


def links(docs: DataFrame) -> DataFrame:
    """Every link between different texts of docs (doc_id, text), once: the classes u and v of their sets, and each one's least doc_id.

    As many rows as there are linked pairs of sets; rows of equal sets stand behind one class, see similar.
    """
    ship(docs.sparkSession)
    by_doc, logs = summaries(docs)
    one = classes(by_doc)
    found = searched(docs, one, logs, every=True).select("u", "v")
    for c in ("u", "v"):
        found = found.join(one.select(F.col("class").alias(c), F.col("least").alias(f"doc_{c}")), c)
    return found.select("u", "v", "doc_u", "doc_v")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, n_links and component_id of each row of docs (doc_id, text).

    Rows of one class have equal sets; n_links is the exact number of other rows that a row links with, those of its class
    included. Null and empty texts have no shingles, class or links and stand alone. Rows that repeat a doc_id with other
    texts each get a row; a component's number is the least doc_id of its rows. Null doc_ids are ranked above all others.
    """
    ship(docs.sparkSession)
    by_doc, logs = summaries(docs)
    one = classes(by_doc)
    found = searched(docs, one, logs)
    roots = components(found.where("u is not null").select("u", "v")).withColumnsRenamed({"u": "class"})
    counts = found.where("class is not null").groupBy("class").agg(F.sum("rows").alias("rows"))
    least = one.select("class", "name", "least", "copies").join(roots, "class", "left").join(counts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("rows", F.lit(0)) + F.col("copies") - 1
    of_class = least.join(of_root, "root").select("name", "class", n_links.alias("n_links"), "component_id")
    n = F.col("n").cast("long").alias("n_shingles")
    out = by_doc.where("n > 0").join(of_class, "name").select("doc_id", n, "class", "n_links", "component_id")
    alone = by_doc.where("n = 0").select("doc_id", n, F.lit(None).cast("long").alias("class"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of similar."""
    return similar(docs).select("doc_id", "n_shingles", "component_id")
