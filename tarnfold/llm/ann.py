"""Approximate nearest neighbours: NN-descent builds a neighbour graph by joins of neighbours of neighbours, a greedy walk searches it.

Equal vectors are one node (its name is their least id), which keeps as many of its least ids as an answer can need.
A node travels as a code: a byte a component and a scale of its own. The first lists come from a few forests of random
hyperplanes: rows sorted by the signs of projections are dealt over ranges of like size, halved in the task until a leaf has
at most LEAF rows, and every leaf is compared as a whole. In each round of the descent every node gathers the codes of its
neighbours in both directions (of those that list it, the IN nearest), compares them all with each other and tells each one
of the better neighbours found; rounds end when few entries still change. A query walks from its own list (or from a
sample of nodes): the best nodes of its beam that haven't been expanded are joined with their adjacency, the new nodes among
those with their codes. Distances of what it has found are then computed on the original vectors, in double precision.

Rows with a null id, or whose vector is null, empty, zero or holds a null or a number that isn't finite, take no part.
Of rows with one id the least vector counts. Shorter vectors count as filled up with zeros. Other columns are ignored; empty
tables give empty results; a table of up to DEGREE + 1 different vectors is searched exactly.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, fresh, mapped, parts, stored

#: Entries of a node's list, and how many of the nodes that list it join in a round; new neighbours told by one node at once.
DEGREE, IN, TOLD = 20, 30, 5
#: Forests of the first lists, rows of a range, of a leaf, and bits of a row's sign code.
TREES, SLAB, LEAF, BITS = 4, 8192, 1024, 16
#: Rounds at most, and the share of entries that must change for another one.
ROUNDS, CHANGED = 8, 0.35
#: Nodes of a walk's beam, expanded in a step, kept for exact distances; links of a node that the walk follows backwards.
BEAM, EXPANDED, RESCORED, BACK = 512, 128, 128, 40
#: Nodes of a block of the graph, queries of a block of the walk, and nodes that a query from outside starts at.
NODES, QUERIES, ENTRIES = 2048, 64, 256
LISTS = "ids array<long>, ds array<float>"


class Index(NamedTuple):
    nodes: DataFrame  # node, members, vec
    graph: DataFrame  # node, code, scale, ids, ds
    rows: DataFrame  # vec_id, vec
    dims: int
    size: int


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part, vec as doubles, one row an id."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return d.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))).groupBy("vec_id").agg(F.min("vec").alias("vec"))


# --- inside tasks


def matrix(column, dims: int, kind: type) -> np.ndarray:
    """A list or binary column as rows of dims numbers, shorter ones filled up with zeros."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type):
        joined = np.frombuffer(b"".join(a.to_pylist()), dtype=kind)
        lengths = np.asarray(pc.binary_length(a))
    else:
        joined, lengths = np.asarray(a.flatten()), np.asarray(pc.list_value_length(a))
    if (lengths == dims).all():
        return joined.reshape(-1, dims)
    out = np.zeros((len(a), dims), dtype=kind)
    out[np.arange(dims)[None] < lengths[:, None]] = joined
    return out


def decoded(codes, scales, dims: int) -> np.ndarray:
    return matrix(codes, dims, np.int8).astype(np.float32) * np.asarray(scales, dtype=np.float32)[:, None]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a from those of b, over leading axes."""
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * a @ np.swapaxes(b, -1, -2), 0)


def best(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different b of each a, sorted by a, then d; of several distances of a pair the least."""
    o = np.lexsort((d, b, a))
    a, b, d = a[o], b[o], d[o]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, d = a[once], b[once], d[once]
    o = np.lexsort((b, d, a))
    a, b, d = a[o], b[o], d[o]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return a[place < k], b[place < k], d[place < k]


def told(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.Table:
    """(node, ids, ds) of sorted a."""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    counts = np.diff(np.r_[first, len(a)])
    return pa.table({"node": pa.array(a[first], pa.int64()), "ids": lists(b, counts, pa.int64()), "ds": lists(d, counts, pa.float32())})


def _leaves(rows: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    if len(rows) <= LEAF:
        yield rows
        return
    at, half = x[rows] @ rng.standard_normal(x.shape[1]).astype(np.float32), len(rows) // 2
    o = np.argpartition(at, half)
    yield from _leaves(rows[o[:half]], x, rng)
    yield from _leaves(rows[o[half:]], x, rng)


def _compared(t: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each row within its leaf."""
    nodes, x, trees = t.column("node").to_numpy(), decoded(t.column("code"), t.column("scale"), dims), t.column("tree").to_numpy()
    rng = np.random.default_rng(5)
    for tree in np.unique(trees):
        for rows in _leaves(np.flatnonzero(trees == tree), x, rng):
            k = min(DEGREE, len(rows) - 1)
            if k <= 0:
                continue
            d = squares(x[rows], x[rows])
            np.fill_diagonal(d, np.inf)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            counts = np.full(len(rows), k)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), lists(nodes[rows][near].ravel(), counts, pa.int64()), lists(np.take_along_axis(d, near, 1).ravel(), counts, pa.float32())], ["node", "ids", "ds"])


def _local_join(t: pa.Table, dims: int) -> pa.Table:
    """What the members of each node x tell each other: better neighbours than the last of their lists."""
    x, v, kth = (t.column(c).to_numpy() for c in ("x", "v", "kth"))
    o = np.lexsort((v, x))
    o = o[np.r_[True, (x[o][1:] != x[o][:-1]) | (v[o][1:] != v[o][:-1])]]
    x, v, kth, codes = x[o], v[o], kth[o], decoded(t.column("code"), t.column("scale"), dims)[o]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    counts = np.diff(np.r_[first, len(x)])
    found = []
    by_size = np.argsort(counts, kind="stable")  # like sizes together, so that little is filled up
    for i in range(0, len(first), 256):
        some = by_size[i : i + 256]
        m = int(counts[some].max())
        if m < 2:
            continue
        inside = np.arange(m)[None] < counts[some][:, None]
        at = np.where(inside, first[some][:, None] + np.arange(m)[None], 0)
        d = squares(codes[at], codes[at])
        d[~(inside[:, :, None] & inside[:, None, :])] = np.inf
        d[:, np.arange(m), np.arange(m)] = np.inf
        d[d >= kth[at][:, :, None]] = np.inf
        k = min(TOLD, m - 1)
        near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
        dist = np.take_along_axis(d, near, 2)
        ok = dist < np.inf
        others = np.take_along_axis(np.broadcast_to(v[at][:, None, :], d.shape), near, 2)
        found.append((np.broadcast_to(v[at][:, :, None], dist.shape)[ok], others[ok], dist[ok]))
    if not found:
        return told(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return told(*best(*(np.concatenate(c) for c in zip(*found, strict=True)), DEGREE))


def _merged(t: pa.Table) -> pa.Table:
    """Lists of a block's nodes out of what they had (rows with a code) and what they were told."""
    counts = np.asarray(pc.list_value_length(t.column("ids")))
    a = np.repeat(t.column("node").to_numpy(), counts)
    b, d = (np.asarray(pc.list_flatten(t.column(c))) for c in ("ids", "ds"))
    own = t.filter(pc.is_valid(t.column("code"))).sort_by("node").combine_chunks()
    had = np.repeat(own.column("node").to_numpy(), np.asarray(pc.list_value_length(own.column("ids"))))
    had = np.stack([had, np.asarray(pc.list_flatten(own.column("ids")))], 1)
    a, b, d = best(a, b, d, DEGREE)
    nodes = own.column("node").to_numpy()
    at = np.searchsorted(a, nodes)
    counts = np.searchsorted(a, nodes, side="right") - at
    if had.size:
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        old = np.isin(np.ascontiguousarray(np.stack([a, b], 1)).view(pair).ravel(), np.ascontiguousarray(had).view(pair).ravel())
    else:
        old = np.zeros(len(a), bool)
    new = np.bincount(np.searchsorted(nodes, a)[~old], minlength=len(nodes)) if len(nodes) else np.zeros(0, int)
    return pa.table({"node": own.column("node"), "code": own.column("code"), "scale": own.column("scale"), "ids": lists(b, counts, pa.int64()), "ds": lists(d, counts, pa.float32()), "new": pa.array(new, pa.int64())})


# --- the graph


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(node, members, vec): one row for each different vector, with its keep least ids."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).groupBy("vec").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members")).select("node", "members", "vec")


def coded(df: DataFrame, dims: int, keep: str) -> DataFrame:
    """The long column keep, code and scale of df (keep, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"), dims, np.float64)
                scale = np.abs(x).max(1) / 127
                code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(keep), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale.astype(np.float32))], [keep, "code", "scale"])

    return mapped(df.select(keep, "vec"), run, f"{keep} long, code binary, scale float")


def first_lists(codes: DataFrame, dims: int, size: int) -> DataFrame:
    """(node, ids, ds) for each node and forest."""
    planes = np.random.default_rng(3).standard_normal((TREES, dims, BITS + 1)).astype(np.float32)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = decoded(b.column("code"), b.column("scale"), dims)
            for tree in range(TREES):
                at = x @ planes[tree]
                key = (at[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int32()), pa.array(key, pa.int64()), pa.array(at[:, BITS]), *b.columns], ["tree", "key", "at", "node", "code", "scale"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > 4 * SLAB:
                yield from _compared(pa.Table.from_batches(held), dims)
                held, n = [], 0
        if n:
            yield from _compared(pa.Table.from_batches(held), dims)

    dealt = mapped(codes, keys, "tree int, key long, at float, node long, code binary, scale float").repartitionByRange(max(1, math.ceil(TREES * size / SLAB)), "tree", "key", "at", "node")
    return mapped(dealt, leaves, f"node long, {LISTS}")


def merged(codes: DataFrame, news: DataFrame, size: int) -> DataFrame:
    """The graph (node, code, scale, ids, ds, new) of what nodes had and what they were told."""
    both = codes.select("node", "code", "scale", "ids", "ds").unionByName(news.select("node", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "ids", "ds"))
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, math.ceil(size / NODES))))
    return both.withColumn("block", block).groupBy("block").applyInArrow(by_group(_merged), f"node long, code binary, scale float, {LISTS}, new long")


def ranked(graph: DataFrame) -> DataFrame:
    """(u, v, d, place, back): v is at place in u's list, and u comes back-th of those that list v."""
    e = graph.select(F.col("node").alias("u"), F.posexplode(F.arrays_zip("ids", "ds")).alias("place", "e")).select("u", F.col("e.ids").alias("v"), F.col("e.ds").alias("d"), "place")
    return e.withColumn("back", F.row_number().over(Window.partitionBy("v").orderBy("d", "u")))


def descended(graph: DataFrame, dims: int, size: int) -> DataFrame:
    """One round: a join of each link with both its ends' codes, a local join at every node, lists merged."""
    e = ranked(graph).where(F.col("back") <= IN)
    pairs = e.select(F.col("u").alias("x"), "v").union(e.select(F.col("v").alias("x"), F.col("u").alias("v")))
    kth = F.coalesce(F.get("ds", F.lit(DEGREE - 1)), F.lit(math.inf).cast("float"))
    sent = pairs.join(graph.select(F.col("node").alias("v"), "code", "scale", kth.alias("kth")), "v")
    block = F.pmod(F.xxhash64("x"), F.lit(max(1, math.ceil(size / NODES))))
    news = sent.withColumn("block", block).groupBy("block").applyInArrow(by_group(lambda t: _local_join(t, dims)), f"node long, {LISTS}")
    return merged(graph, news, size)


def build(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """The neighbour graph of all rows that take part; k is the most neighbours that will be asked for."""
    rows = stored(usable(vectors, id_col, vec_col), "vectors")
    nodes = stored(nodes_of(rows, k + 1), "nodes")
    size, dims = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    codes = coded(nodes, dims, "node")
    empty = codes.select("*", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("ds"))
    graph = stored(merged(empty, first_lists(codes, dims, size), size), "graph")
    for _ in range(ROUNDS):
        if size <= DEGREE + 1:  # every node lists every other one
            break
        graph = stored(descended(graph, dims, size), "graph")
        if (graph.agg(F.sum("new")).first()[0] or 0) < CHANGED * DEGREE * size:
            break
    return Index(nodes, graph, rows, dims, size)


# --- the walk


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, bucketed by key, so that a join with it moves the other side alone; and its name."""
    spark, name = df.sparkSession, f"walk_{uuid.uuid4().hex}"
    df.repartition(parts(spark), key).write.bucketBy(parts(spark), key).option("path", fresh(spark, name)).saveAsTable(name)
    return spark.table(name), name


WALK = "query long, code binary, scale float, beam array<long>, ds array<float>, done array<boolean>, seen array<long>, next array<long>"


def _advanced(state: pa.Table, scored: pa.Table, dims: int) -> pa.Table:
    """Put the scored nodes into the beams and name the nodes to expand."""
    q = state.column("query").to_numpy()
    x = decoded(state.column("code"), state.column("scale"), dims)
    who = scored.column("query").to_numpy()
    o = np.argsort(who, kind="stable")
    who, node = who[o], scored.column("node").to_numpy()[o]
    y = decoded(scored.column("code"), scored.column("scale"), dims)[o]
    old = {c: state.column(c).to_pylist() for c in ("beam", "ds", "done", "seen")}
    out: dict = {"beam": [], "ds": [], "done": [], "seen": [], "next": []}
    for i in range(len(q)):
        a, b = np.searchsorted(who, q[i]), np.searchsorted(who, q[i], side="right")
        ids = np.r_[np.array(old["beam"][i], np.int64), node[a:b]]
        d = np.r_[np.array(old["ds"][i], np.float32), squares(x[i : i + 1], y[a:b])[0]]
        done = np.r_[np.array(old["done"][i], bool), np.zeros(b - a, bool)]
        keep = np.lexsort((ids, d))[:BEAM]
        ids, d, done = ids[keep], d[keep], done[keep]
        todo = np.flatnonzero(~done)[:EXPANDED]
        done[todo] = True
        for c, value in (("beam", ids), ("ds", d), ("done", done), ("seen", np.r_[np.array(old["seen"][i], np.int64), node[a:b]]), ("next", ids[todo])):
            out[c].append(value)
    kinds = {"beam": pa.int64(), "ds": pa.float32(), "done": pa.bool_(), "seen": pa.int64(), "next": pa.int64()}
    return pa.table({"query": state.column("query"), "code": state.column("code"), "scale": state.column("scale")} | {c: lists(np.concatenate(v) if v else np.zeros(0), np.array([len(z) for z in v], int), kinds[c]) for c, v in out.items()})


def _asked(state: pa.Table, found: pa.Table) -> pa.Table:
    """(query, node) of the nodes in found lists that a query hasn't seen."""
    q, seen = state.column("query").to_numpy(), state.column("seen").combine_chunks()
    counts = np.asarray(pc.list_value_length(found.column("ids")))
    who, ids = np.repeat(found.column("query").to_numpy(), counts), np.asarray(pc.list_flatten(found.column("ids")))
    o = np.argsort(who, kind="stable")
    who, ids = who[o], ids[o]
    outs = []
    for i in range(len(q)):
        a, b = np.searchsorted(who, q[i]), np.searchsorted(who, q[i], side="right")
        if b > a:
            outs.append((q[i], np.setdiff1d(ids[a:b], np.asarray(seen[i].values))))
    return pa.table({"query": pa.array(np.repeat([a for a, _ in outs], [len(b) for _, b in outs]).astype(np.int64)), "node": pa.array(np.concatenate([b for _, b in outs]) if outs else np.zeros(0, np.int64), pa.int64())})


def walked(index: Index, starts: DataFrame, asks: DataFrame, count: int) -> DataFrame:
    """(query, beam, ds) after the greedy walk of starts (query, code, scale), that begins at asks (query, node)."""
    spark, dims = starts.sparkSession, index.dims
    e = ranked(index.graph)
    back = e.where((F.col("back") <= BACK) | (F.col("place") == 0))  # no node is out of reach
    page = F.floor(F.greatest(F.col("back") - BACK, F.lit(0)) / 64).cast("int")
    links = e.select(F.col("u").alias("node"), F.lit(0).alias("page"), F.col("v").alias("to")).union(back.select(F.col("v").alias("node"), page.alias("page"), F.col("u").alias("to")))
    links, a = bucketed(links.groupBy("node", "page").agg(F.collect_set("to").alias("ids")), "node")
    codes, b = bucketed(index.graph.select("node", "code", "scale"), "node")
    blocks = max(1, math.ceil(count / QUERIES))
    by_block = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).groupBy("block")
    state = starts.select("query", "code", "scale", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("beam", "long"), ("ds", "float"), ("done", "boolean"))], F.array("query").alias("seen"), F.array().cast("array<long>").alias("next"))
    state = stored(state, "walk")
    while True:
        scored = asks.join(codes, "node").select("query", "node", "code", "scale")
        state = stored(by_block(state).cogroup(by_block(scored)).applyInArrow(by_group(lambda s, t: _advanced(s.drop_columns("block"), t, dims)), WALK), "walk")
        if not state.where(F.size("next") > 0).limit(1).count():
            break
        found = state.select("query", F.explode("next").alias("node")).join(links, "node").select("query", "ids")
        asks = by_block(state.select("query", "seen")).cogroup(by_block(found)).applyInArrow(by_group(lambda s, t: _asked(s, t)), "query long, node long")
    for name in (a, b):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return state.select("query", "beam", "ds")


def distance(a: str, b: str):
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (zero(x) - zero(y)) * (zero(x) - zero(y))), F.lit(0.0), lambda s, x: s + x))


def _answers(index: Index, walk: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the k nearest ids of each query's beam by exact distance; vecs (query, q_vec)."""
    near = walk.select("query", F.explode(F.slice(F.concat(F.array("query"), "beam"), 1, RESCORED)).alias("node")).distinct()
    got = near.join(index.nodes, "node").join(vecs, "query").select("query", distance("q_vec", "vec").alias("score"), F.explode("members").alias("vec_id"))
    w = Window.partitionBy("query").orderBy("score", "vec_id")
    return got.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def members_nearest(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest others of each of queries (vec_id), which are rows of the index."""
    asked = queries.select(F.col("vec_id").alias("query_id")).distinct().join(index.rows.withColumnRenamed("vec_id", "query_id"), "query_id")
    asked = stored(asked.join(index.nodes.select("vec", "node"), "vec").select("query_id", F.col("node").alias("query")), "queries")
    own = asked.select("query").distinct()
    count = own.count()
    starts = own.join(index.graph.withColumnRenamed("node", "query"), "query")
    walk = walked(index, starts.select("query", "code", "scale"), starts.select("query", F.explode("ids").alias("node")), count)
    vecs = own.join(index.nodes.select(F.col("node").alias("query"), F.col("vec").alias("q_vec")), "query")
    found = asked.join(_answers(index, walk, vecs, k + 1), "query").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(index: Index, queries: DataFrame, k: int = 10, id_col: str = "query_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of any vectors' k nearest rows; the walk starts at a sample of ENTRIES nodes."""
    asked = stored(usable(queries, id_col, vec_col).select(F.col("vec_id").alias("query"), "vec"), "queries")
    entries = index.graph.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).agg(F.collect_list("node")).first()[0]
    codes = coded(asked, index.dims, "query")
    walk = walked(index, codes, asked.select("query", F.explode(F.array(*[F.lit(n) for n in entries]).cast("array<long>")).alias("node")), asked.count())
    near = walk.select("query", F.explode(F.slice("beam", 1, RESCORED)).alias("node"))
    got = near.join(index.nodes, "node").join(asked.withColumnRenamed("vec", "q_vec"), "query").select("query", distance("q_vec", "vec").alias("score"), F.explode("members").alias("vec_id"))
    w = Window.partitionBy("query").orderBy("score", "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def searched(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """members_nearest for the rows of vectors (vec_id, embedding) whose vec_id is divisible by every, against all rows."""
    index = build(vectors, k)
    return members_nearest(index, index.rows.where(F.col("vec_id") % every == 0), k)
