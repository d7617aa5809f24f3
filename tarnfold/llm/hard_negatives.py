"""Hard negatives by an R-tree packed by sort-tile-recursive: rows of a tree are tiles that Spark deals, a tile holds a subtree.

Rows are sorted by label and first component into slabs, each slab by the second component into tiles, both by range
partitioning with vec_id as the last key, so that copies of one vector spread over tiles. Within a tile they are sorted and cut
along the components of widest spread, down to leaves. A box gives each component's interval, hence an interval of the inner
product: the sum of the greater (or lesser) of a_i lo_i and a_i hi_i. Queries travel in blocks with a box of their own; a block
and a tile meet only if the interval of the two boxes can hold a score that some query of the block still wants, and in
the task one best-first queue over the subtree's boxes prunes for every query those outside its window, or strictly
below its k-th score so far, or with no row of a wanted label. About the square root of all tiles are searched first, and
what they give bounds the search of the rest.

Rows with a null id, label or vector, or with a null or a number in it that isn't finite, take no part; of rows with one id the
least (label, vector) counts. Scaled components are taken as 2^26 in size at most, so that scores fit a long; shorter vectors
count as filled up with zeros. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored

#: Rows of a tile, of a leaf, leaves under an inner box, and queries of a block.
TILE, LEAF, FAN, BLOCK = 8192, 64, 8, 8192
SCALE, LARGEST = 256, 1 << 26
NONE = -(1 << 62)  # no score is that low


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part: labels as they are, components floor(256 x)."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("x", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return d.withColumn("v", whole).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


# --- inside tasks


def _rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows, shorter ones filled up with zeros."""
    a = pa.chunked_array([vectors]).combine_chunks() if isinstance(vectors, pa.Array) else vectors.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    flat, size = np.asarray(a.flatten()).astype(np.int64), np.asarray(pc.list_value_length(a))
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None] < size[:, None]] = flat
    return out


def _packed(v: np.ndarray, ids: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Row numbers of leaves in tree order: sort by the widest component, tile, and so on with the next widest."""
    axes = np.argsort(-(v.max(0) - v.min(0)), kind="stable") if v.shape[1] else np.zeros(0, int)

    def cut(rows: np.ndarray, depth: int, leaves: int) -> list[np.ndarray]:
        if leaves <= 1 or depth >= len(axes):
            return [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
        o = np.lexsort((ids[rows], v[rows, axes[depth]]))
        slabs = max(2, round(leaves ** (1 / 2 if depth == 0 else 1)) if leaves <= FAN else FAN)
        step = LEAF * math.ceil(math.ceil(len(rows) / LEAF) / slabs)
        return [leaf for i in range(0, len(rows), step) for leaf in cut(rows[o[i : i + step]], depth + 1, math.ceil(leaves / slabs))]

    return cut(np.arange(len(ids)), 0, leaves)


def _tile(t: pa.Table, tile: int) -> pa.RecordBatch:
    v, ids, labels = _rows(t.column("v")), t.column("vec_id").to_numpy(), t.column("label").to_numpy()
    leaves = _packed(v, ids, math.ceil(len(ids) / LEAF))
    o, starts = np.concatenate(leaves), np.cumsum([0, *(len(x) for x in leaves[:-1])])
    columns = {
        "tile": [tile], "lo": [v.min(0).tolist()], "hi": [v.max(0).tolist()], "least_label": [int(labels.min())], "most_label": [int(labels.max())],
        "ids": [ids[o].astype("<i8").tobytes()], "labels": [labels[o].astype("<i8").tobytes()], "vectors": [v[o].astype("<i4").tobytes()], "starts": [starts.astype("<i4").tobytes()],
    }
    return pa.RecordBatch.from_pydict(columns, pa.schema([("tile", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("least_label", pa.int64()), ("most_label", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "starts"))]))


TILES = "tile long, lo array<long>, hi array<long>, least_label long, most_label long, ids binary, labels binary, vectors binary, starts binary"
BLOCKS = "block long, q_lo array<long>, q_hi array<long>, q_least long, q_most long, need long, bound long, queries binary, q_labels binary, own binary, windows binary, q_vectors binary"


def _block(t: pa.Table, block: int) -> pa.RecordBatch:
    v = _rows(t.column("v"))
    query, label, own, least, most = (t.column(c).to_numpy().astype("<i8") for c in ("query", "label", "own", "least", "most"))
    columns = {
        "block": [block], "q_lo": [v.min(0).tolist()], "q_hi": [v.max(0).tolist()], "q_least": [int(label.min())], "q_most": [int(label.max())], "need": [int(least.min())], "bound": [int(most.max())],
        "queries": [query.tobytes()], "q_labels": [label.tobytes()], "own": [own.tobytes()], "windows": [np.stack([least, most]).tobytes()], "q_vectors": [v.astype("<i4").tobytes()],
    }
    return pa.RecordBatch.from_pydict(columns, pa.schema([("block", pa.int64()), ("q_lo", pa.list_(pa.int64())), ("q_hi", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("q_least", "q_most", "need", "bound")), *((c, pa.binary()) for c in ("queries", "q_labels", "own", "windows", "q_vectors"))]))


def _gathered(make, most: int, step: int):
    """A mapInArrow function: a partition's rows as one table (or more, of some multiple of its rows), numbered apart from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n > 4 * most:
                t = pa.Table.from_batches(held)
                yield make(t.slice(0, most), t.column("_p")[0].as_py() + step * at)
                held, n, at = t.slice(most).to_batches(), n - most, at + 1
        if n:
            t = pa.Table.from_batches(held)
            yield make(t, t.column("_p")[0].as_py() + step * at)

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a b' of whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 52 else a @ b.T


class _Boxes:
    """Intervals of the inner products of a block's different vectors with each box of a level."""

    def __init__(self, a: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        pos, neg = np.maximum(a, 0), np.minimum(a, 0)
        self.upper, self.lower = _product(pos, hi) + _product(neg, lo), _product(pos, lo) + _product(neg, hi)


def _search(row: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id): the k first rows of a tile for each query of a block, by best-first search of the tile's boxes."""
    numbers = lambda c, kind="<i8": np.frombuffer(row[c], dtype=kind).astype(np.int64)
    ids, labels, starts = numbers("ids"), numbers("labels"), numbers("starts", "<i4")
    query, q_label, own = numbers("queries"), numbers("q_labels"), numbers("own")
    least, most = numbers("windows").reshape(2, -1)
    v, q = numbers("vectors", "<i4").reshape(len(ids), -1), numbers("q_vectors", "<i4").reshape(len(query), -1)
    width = max(v.shape[1], q.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
    _, one, of = np.unique(own, return_index=True, return_inverse=True)  # queries of one row share its vector
    a = q[one]
    parents = np.arange(0, len(starts), FAN)
    ends = np.r_[starts[1:], len(ids)]
    levels = []
    for s in (starts[parents], starts):
        few, many = np.minimum.reduceat(labels, s), np.maximum.reduceat(labels, s)
        levels.append((_Boxes(a, np.minimum.reduceat(v, s, axis=0), np.maximum.reduceat(v, s, axis=0)), few, many))
    scores, found = np.full((len(query), k), NONE, np.int64), np.full((len(query), k), np.iinfo(np.int64).max)

    def wanted(level: int, node: int) -> np.ndarray:
        boxes, few, many = levels[level]
        label = (few[node] <= q_label) & (q_label <= many[node]) if same else (few[node] != many[node]) | (few[node] != q_label)
        upper = boxes.upper[of, node]
        return np.flatnonzero(label & (upper >= np.maximum(least, scores[:, -1])) & (boxes.lower[of, node] <= most))

    def pushed(level: int, nodes: range) -> None:
        for node in nodes:
            who = wanted(level, node)
            if len(who):
                heapq.heappush(queue, (-int(levels[level][0].upper[of[who], node].max()), level, node))

    queue: list[tuple[int, int, int]] = []
    pushed(0, range(len(parents)))
    while queue:
        _, level, node = heapq.heappop(queue)
        if level == 0:
            pushed(1, range(node * FAN, min((node + 1) * FAN, len(starts))))
            continue
        who = wanted(1, node)  # bounds may have risen since it was pushed
        if not len(who):
            continue
        i, j = starts[node], ends[node]
        vectors, back = np.unique(of[who], return_inverse=True)
        s = _product(a[vectors], v[i:j])[back]
        ok = (labels[i:j][None] == q_label[who][:, None]) == same
        ok &= (ids[i:j][None] != own[who][:, None]) & (s >= np.maximum(least[who], scores[who, -1])[:, None]) & (s <= most[who][:, None])
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            continue
        who, s = who[some], np.where(ok[some], s[some], NONE)
        s = np.concatenate([scores[who], s], 1)
        n = np.concatenate([found[who], np.broadcast_to(ids[i:j], (len(who), j - i))], 1)
        o = np.lexsort((n, -s), axis=-1)[:, :k]
        scores[who], found[who] = np.take_along_axis(s, o, 1), np.take_along_axis(n, o, 1)
    at, place = np.nonzero(scores > NONE)
    return query[at], scores[at, place], found[at, place]


# --- on Spark


def pack(rows: DataFrame) -> DataFrame:
    """Tiles of rows (vec_id, label, v)."""
    n = rows.count()
    tiles = max(1, math.ceil(n / TILE))
    slabs = max(1, math.isqrt(tiles))
    first = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0))
    slabbed = rows.repartitionByRange(slabs, "label", first(0), "vec_id").withColumn("_slab", F.spark_partition_id())
    dealt = slabbed.repartitionByRange(tiles, "_slab", first(1), "vec_id").select("vec_id", "label", "v", F.spark_partition_id().alias("_p"))
    return mapped(dealt, _gathered(_tile, TILE, 1 << 32), TILES)


def _boxed(asked: DataFrame) -> DataFrame:
    """Blocks of queries (query, own, label, least, most, v), near ones together."""
    n = asked.count()
    key = F.coalesce(F.get("v", F.lit(0)), F.lit(0))
    dealt = asked.repartitionByRange(max(1, math.ceil(n / BLOCK)), "label", key, "own", "query").withColumn("_p", F.spark_partition_id().cast("long"))
    return mapped(dealt, _gathered(_block, BLOCK, 1 << 32), BLOCKS)


def _interval(pick) -> Column:
    """The sum of the picked ones of the four products of the ends of two boxes' intervals."""
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    ends = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.struct(x.alias("l"), y.alias("h")))
    each = F.zip_with(ends("q_lo", "q_hi"), ends("lo", "hi"), lambda a, b: zero(pick(a.l * b.l, a.l * b.h, a.h * b.l, a.h * b.h)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def _met(asked: DataFrame, tiles: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, score, id) of every block's best-first search of every tile that its box doesn't rule out."""
    blocks = stored(_boxed(asked), "blocks")
    numbers = sorted(r[0] for r in blocks.select("block").collect())  # one for some thousand queries
    heads = tiles.select("tile", "lo", "hi", "least_label", "most_label").withColumn("block", F.explode(F.array(*[F.lit(x) for x in numbers]).cast("array<long>")))
    met = heads.join(blocks.select("block", "q_lo", "q_hi", "q_least", "q_most", "need", "bound"), "block")
    label = F.expr("least_label <= q_most AND q_least <= most_label") if same else F.expr("NOT (least_label = most_label AND q_least = q_most AND least_label = q_least)")
    met = met.where(label & (_interval(F.greatest) >= F.col("need")) & (_interval(F.least) <= F.col("bound"))).select("block", "tile")
    pairs = met.join(tiles.select("tile", "ids", "labels", "vectors", "starts"), "tile").join(blocks.select("block", "queries", "q_labels", "own", "windows", "q_vectors"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                query, score, found = _search({c: b.column(c)[i].as_py() for c in b.schema.names}, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(found)], ["query", "score", "id"])

    return mapped(pairs, run, "query long, score long, id long")


def first_rows(asked: DataFrame, tiles: DataFrame, k: int, same: bool) -> DataFrame:
    """query, rank, id, score: each query's k first rows among those of its label (same) or of all others.

    asked (query, own, label, least, most, v): the row that asks, which is left out, its label, the window of scores, its
    vector. Higher scores come first, ties by smaller id.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n = tiles.count()
    seed = F.pmod(F.xxhash64("tile"), F.lit(max(1, math.isqrt(n)))) == 0
    early = stored(best(_met(asked, tiles.where(seed), k, same)), "early")
    floor = early.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    rest = asked.join(floor, "query", "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth")
    late = _met(rest, tiles.where(~seed), k, same)
    return best(early.select("query", "score", "id").union(late)).select("query", "rank", "id", "score")


def mined(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the head of this module.

    vectors (vec_id, embedding, label); where vec_id is divisible by 7 the label first becomes (label + 1) mod 10. Anchors are the rows
    whose vec_id is divisible by every. A negative's score is at least half the positive's, and 0.95 of it at most.
    """
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    rows = stored(usable(moved.select("vec_id", "embedding", "label")), "rows")
    tiles = stored(pack(rows), "tiles")
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("own"), "label", "v")
    asked = anchors.select(F.col("own").alias("query"), "own", "label", F.lit(NONE + 1).alias("least"), F.lit(-NONE).alias("most"), "v")
    found = first_rows(asked, tiles, positives, True).select(F.col("query").alias("own"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = stored(found.where("positive_score >= 0").withColumn("query", F.monotonically_increasing_id()), "positives")  # below 0 no score fits
    windows = found.join(anchors, "own").select("query", "own", "label", F.expr("(positive_score + 1) div 2").alias("least"), F.expr("95 * positive_score div 100").alias("most"), "v").where("least <= most")
    hard = first_rows(windows, tiles, negatives, False)
    return hard.join(found, "query").select(F.col("own").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
