"""A stored vector index: lists of rows around pivots, of which a query probes the nearest, and signs of projections to choose what is rescored.

The pivots are the rows of least md5 of their ids, about two for each square root of the rows, at most MOST_LISTS: a sample of bounded size. Each row
belongs to the list of the pivot that is nearest by cosine and has a sketch of BITS signs of projections on fixed patterns
of +1 and -1. A search compares a query's sketch with those of the lists that it probes, block by block, keeps the nearest
few by differing signs, and computes their cosines on the vectors. Vectors with much structure need few lists; those of
no structure (random ones) have neighbours in most lists, so the share probed is a parameter.

Rows without a vector are left out. Ids are numbers, one row an id. A list of any size is dealt over blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..shipping import ship
from ..storage import kept_at
from .catalogue import lacking
from .retrieval import top

MOST_LISTS, BITS, BLOCK_ROWS = 4096, 512, 16_384
#: Share of the lists that a search probes, and rows rescored for each result.
PROBED, RESCORED = 0.85, 32


def lists_for(rows: int) -> int:
    return min(MOST_LISTS, max(1, math.ceil(2 * math.sqrt(rows))))


def pattern(bit: int, dims: int) -> list[int]:
    """+1 and -1 by the bits of a digest of the bit's number."""
    bits = "".join(f"{b:08b}" for i in range(-(-dims // 256)) for b in hashlib.sha256(f"{bit}-{i}".encode()).digest())
    return [1 if x == "1" else -1 for x in bits[:dims]]


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of dims doubles; shorter vectors are filled up with zeros, longer ones cut."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(a))
    flat = np.asarray(pc.fill_null(pc.list_flatten(a), 0.0), dtype=np.float64)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out, at = np.zeros((len(size), dims)), np.r_[0, np.cumsum(size)]
    for i, n in enumerate(size):
        out[i, : min(n, dims)] = flat[at[i] : at[i] + min(n, dims)]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def rows_at_once(lists: int, probes: int) -> int:
    """Rows that are placed together: at most 2 million cosines, and 32,768 rows of output."""
    return max(1, min(2_000_000 // max(lists, 1), 32_768 // max(probes, 1)))


def placed(vectors: DataFrame, pivots: np.ndarray, probes: int = 1) -> DataFrame:
    """(list, place, id, embedding, sketch): each row of vectors (id, embedding) with its nearest pivots, by cosine to six places."""
    ship(vectors.sparkSession)
    dims = pivots.shape[1]
    unit, planes = _unit(pivots), np.array([pattern(b, dims) for b in range(BITS)], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows_at_once(len(unit), probes)
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            x = _matrix(b.column("embedding"), dims)
            near = _unit(x) @ unit.T
            near = np.sign(near) * np.floor(np.abs(near) * 1e6 + 0.5)
            order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            words = np.packbits(x @ planes.T > 0, axis=1).view(">i8").astype(np.int64)
            n = order.shape[1]
            row = pa.array(np.repeat(np.arange(len(x)), n))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), pa.array(np.tile(np.arange(1, n + 1), len(x))), b.column("id").take(row), b.column("embedding").take(row), sketch.take(row)], ["list", "place", "id", "embedding", "sketch"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"list long, place long, id long, embedding {kind}, sketch array<long>")


class VectorIndex:
    """An index at a path: its pivots and its rows, sorted by list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def pivots(self) -> np.ndarray:
        """At most MOST_LISTS vectors, in order of their lists."""
        found = self.spark.read.parquet(f"{self.path}/pivots").orderBy("list").toArrow()
        dims = int(pc.max(pc.list_value_length(found.column("embedding"))).as_py() or 1) if found.num_rows else 1
        return _matrix(found.column("embedding"), dims)

    def _keep(self, placed_rows: DataFrame) -> None:
        kept_at(placed_rows.select("list", "id", "embedding", "sketch").repartitionByRange("list", "id").sortWithinPartitions("list", "id"), f"{self.path}/rows")


def write(vectors: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Make an index of all rows of vectors that have one."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("embedding")).where("id is not null and embedding is not null")
    n = lists or lists_for(v.count())
    first = v.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).toArrow()  # a sample of bounded size
    pivots = spark.createDataFrame(pa.table({"list": pa.array(range(first.num_rows), pa.int64()), "embedding": first.column("embedding")})) if first.num_rows else v.select(F.lit(0).cast("long").alias("list"), "embedding").limit(0)
    kept_at(pivots.coalesce(1), f"{path}/pivots")
    index = VectorIndex(spark, path)
    index._keep(placed(v, index.pivots()))
    return index


def updated(index: VectorIndex, changed: DataFrame, path: str, gone: DataFrame | None = None, id_col: str = "chunk_id", vector: str = "embedding") -> VectorIndex:
    """A new version of an index at another path: rows of changed ids replaced or added, ids of gone left out, the pivots kept."""
    v = changed.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("embedding"))
    out = v.select("id") if gone is None else v.select("id").union(gone.select(F.col(id_col).cast("long").alias("id")))
    rest = lacking(index.rows, out.distinct(), "id")
    kept_at(index.spark.read.parquet(f"{index.path}/pivots").coalesce(1), f"{path}/pivots")
    new = VectorIndex(index.spark, path)
    columns = ["list", "id", "embedding", "sketch"]
    new._keep(rest.select(*columns).unionByName(placed(v.where("id is not null and embedding is not null"), index.pivots()).select(*columns)))
    return new


def _alike(rows: pa.Table, asked: pa.Table, keep: int) -> pa.Table:
    """(query_id, id, apart): of a block of rows the nearest for each query of a block in its lists, by differing signs and then by id."""
    ids, queries = rows.column("id").to_numpy(), asked.column("query_id").to_numpy()
    words = [np.asarray(pc.list_flatten(t.column("sketch"))).reshape(t.num_rows, -1).view(np.uint64) for t in (rows, asked)]
    out = []
    order = np.argsort(ids, kind="stable")
    ids, words[0], lists = ids[order], words[0][order], rows.column("list").to_numpy()[order]
    probed, own = asked.column("lists").combine_chunks(), asked.column("own").to_pylist()
    for i in range(len(queries)):
        inside = np.isin(lists, probed[i].values.to_numpy())
        may = np.flatnonzero(inside & (ids != queries[i])) if own[i] else np.flatnonzero(inside)
        apart = np.bitwise_count(words[0][may] ^ words[1][i][None]).sum(1).astype(np.int64)
        if len(may) > keep:
            near = np.flatnonzero(apart <= np.partition(apart, keep - 1)[keep - 1])
            may, apart = may[near], apart[near]
        best = np.argsort(apart, kind="stable")[:keep]
        out.append((np.full(len(best), queries[i]), ids[may[best]], apart[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"query_id": pa.array(columns[0]), "id": pa.array(columns[1]), "apart": pa.array(columns[2])})


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", probed: float = PROBED, rescored: int = RESCORED, same: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, chunk_id, score, rank): about the k nearest rows of each query by cosine (to 4 places, ties by id).

    same keeps a row whose id is the query's.
    """
    pivots, keep = index.pivots(), k * rescored
    q = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).alias("embedding")).where("id is not null and embedding is not null")
    asked = placed(q, pivots, max(1, math.ceil(probed * len(pivots)))).select("list", F.col("id").alias("query_id"), "sketch", F.lit(not same).alias("own"))
    # neighbouring lists share a block, so that a task keeps few of many rows
    n = max(1, math.ceil(index.rows.count() / block))
    shared = F.floor(F.col("list") * n / len(pivots)) if len(pivots) else F.lit(0).cast("long")
    rows = index.rows.select(shared.alias("_g"), "list", "id", "sketch")
    asked = asked.groupBy("query_id", shared.alias("_g")).agg(F.collect_list("list").alias("lists"), F.first("sketch").alias("sketch"), F.first("own").alias("own"))  # of at most MOST_LISTS
    blocks = lambda d, name: d.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(rows, "_rs").join(blocks(asked, "_qs"), "_g")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    key = ["_g", "_a", "_b"]
    r = rows.join(sizes, "_g").select("_g", own("id", "_rs").alias("_a"), each("_qs").alias("_b"), "list", "id", "sketch").groupBy(*key)
    a = asked.join(sizes, "_g").select("_g", each("_rs").alias("_a"), own("query_id", "_qs").alias("_b"), "query_id", "sketch", "own", "lists").groupBy(*key)
    met = r.cogroup(a).applyInArrow(lambda x, y: _alike(x, y, keep), "query_id long, id long, apart long")
    near = top(met.withColumn("near", -F.col("apart")), "query_id", "id", keep, "near").select("query_id", "id")
    got = near.join(index.rows.select("id", F.col("embedding").alias("_c")), "id").join(q.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    scored = got.select("query_id", F.col("id").alias("chunk_id"), F.round(cosine(F.col("_q"), F.col("_c")), 4).alias("score"))
    return top(scored, "query_id", "chunk_id", k)
