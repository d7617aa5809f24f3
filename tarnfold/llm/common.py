"""What the operators share: tables, shared folders, and what workers keep."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_ROOTS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode, where the session may name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under one of this application that goes when its driver ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/{sc.applicationId}"
    if root not in _ROOTS:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[str, tuple[str, object]] = {}


def kept(owner: str, key: str, make: Callable):
    """What a worker process keeps between tasks, made when key is new. Only one owner's: tasks of others drop it."""
    had = _KEPT.get(owner)
    if had is None or had[0] != key:
        _KEPT.clear()
        _KEPT[owner] = had = (key, make())
    return had[1]


def tidied(owner: str = "") -> None:
    """Drop what other owners' tasks keep in this worker, and give freed memory back to the system."""
    for other in [x for x in _KEPT if x != owner]:
        del _KEPT[other]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema: str, owner: str = "") -> DataFrame:
    """df.mapInArrow(run, schema); workers are reused, so a task leaves nothing behind but what owner keeps."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied(owner)
        yield from run(batches)
        tidied(owner)

    return df.mapInArrow(steps, schema)


def by_group(f: Callable) -> Callable:
    """f for applyInArrow, of one group's tables or two; what it has used goes back to the system after each."""

    def one(a: pa.Table) -> pa.Table:
        out = f(a)
        tidied()
        return out

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        out = f(a, b)
        tidied()
        return out

    return one if f.__code__.co_argcount == 1 else two


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
