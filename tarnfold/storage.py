"""Tables in the folder that the driver and all executors share: intermediate ones, and indexes that the caller keeps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


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
    return kept_at(df, fresh(df.sparkSession, label))


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """Write df at a path, in place of what is there, and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
