"""Executors get this package with the first Python function that is sent to them, whatever their working folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}
#: Bytes of an Arrow batch between Spark and its Python workers, where the session sets none: batches of long texts
#: otherwise hold 64 MB on both sides of the pipe.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    sc = spark.sparkContext
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target
