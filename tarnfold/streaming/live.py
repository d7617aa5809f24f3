"""Structured Streaming twins: the request limiter with state, indexing of changes, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited(requests: DataFrame, key: str, second: str, limit: int, window: int = 60) -> DataFrame:
    """A stream of requests (key, second) with admitted: fewer than limit different seconds of the last window were admitted.

    The state of a key is the seconds of one window. Rows of a batch are taken in order of time.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        f = pd.concat(frames).sort_values(second)
        out = []
        for s in f[second]:
            log = [x for x in log if x > s - window]
            ok = len(log) < limit
            if ok and (not log or log[-1] != s):
                log.append(int(s))
            out.append(ok)
        state.update((log,))
        yield pd.DataFrame({key: [k[0]] * len(f), second: f[second].to_numpy(), "admitted": out})

    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, second)}
    return requests.select(key, second).groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{second}` {kinds[second]}, admitted boolean", "log array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Counts by event time, late rows dropped after the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def on_change(changes: DataFrame, index: Callable[[DataFrame], None], checkpoint: str):
    """Runs an indexing step over each batch of changed documents; the newest change of a document counts."""

    def step(batch: DataFrame, _: int) -> None:
        index(batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*"))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
