"""State of sessions between batches: modes and facts of a tool-calling session, and calls that wait for their results.

Both keep their state in Spark's state store through stateful processors, which needs the RocksDB provider (with_state_store sets it).
What starts and ends within a batch never touches the store, as a call of it costs more than a row. A key's rows of one batch are taken in order; batches follow each other, so a stream gives the rows that the windows of
operators.replay and operators.evaluation give over the whole table, as long as a key's rows arrive in order of batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Spark also loads a processor in a worker beside the driver, which gets no shipped files: so processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Session(StatefulProcessor):
    """A session's mode, and the newest call of each of its sources; dropped when the session has been idle for too long."""

    def __init__(self, start: str, idle_ms: int | None, ttl_ms: int | None):
        self.start, self.idle_ms, self.ttl_ms = start, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mode = handle.getValueState("mode", "mode string, last long, written long")
        self.facts = handle.getMapState("facts", "source string", "seq long", self.ttl_ms)

    def _known(self, sources: set, written: int) -> dict:
        """The stored facts of some sources: one by one, or all of the session at once where these are few for each that is asked for."""
        if not written:
            return {}
        if written <= 16 * len(sources):
            return {k[0]: v[0] for k, v in self.facts.iterator()}
        return {x: v[0] for x in sources if (v := self.facts.getValue((x,))) is not None}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken = sorted(rows, key=lambda r: r["seq"])
        mode, last, written = self.mode.get() or (self.start, 0, 0)
        known = self._known({r["source"] for r in taken}, written)
        newest: dict = {}
        for r in taken:
            seq, source, ms = r["seq"], r["source"], r["ms"]
            if self.idle_ms is not None and last and ms - last > self.idle_ms:  # it has ended, though its timer is still to come
                yield Row(session=key[0], seq=None, mode=mode, supersedes=None, ended=True)
                mode, newest, known, written = self.start, {}, {}, 0
                self.facts.clear()
            last = max(last, ms)
            mode = r["decided"] if r["decided"] is not None else mode
            older = newest.get(source, known.get(source))
            newest[source] = seq
            yield Row(session=key[0], seq=seq, mode=mode, supersedes=older, ended=False)
        for source, seq in newest.items():
            self.facts.updateValue((source,), (seq,))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(last + self.idle_ms)
        self.mode.update((mode, last, written + len(newest.keys() - known.keys())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mode = (self.mode.get() or (self.start,))[0]
        self.mode.clear()
        self.facts.clear()
        yield Row(session=key[0], seq=None, mode=mode, supersedes=None, ended=True)

    def close(self) -> None:
        pass


def sessions(calls: DataFrame, start: str, idle_ms: int | None = None, ttl_ms: int | None = None, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream (session, seq, mode, supersedes, ended) of a stream of calls (session, seq, source, decided).

    decided is the mode that a call decides, or null; mode is what holds after it. supersedes is the call of the same source that
    was a fact until then. With idle_ms, and event times in ts, a session without calls for so long ends with a row of its
    last mode (ended, no seq), and begins anew if it comes back, whether its timer or its next call is seen first. With ttl_ms facts are forgotten that long after they were written.
    """
    mode = "EventTime" if idle_ms is not None else "ProcessingTime" if ttl_ms is not None else "None"
    d = calls.withWatermark(ts, late).withColumn("ms", F.unix_millis(F.col(ts))) if ts else calls.withColumn("ms", F.lit(0).cast("long"))
    columns = ["session", "seq", "source", "decided", "ms", *([ts] if ts else [])]
    kind = calls.schema["session"].dataType.simpleString()
    return d.select(*columns).groupBy("session").transformWithState(_Session(start, idle_ms, ttl_ms), f"session {kind}, seq long, mode string, supersedes long, ended boolean", "Append", mode)


class _Pairing(StatefulProcessor):
    """Equal calls of a run and their results, n-th with n-th; what waits too long is given up."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "calls long, results long, timer long")
        self.calls = handle.getMapState("calls", "n long", "seq long, ms long")
        self.early = handle.getMapState("early", "n long", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Waiting calls have one timer for the first of them, and each firing sets the next."""
        calls, results, timer = self.counts.get() or (0, 0, None)
        before, ahead = calls, results
        waiting: dict = {}
        early: dict = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            seq = r["seq"]
            if r["is_call"]:
                calls += 1
                if calls in early:  # its result came first, and answers nothing
                    del early[calls]
                elif before < calls <= ahead and self.early.containsKey((calls,)):
                    self.early.removeKey((calls,))
                else:
                    waiting[calls] = (seq, r["ms"])
                    continue
                yield Row(run=key[0], args=key[1], seq=seq, result_seq=None)
            else:
                results += 1
                if results in waiting:
                    yield Row(run=key[0], args=key[1], seq=waiting.pop(results)[0], result_seq=seq)
                elif results > calls:
                    early[results] = seq
                elif results <= before and (call := self.calls.getValue((results,))) is not None:
                    self.calls.removeKey((results,))
                    yield Row(run=key[0], args=key[1], seq=call[0], result_seq=seq)
        for n, call in waiting.items():
            self.calls.updateValue((n,), call)
        for n, seq in early.items():
            self.early.updateValue((n,), (seq,))
        first = min((ms for _, ms in waiting.values()), default=None)
        if first is not None and (timer is None or first + self.wait_ms < timer):
            timer = first + self.wait_ms
            self.handle.registerTimer(timer)
        self.counts.update((calls, results, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [(n, seq, ms) for (n,), (seq, ms) in self.calls.iterator()]
        for n, seq, ms in waiting:
            if ms + self.wait_ms <= now:
                self.calls.removeKey((n,))
                yield Row(run=key[0], args=key[1], seq=seq, result_seq=None)
        timer = min((ms + self.wait_ms for _, _, ms in waiting if ms + self.wait_ms > now), default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        calls, results, _ = self.counts.get()
        self.counts.update((calls, results, timer))

    def close(self) -> None:
        pass


def paired(messages: DataFrame, wait_ms: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream (run, args, seq, result_seq) of a stream of messages (run, args, seq, is_call, ts): each call once, with its result or null.

    Results answer equal calls of a run in order; one that comes before its call answers nothing. A call is given up, and its
    state dropped, once the watermark is wait_ms past it; a result that comes later still counts as the one of that call.
    """
    d = messages.withWatermark(ts, late).withColumn("ms", F.unix_millis(F.col(ts))).select("run", "args", "seq", "is_call", "ms", ts)
    kinds = [messages.schema[c].dataType.simpleString() for c in ("run", "args")]
    return d.groupBy("run", "args").transformWithState(_Pairing(wait_ms), f"run {kinds[0]}, args {kinds[1]}, seq long, result_seq long", "Append", "EventTime")


def answered(calls: DataFrame, results: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streams of calls (call_id, called_at, ...) and results (call_id, returned_at, ...) joined: each call with its result, or with
    nulls once none can come any more.

    Results count that return within so long of their call; both sides' state goes when the watermark is past that.
    """
    c = calls.withWatermark("called_at", late)
    r = results.withColumnRenamed("call_id", "answers").withWatermark("returned_at", late)
    on = (F.col("call_id") == F.col("answers")) & (F.col("returned_at") >= F.col("called_at")) & (F.col("returned_at") <= F.col("called_at") + F.expr(f"INTERVAL {within}"))
    return c.join(r, on, "left").drop("answers")
