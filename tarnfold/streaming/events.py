"""Server-sent events put together from packets that cut them anywhere.

A connection's packets come in order of their numbers. A line ends at a line feed, wherever packets end; `event: ` names what
follows, `data: ` is an event of the name that holds. A connection ends with its first `done` or `error`, or
where the next packet is more than a gap away; what follows is passed over, as is a last line without its line feed. Bytes
of one character may lie in two packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

GAP_MS, LAST = 30_000, ("done", "error")
EVENTS = "n long, event string, data string"


class _Parser:
    """State between packets: the rest of a line, the event's name, the time of the last packet, whether the end has come."""

    def __init__(self) -> None:
        self.rest, self.name, self.last, self.ended, self.n = b"", "", None, False, 0

    def feed(self, ms: int, packet: bytes, gap_ms: int) -> list[tuple[int, str, str]]:
        self.ended = self.ended or (self.last is not None and ms - self.last > gap_ms)
        self.last, out = ms, []
        if self.ended or not packet:
            return out
        *whole, self.rest = (self.rest + packet).split(b"\n")
        for raw in whole:
            line = raw.decode("utf-8", "replace")
            if line.startswith("event: "):
                self.name = line[7:].strip()
            elif line.startswith("data: "):
                self.n += 1
                out.append((self.n, self.name, line[6:]))
                if self.name in LAST:
                    self.ended = True
                    break
        return out


def parsed(packets: DataFrame, connection: str = "connection", order: str = "seq", ms: str = "ms", data: str = "data", gap_ms: int = GAP_MS) -> DataFrame:
    """(connection, n, event, data) of packets (connection, seq, ms, data as bytes or text), n from 1 within a connection.

    Packets are sorted by Spark and pass through as a stream; what is held is the rest of one line of one connection.
    """
    ship(packets.sparkSession)
    kind = packets.schema[connection].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parser = None, _Parser()
        for f in frames:
            out = []
            for c, t, packet in zip(f["c"], f["t"], f["p"], strict=True):
                if c != now:
                    now, parser = c, _Parser()
                out += [(c, *e) for e in parser.feed(t, bytes(packet), gap_ms)]
            yield pd.DataFrame(out, columns=["c", "n", "event", "data"])

    d = packets.select(F.col(connection).alias("c"), F.col(order).alias("o"), F.col(ms).alias("t"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("p")).where("c is not null")
    return d.repartition("c").sortWithinPartitions("c", "o").mapInPandas(run, f"c {kind}, {EVENTS}").withColumnRenamed("c", connection)
