"""Texts packed by block: what moves through a shuffle is a few compressed Arrow streams a task, not rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

PACK_BYTES = 16 << 20
_ZSTD = pa.Codec("zstd", 3)


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    blocks, rest = blocks[order], table.drop_columns(["block"])
    at = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    for a, b in zip(at, at[1:], strict=False):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest.take(pa.array(order[a:b])).combine_chunks())
        raw = sink.getvalue()  # compressed as a whole, so that a pack of one short text costs little more than the text
        pack = len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a])], pa.int64()), pa.array([pack], pa.binary())], ["block", "pack"])


def packed(docs: DataFrame) -> DataFrame:
    """(block, pack) from docs with a long column block; a pack holds some of a block's rows without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PACK_BYTES:
                yield from _pack(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from _pack(pa.Table.from_batches(held))

    return mapped(docs, run, "block long, pack binary")


def unpacked(packs: pa.ChunkedArray) -> pa.Table:
    raw = (p.as_buffer() for p in packs)
    return pa.concat_tables([pa.ipc.open_stream(_ZSTD.decompress(b[8:], int.from_bytes(b[:8].to_pybytes(), "little"))).read_all() for b in raw]).combine_chunks()
