"""Removal of long repeated byte strings, by prefix-free parsing.

Rolling-hash triggers cut texts into phrases: a trigger is a place where the hash of GRAM bytes is divisible by
TRIGGER. A window of LENGTH bytes belongs to the first trigger in it (to its least hash, where it has none), so equal
windows belong to equal triggers at equal distances. What precedes the trigger is a suffix of a phrase of the
dictionary; what follows is the parse, read on from the next phrase.

- Parse: for each trigger, the context made of the windows that belong to it (up to 2 LENGTH - GRAM bytes), named by the
  hash of its bytes. All occurrences of a context but the first repeat all of its windows: that is nearly all
  of a highly repetitive text, and settled by names (104 bits, with the trigger's).
- Dictionary and parse: of different contexts of one trigger the bytes are fetched. Their phrase suffixes are sorted from the
  trigger backwards, their continuations forwards, each with the bytes that neighbours have in common. For
  each distance from the trigger the two orders combine into the corpus order of the windows, and equal ones are
  neighbours there; the first in the order of (doc_id, place) stays.

Rows meet by trigger, sorted by Spark and read as a stream. A trigger with more than HOT different contexts is split: windows at
neighbouring distances go by the bytes that they all share, and where that is too many again, each by all its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, mapped, parts, ship, stored
from .packs import packed, unpacked
from .textnum import _RINV, column_bytes, mix, powers, prefix, runs

LENGTH, GRAM, TRIGGER = 100, 32, 32
#: Contexts of a trigger that are sorted in one task, and distances from it that a part of a hot one has.
HOT, DISTANCES = 1024, 9
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 1 << 20
_PLACE_BITS = 22
_SEGMENT = 512 << 10
_NULL_ID = -(1 << 63)


def _least(v: np.ndarray, k: int) -> np.ndarray:
    """Least of each k neighbours: running minima forwards and backwards within blocks of k."""
    n = len(v) - k + 1
    wide = np.full(-(-len(v) // k) * k, np.uint64(2**64 - 1))
    wide[: len(v)] = v
    wide = wide.reshape(-1, k)
    forward = np.minimum.accumulate(wide, 1).ravel()
    backward = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[k - 1 : k - 1 + n])


def designated(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of gram bytes, and for each window of length bytes the place of its trigger."""
    p = prefix(data)
    n = len(data) - gram + 1
    g = mix((p[gram:] - p[:-gram]) * powers(_RINV, len(p))[:n])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    rank = np.where(g % np.uint64(TRIGGER) == 0, np.uint64(0), g & ~low) | np.arange(n, dtype=np.uint64)
    return g, (_least(rank, length - gram + 1) & low).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts in at most 2^22 bytes of texts: trigger hash, name, text number, first window, further windows."""
    gram = min(gram, length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    g, trigger = designated(data, length, gram)
    room = np.diff(offsets) - length + 1
    docs = np.repeat(np.arange(len(room)), np.maximum(room, 0))
    if not len(docs):
        return none, none, none, none, none
    ends = np.cumsum(np.maximum(room, 0))
    at = np.arange(len(docs)) - np.repeat(ends - np.maximum(room, 0), np.maximum(room, 0)) + offsets[docs]
    t = trigger[at]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (docs[1:] != docs[:-1])]))
    last = np.append(new[1:], len(t)) - 1
    lo, hi, t = at[new], at[last], t[new]
    raw, name = data.tobytes(), xxhash.xxh3_64_intdigest
    names = np.array([name(raw[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64)
    return (g[t] >> np.uint64(24)).astype(np.int64), names.view(np.int64), docs[new], lo - offsets[docs[new]], hi - lo


_PHRASE = "trigger long, phrase long, doc_id long, lo int, more short"


def _settled_here(trigger: np.ndarray, phrase: np.ndarray, doc: np.ndarray, lo: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks occurrences that are not the first of their phrase among these rows: they repeat it, whatever others hold.

    Marked rows have -1 - more for more, and a trigger of their own by which they spread over all tasks; so a phrase that a
    third of all texts hold sends one row from here to where it is settled.
    """
    order = np.lexsort((lo, doc, phrase, trigger))
    t, p, d, o = trigger[order], phrase[order], doc[order], lo[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    again = order[~new & ((d != d[first]) | (o != o[first]))]
    trigger, phrase, more = trigger.copy(), phrase.copy(), more.copy()
    trigger[again] = (mix(doc[again].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo[again].astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
    phrase[again] = 0
    more[again] = -1 - more[again]
    return trigger, phrase, doc, lo, more


def _parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        ids = np.asarray(batch.column(0))
        found = []
        for i, j in runs(offsets, _SEGMENT):
            a, b = int(offsets[i]), int(offsets[j])
            if j > i + 1 or b - a <= _SEGMENT:
                cuts = [(a, b, offsets[i : j + 1] - a, 0)]
            else:  # a very long text: windows that start in each segment
                cuts = [(s, min(s + _SEGMENT + length - 1, b), None, s - a) for s in range(a, b, _SEGMENT)]
            for s, e, own, shift in cuts:
                trigger, phrase, doc, lo, more = phrases(data[s:e], np.array([0, e - s]) if own is None else own, length)
                found.append((trigger, phrase, ids[i + doc], lo + shift, more))
        if found:
            trigger, phrase, doc, lo, more = _settled_here(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(trigger), pa.array(phrase), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(more.astype(np.int16))], ["trigger", "phrase", "doc_id", "lo", "more"])


_SPAN = "doc_id long, lo int, hi int, trigger long"


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, trigger: np.ndarray | None = None) -> pa.RecordBatch:
    t = pa.nulls(len(doc), pa.int64()) if trigger is None else pa.array(trigger)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), t], ["doc_id", "lo", "hi", "trigger"])


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From phrases sorted by trigger, phrase and place: spans that repeat (trigger null), and the first occurrences of
    phrases whose trigger has others (their first and last window)."""
    last_t = last_p = None
    lead_at = (0, 0)
    held: tuple | None = None  # the latest first occurrence, and whether it has been told
    for batch in batches:
        t, p, doc, lo, more = (np.asarray(c) for c in batch.columns)
        lo, more = lo.astype(np.int64), more.astype(np.int64)
        marked = more < 0
        if marked.any():
            yield _spans(doc[marked], lo[marked], lo[marked] - 1 - more[marked] + length)
            t, p, doc, lo, more = (x[~marked] for x in (t, p, doc, lo, more))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        new[0] = t[0] != last_t or p[0] != last_p
        last_t, last_p = t[-1], p[-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
        lead_doc, lead_lo = np.where(lead < 0, lead_at[0], doc[lead]), np.where(lead < 0, lead_at[1], lo[lead])
        lead_at = (int(lead_doc[-1]), int(lead_lo[-1]))
        again = ~new & ((doc != lead_doc) | (lo != lead_lo))  # a row that repeats a doc_id is the same place
        if again.any():
            yield _spans(doc[again], lo[again], lo[again] + more[again] + length)
        first = np.stack([t[new], doc[new], lo[new], lo[new] + more[new]])
        told = np.zeros(first.shape[1], bool)
        if held is not None:
            first, told = np.concatenate([held[0], first], 1), np.concatenate([[held[1]], told])
        if not first.shape[1]:
            continue
        same = first[0, 1:] == first[0, :-1]
        shared = np.zeros(first.shape[1], bool)
        shared[1:] |= same
        shared[:-1] |= same
        tell = shared & ~told
        if tell.any():
            yield _spans(first[1, tell], first[2, tell], first[3, tell], first[0, tell])
        held = (first[:, -1:], bool(shared[-1] or told[-1]))


_CONTEXT = "trigger long, doc_id long, lo int, bytes binary"
_CONTEXT_ARROW = pa.schema([("trigger", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("bytes", pa.binary())])


def _fetch(packs: pa.Table, spans: pa.Table, length: int) -> pa.Table:
    """Contexts with their bytes, from the texts of a block."""
    found = _texts_of(packs) if packs.num_rows and spans.num_rows else {}
    rows = []
    for d, a, b, t, hot in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "trigger", "hot")), strict=True):
        rows += [(t, d, a, x[a : b + length], hot) for x in found.get(d, []) if len(x) >= b + length]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT_ARROW, strict=False)] + [pa.array(cols[4], pa.bool_())], [*_CONTEXT_ARROW.names, "hot"])


def _texts_of(packs: pa.Table) -> dict[int, list[bytes]]:
    docs = unpacked(packs.column("pack"))
    found: dict[int, list[bytes]] = {}
    for d, x in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).combine_chunks(), strict=True):
        x = x.as_py() or b""
        if x not in (own := found.setdefault(d, [])):
            own.append(x)
    return found


def _places(data: list[bytes], length: int) -> np.ndarray:
    """Where in each context its trigger is."""
    sizes = np.array([len(x) for x in data])
    start = np.cumsum(sizes) - sizes
    out = []
    for i, j in runs(np.append(start, sizes.sum()), _SEGMENT):
        _, t = designated(np.frombuffer(b"".join(data[i:j]), np.uint8), length, min(GRAM, length))
        out.append(t[start[i:j] - start[i]] - (start[i:j] - start[i]))
    return np.concatenate(out)


def _sorted_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each shares with the one before it in that order (0: the first)."""
    m = np.ascontiguousarray(m)
    order = np.argsort(m.view(f"S{m.shape[1]}").ravel(), kind="stable")
    apart = m[order[1:]] != m[order[:-1]]
    return order, np.concatenate([[0], np.where(apart.any(1), apart.argmax(1), m.shape[1])])


def repeated_windows(doc: np.ndarray, lo: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc_id, lo, hi) of bytes covered by windows of these contexts that are not the first of their kind."""
    t = _places(data, length)
    at = lo + t
    order = np.lexsort((at, doc))
    doc, at, t, data = doc[order], at[order], t[order], [data[k] for k in order.tolist()]
    sizes = np.array([len(x) for x in data])
    text = np.frombuffer(b"".join(data), np.uint8)
    own = (np.cumsum(sizes) - sizes + t)[:, None]
    gram = min(GRAM, length)
    back, ahead = np.arange(length - gram)[None], np.arange(length)[None]
    before = np.where(back < t[:, None], text[np.maximum(own - 1 - back, 0)], 0).astype(np.uint8) if length > gram else np.zeros((len(t), 1), np.uint8)
    after = np.where(ahead < (sizes - t)[:, None], text[np.minimum(own + ahead, len(text) - 1)], 0).astype(np.uint8)
    (left, left_same), (right, right_same) = _sorted_rows(before), _sorted_rows(after)
    marks = np.zeros((len(t), length - gram + 3), bool)  # a column on either side stays empty
    suffix, rest = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    for o in range(length - gram + 1):
        on = np.flatnonzero((t >= o) & (sizes - t >= length - o))
        if len(on) < 2:
            continue
        suffix[left] = np.cumsum(left_same < o)
        rest[right] = np.cumsum(right_same < length - o)
        key = suffix[on] * (len(t) + 1) + rest[on]
        by = np.argsort(key, kind="stable")  # contexts are in order of place, so the first of equal ones leads
        k = key[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        x, first = on[by], on[by[lead]]
        # one place can be in several contexts (segments of a long text): it does not repeat itself
        marks[x[~new & ((doc[x] != doc[first]) | (at[x] != at[first]))], o + 1] = True
    edge = np.diff(marks.astype(np.int8), axis=1)
    row, nearest = np.nonzero(edge == 1)
    _, beyond = np.nonzero(edge == -1)
    return doc[row], at[row] - beyond + 1, at[row] - nearest + length


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by trigger; whole triggers are taken together, about GROUP_BYTES at a time."""
    held, size, last = [], 0, None

    def found() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        doc, lo = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "lo"))
        return _spans(*repeated_windows(doc, lo, table.column("bytes").to_pylist(), length))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = np.asarray(batch.column(0))
        cut = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
        for a, b in zip(cut, cut[1:], strict=False):
            if size > GROUP_BYTES and t[a] != last:
                yield found()
                held, size = [], 0
            last = t[a]
            held.append(batch.slice(a, b - a))
            size += (b - a) * length
    if held:
        yield found()


def _split(batches: Iterator[pa.RecordBatch], length: int, distances: int) -> Iterator[pa.RecordBatch]:
    """Contexts as parts of windows at so many neighbouring distances from the trigger, under a name of the bytes they all share."""
    for batch in batches:
        rows = []
        if batch.num_rows:
            data = batch.column(3).to_pylist()
            for x, d, a, t in zip(data, batch.column(1).to_pylist(), batch.column(2).to_pylist(), _places(data, length).tolist(), strict=True):
                least = max(0, length - (len(x) - t))
                for o in range(least - least % distances, t + 1, distances):
                    near, far = max(o, least), min(o + distances - 1, t)
                    shared = x[t - o : t - o - distances + 1 + length]
                    rows.append((xxhash.xxh3_64_intdigest(shared, o) - (1 << 63), d, a + t - far, x[t - far : t - near + length]))
                    if len(rows) == 1 << 14:
                        yield _contexts(rows)
                        rows = []
        yield _contexts(rows)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT_ARROW, strict=True)], schema=_CONTEXT_ARROW)


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows sorted by name, bytes and place: those after the first of their kind."""
    lead: tuple | None = None
    for batch in batches:
        doc, lo, hi = [], [], []
        for t, d, a, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lead is None or lead[:2] != (t, x):
                lead = (t, x, d, a)
            elif lead[2:] != (d, a):
                doc.append(d)
                lo.append(a)
                hi.append(a + len(x))
        yield _spans(np.array(doc, np.int64), np.array(lo, np.int64), np.array(hi, np.int64))


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi) of repeated windows among contexts whose triggers have no more than HOT or so."""
    n = parts(contexts.sparkSession)
    by_trigger = contexts.select("trigger", "doc_id", "lo", "bytes").repartition(n, "trigger").sortWithinPartitions("trigger")
    return mapped(by_trigger, lambda b: _compare(b, length), _SPAN).select("doc_id", "lo", "hi")


def compared_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same of contexts of hot triggers, by parts of them."""
    n = parts(contexts.sparkSession)
    split = stored(mapped(contexts.select("trigger", "doc_id", "lo", "bytes"), lambda b: _split(b, length, DISTANCES), _CONTEXT), "split")
    many = stored(split.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("hot", F.col("n") > HOT).drop("n"), "many")
    split = split.join(many, "trigger")  # a part that no other shares its bytes with repeats nothing
    single = mapped(split.where("hot").select("trigger", "doc_id", "lo", "bytes"), lambda b: _split(b, length, 1), _CONTEXT)
    single = single.repartition(n, "trigger").sortWithinPartitions("trigger", "bytes", "doc_id", "lo")
    return compared(split.where("not hot"), length).union(mapped(single, _equal_windows, _SPAN).select("doc_id", "lo", "hi"))


def repeated_spans(d: DataFrame, packs: DataFrame, n_blocks: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, lo, hi): byte spans covered by windows that start earlier elsewhere, from d (doc_id, text) and its packs."""
    n = parts(d.sparkSession)
    parse = mapped(d.select("doc_id", "text"), lambda b: _parse(b, length), _PHRASE)
    sorted_ = parse.repartition(n, "trigger").sortWithinPartitions("trigger", "phrase", "doc_id", "lo")
    settled = stored(mapped(sorted_, lambda b: _settle(b, length), _SPAN), "phrases")
    done = settled.where("trigger is null").select("doc_id", "lo", "hi")
    entries = settled.where("trigger is not null")
    hot = stored(entries.groupBy("trigger").count().where(F.col("count") > HOT).select("trigger", F.lit(True).alias("hot")), "hot")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))
    entries = entries.join(hot, "trigger", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("block", block)
    fetched = packs.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(by_group(lambda p, s: _fetch(p, s, length)), f"{_CONTEXT}, hot boolean")
    if hot.isEmpty():
        return done.union(compared(fetched, length))
    fetched = stored(fetched, "contexts")
    return done.union(compared(fetched.where("not hot"), length)).union(compared_hot(fetched.where("hot"), length))


def removed(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, min(b, n)) for a, b in out if a < n]


def kept_bytes(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for c in cut for x in c), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _finish(packs: pa.Table, spans: pa.Table, with_text: bool, schema: pa.Schema) -> pa.Table:
    if not packs.num_rows:
        return schema.empty_table()
    by_doc: dict[int, list] = {}
    for d, a, b in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "lo", "hi")), strict=True):
        by_doc.setdefault(d, []).append((a, b))
    docs = unpacked(packs.column("pack"))
    rows = []
    for d, x in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).combine_chunks(), strict=True):
        text = x.as_py() or b""
        cut = removed(len(text), by_doc.get(d, []))
        kept = kept_bytes(text, cut) if cut else text
        rows.append((None if d == _NULL_ID else d, len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
    cols = list(zip(*rows, strict=True))
    out = {name: cols[k] for k, name in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")[:5])} | ({"kept_text": cols[5]} if with_text else {})
    rest = [c for c in docs.column_names if c not in ("doc_id", "text")]
    table = pa.table(out | {c: docs.column(c) for c in rest})
    return table.select(schema.names).cast(schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and kept_text, and the columns of keep) of each row of docs (doc_id, text).

    Every byte is removed that is covered by a string of length bytes which also starts earlier: in a smaller doc_id,
    or earlier in the same text. Null and shorter texts have nothing to remove. Null doc_ids come before all
    others. Rows that repeat a doc_id are the same place: they don't repeat each other, and what is removed at
    a place of one is removed in each. kept_text drops characters that a cut leaves incomplete.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    size = d.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))
    packs = packed(d.withColumn("block", block))  # one plan for both uses, so that its exchange is written once
    spans = repeated_spans(d, packs, n_blocks, length)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `{c}` {kinds[c]}" for c in keep)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return packs.groupBy("block").cogroup(spans.withColumn("block", block).groupBy("block")).applyInArrow(by_group(lambda p, s: _finish(p, s, with_text, arrow)), schema)
