"""A bigram language model with deleted interpolation, counted over the whole corpus and scored for every text.

    p(w | v) = l(b) c(v w) / c(v) + (1 - l(b)) (c(w) + 1) / (N + V + 1),   b = the power of two that c(v) reaches

The weight l of each bucket b of context frequencies is learned by expectation-maximisation: counts of some
training texts (the deleted part) are held out, and the weights that suit them under the others' counts are found.

Counts never gather in one place. Texts are dealt over blocks of about BLOCK_BYTES. A block sends each of its
different words and word pairs once, as sorted hashes in at most FAN ranges, to units that merge up to FAN blocks'
messages for one range. Units send what they have merged on in the same way, so what a block sends doesn't grow with the
number of blocks, until a unit has all of its range; totals then go back the way the keys came, in the order of
each message. A hot word costs one entry a message. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, ship, stored
from .packs import packed, unpacked
from .textnum import column_bytes, mix, runs, word_hashes

BLOCK_BYTES = 8 << 20
TRAIN, DELETED, HELD_OUT = 0, 1, 2
BUCKETS, STEPS = 40, 32
_END = np.uint64(0x5DEECE66D1234567)
#: Most messages that a block or unit sends at a level, and most that a unit merges.
FAN = 8192
_UNIT_BITS = 28


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens (their words, then an end each), of the pairs of each with the one before (an end
    before the first), and len+1 offsets by text."""
    data, offsets = column_bytes(texts)
    parts, sizes = [], []
    for i, j in runs(offsets):
        words, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(first)
        out = np.full(len(words) + len(n), _END, np.uint64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        parts.append(out)
        sizes.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    t, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    before = np.concatenate([[_END], t[:-1]])  # the text before ends in an end
    return t, mix(before * np.uint64(0xD1B54A32D192ED03) + t), at


def _keys_blob(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their order, without leading bytes that are all zero."""
    first = int(keys[0]) if len(keys) else 0
    d = np.diff(keys, prepend=keys[:1])
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = 8 - next((k for k in range(8) if planes[7 - k].any()), 8)
    return first.to_bytes(8, "little") + len(keys).to_bytes(8, "little") + bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes()


def _keys(blob: bytes) -> np.ndarray:
    first, n, used = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little"), blob[16]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(blob, np.uint8, offset=17).reshape(used, n)
    d = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)
    return np.cumsum(d, dtype=np.uint64) + np.uint64(first)


def _ints(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    width = 1 if (most := int(x.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _from_ints(blob: bytes, n: int | None = None) -> np.ndarray:
    out = np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)
    if n is not None and len(out) != n:
        raise ValueError("counts do not match their keys")
    return out


@dataclass(frozen=True)
class Level:
    """Senders of one range of keys (of done equal ranges) split it into ranges, and fan of them share each receiver."""

    fan: int
    ranges: int
    done: int


def levels(blocks: int, parts: int, fan: int = FAN) -> list[Level]:
    """Levels by which so many blocks' keys come together in about so many parts."""
    out, done = [], 1
    while blocks > fan:
        out.append(Level(fan, fan, done))
        done, blocks = done * fan, -(-blocks // fan)
    return [*out, Level(fan, max(1, min(fan, -(-parts // done))), done)]


_NAMES = ("word", "pair")
_SENT = "unit long, sender long, place int, wants boolean" + "".join(f", {x}s binary, {x}_counts binary, {x}_kept binary" for x in _NAMES)
_SENT_ARROW = pa.schema([("unit", pa.int64()), ("sender", pa.int64()), ("place", pa.int32()), ("wants", pa.bool_())] + [(c, pa.binary()) for x in _NAMES for c in (f"{x}s", f"{x}_counts", f"{x}_kept")])
_BACK = "unit long, place int, words binary, pairs binary, words_kept binary, pairs_kept binary, n long, v long, n_kept long, v_kept long"
_BACK_ARROW = pa.schema([("unit", pa.int64()), ("place", pa.int32())] + [(c, pa.binary()) for c in ("words", "pairs", "words_kept", "pairs_kept")] + [(c, pa.int64()) for c in ("n", "v", "n_kept", "v_kept")])


def _messages(sender: int, path: int, at: int, sums: dict[str, tuple], wants: bool, level: Level) -> pa.Table:
    """What a sender (number at among those of its range path) sends: keys with their counts, with and without the deleted part's."""
    edges = np.array([((path * level.ranges + k) << 64) // (level.done * level.ranges) for k in range(1, level.ranges)], np.uint64)
    rows: list[dict] = [{"unit": ((path * level.ranges + r) << _UNIT_BITS) | at // level.fan, "sender": sender, "place": r, "wants": wants} for r in range(level.ranges)]
    filled = np.zeros(level.ranges, bool)
    for name, (keys, counts, kept) in sums.items():
        cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            filled[r] |= b > a
            rows[r] |= {f"{name}s": _keys_blob(keys[a:b]), f"{name}_counts": _ints(counts[a:b]), f"{name}_kept": _ints(kept[a:b])}
    return pa.Table.from_pylist([x for x, full in zip(rows, filled, strict=True) if full], _SENT_ARROW)


def _send(packs: pa.Table, starts: list[int], level: Level) -> pa.Table:
    """A block's different words and pairs, with how often each is in it (training blocks only); starts are the kinds' first blocks."""
    block = packs.column("block")[0].as_py()
    kind = bisect_right(starts, block) - 1
    t, pairs, _ = tokens(unpacked(packs.column("pack")).column("text").combine_chunks())
    sums = {}
    for name, h in zip(_NAMES, (t, pairs), strict=True):
        keys, counts = np.unique(h, return_counts=True)
        sums[name] = (keys, counts * (kind != HELD_OUT), counts * (kind == TRAIN))
    return _messages(block, 0, block, sums, kind == DELETED, level)


def _merged(sent: pa.Table) -> tuple[dict[str, tuple], dict[str, list[np.ndarray]]]:
    """Sums by key over a unit's messages, and where each message's keys are among them."""
    sums, places = {}, {}
    for name in _NAMES:
        keys = [_keys(b.as_py()) for b in sent.column(f"{name}s")]
        sizes = [len(k) for k in keys]
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [np.concatenate([_from_ints(b.as_py(), n) for b, n in zip(sent.column(f"{name}_{c}"), sizes, strict=True)]) for c in ("counts", "kept")]
        sums[name] = (u, *(np.bincount(inverse, c, len(u)).astype(np.int64) for c in counts))
        places[name] = np.split(inverse, np.cumsum(sizes)[:-1])
    return sums, places


def _pass_on(sent: pa.Table, level: Level) -> pa.Table:
    unit = sent.column("unit")[0].as_py()
    return _messages(unit, unit >> _UNIT_BITS, unit & ((1 << _UNIT_BITS) - 1), _merged(sent)[0], bool(max(sent.column("wants").to_pylist())), level)


def _replies(sent: pa.Table, totals: dict[str, tuple], places: dict[str, list[np.ndarray]]) -> dict[str, list]:
    wants = sent.column("wants").to_pylist()
    out: dict = {"unit": sent.column("sender").to_pylist(), "place": sent.column("place").to_pylist()}
    for name in _NAMES:
        total, kept = totals[name]
        out[f"{name}s"] = [_ints(total[x]) for x in places[name]]
        out[f"{name}s_kept"] = [_ints(kept[x]) if w else None for w, x in zip(wants, places[name], strict=True)]
    return out


def _sum(sent: pa.Table) -> pa.Table:
    """Totals over all training texts, and without the deleted ones, for each message's keys in their order; and their sums."""
    sums, places = _merged(sent)
    out = _replies(sent, {k: v[1:] for k, v in sums.items()}, places)
    _, total, kept = sums["word"]
    whole = {"n": int(total.sum()), "v": int((total > 0).sum()), "n_kept": int(kept.sum()), "v_kept": int((kept > 0).sum())}
    rest = {f.name: [*out.get(f.name, [None] * sent.num_rows), whole.get(f.name)] for f in _BACK_ARROW}
    return pa.Table.from_pydict(rest, schema=_BACK_ARROW)


def _relay(sent: pa.Table, back: pa.Table) -> pa.Table:
    """The totals that came back to a unit, for each message that it has merged."""
    sums, places = _merged(sent)
    back = back.sort_by("place")
    totals = {name: tuple(_joined(back, f"{name}s{kept}", len(sums[name][0])) for kept in ("", "_kept")) for name in _NAMES}
    out = _replies(sent, totals, places)
    return pa.Table.from_pydict({f.name: out.get(f.name, [None] * sent.num_rows) for f in _BACK_ARROW}, schema=_BACK_ARROW)


def _joined(back: pa.Table, column: str, n: int) -> np.ndarray:
    """The totals of a sender's keys, from the replies to its messages in order of place."""
    if back.column(column).null_count:
        return np.zeros(n, np.int64)
    out = np.concatenate([_from_ints(b.as_py()) for b in back.column(column)])
    if len(out) != n:
        raise ValueError("replies do not match the keys that were sent")
    return out


def exchanged(sent: DataFrame, steps: list[Level]) -> DataFrame:
    """Replies (unit, place, ...) to the senders of sent, and rows without unit that hold sums; steps[0] made sent."""
    if len(steps) == 1:
        return stored(sent.groupBy("unit").applyInArrow(by_group(_sum), _BACK), "counts")
    sent = stored(sent, "messages")
    back = exchanged(sent.groupBy("unit").applyInArrow(by_group(lambda x: _pass_on(x, steps[1])), _SENT), steps[1:])
    relayed = sent.groupBy("unit").cogroup(back.where("unit is not null").groupBy("unit")).applyInArrow(by_group(_relay), _BACK)
    return stored(relayed.unionByName(back.where("unit is null")), "counts")


def _counts(h: np.ndarray, back: pa.Table, column: str) -> np.ndarray:
    """For each token (or pair) of a block, its total."""
    keys, inverse = np.unique(h, return_inverse=True)
    return _joined(back, column, len(keys))[inverse]


def _levels(t: np.ndarray, pairs: np.ndarray, back: pa.Table, kept: str, n: int, v: int) -> tuple[np.ndarray, ...]:
    """Counts of tokens, buckets of their contexts, maximum-likelihood and base probabilities."""
    back = back.sort_by("place")
    c, c2 = _counts(t, back, f"words{kept}"), _counts(pairs, back, f"pairs{kept}")
    context = np.concatenate([c[t == _END][:1], c[:-1]])  # the context of a first word is an end
    bucket = np.where(context > 0, np.minimum(BUCKETS - 1, np.log2(np.maximum(context, 1)).astype(np.int64)), -1)
    return c, bucket, c2 / np.maximum(context, 1), (c + 1) / (n + v + 1)


def _ratios(packs: pa.Table, back: pa.Table, n: int, v: int) -> pa.Table:
    """How many held-out tokens have each bucket and ratio of the two estimates (logarithms in STEPS a factor of two)."""
    t, pairs, _ = tokens(unpacked(packs.column("pack")).column("text").combine_chunks())
    _, bucket, p2, p1 = _levels(t, pairs, back, "_kept", n, v)
    with np.errstate(divide="ignore"):
        step = np.where(p2 > 0, np.round(STEPS * np.log2(p2 / p1)), -(1 << 20)).astype(np.int64)
    keys, counts = np.unique(np.stack([bucket, step], 1)[bucket >= 0], axis=0, return_counts=True)
    return pa.table({"bucket": pa.array(keys[:, 0], pa.int32()), "step": pa.array(keys[:, 1], pa.int32()), "n": pa.array(counts, pa.int64())})


def expectation_maximisation(rows: list[tuple[int, int, int]], rounds: int = 100) -> np.ndarray:
    """Weights by bucket from (bucket, step, n); a bucket that was never held out takes the one below (0.5 for the first)."""
    weights = np.full(BUCKETS, np.nan)
    for b in {r[0] for r in rows}:
        step, n = (np.array(x, float) for x in zip(*[r[1:] for r in rows if r[0] == b], strict=True))
        ratio = np.where(step > -(1 << 20), 2.0 ** (np.clip(step, -2000, 2000) / STEPS), 0)
        w = 0.5
        for _ in range(rounds):
            w = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[b] = w
    last = 0.5
    for b in range(BUCKETS):
        weights[b] = last = last if np.isnan(weights[b]) else weights[b]
    return weights


_SCORED = "n_tokens long, n_known long, base_score double, score double"


def _score(packs: pa.Table, back: pa.Table, n: int, v: int, weights: np.ndarray) -> pa.Table:
    docs = unpacked(packs.column("pack"))
    t, pairs, at = tokens(docs.column("text").combine_chunks())
    c, bucket, p2, p1 = _levels(t, pairs, back, "", n, v)
    w = np.where(bucket >= 0, weights[bucket], 0)
    total = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has an end, so no range is empty
    cols = {"doc_id": docs.column("doc_id"), "kind": docs.column("kind"), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(total((c > 0).astype(np.int64)))}
    return pa.table(cols | {"base_score": pa.array(total(np.log10(p1))), "score": pa.array(total(np.log10(w * p2 + (1 - w) * p1)))})


def interpolated_scores(docs: DataFrame, kind: Column, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, kind, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    kind is a column of TRAIN, DELETED (training too, but held out while weights are learned) or HELD_OUT. A null
    or empty text is one end. Repeated rows are counted and scored as often as they come. Without training
    rows all counts are 0; without deleted ones every weight is 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"))
    sizes = {r.kind: r.n for r in d.groupBy("kind").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()}
    n_blocks = [max(1, -(-sizes.get(k, 0) // block_bytes)) for k in (TRAIN, DELETED, HELD_OUT)]
    starts = [sum(n_blocks[:k]) for k in range(3)]
    steps = levels(sum(n_blocks), max(1, -(-sum(sizes.values()) // (2 * block_bytes))), fan)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("kind") + 1)
    d = d.withColumn("block", (pick(starts) + F.pmod(F.xxhash64("doc_id", "text"), pick(n_blocks))).cast("long"))
    packs = packed(d)
    back = exchanged(packs.groupBy("block").applyInArrow(by_group(lambda x: _send(x, starts, steps[0])), _SENT), steps)
    sums = back.where("unit is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept")]).first()
    n, v, n_kept, v_kept = sums.n, sums.v, sums.n_kept, sums.v_kept
    back = back.where("unit is not null")

    def met(p: DataFrame, b: DataFrame, f, schema: str) -> DataFrame:
        return p.groupBy("block").cogroup(b.groupBy("unit")).applyInArrow(by_group(f), schema)

    deleted = packed(d.where(F.col("kind") == DELETED))
    ratios = met(deleted, back.where(F.col("unit").between(starts[DELETED], starts[HELD_OUT] - 1)), lambda p, b: _ratios(p, b, n_kept, v_kept), "bucket int, step int, n long")
    weights = expectation_maximisation([tuple(r) for r in ratios.groupBy("bucket", "step").agg(F.sum("n")).collect()])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = met(packs, back, lambda p, b: _score(p, b, n, v, weights), f"doc_id {id_type}, kind int, {_SCORED}")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def folds(id_col: str = "doc_id", held: int = 2, deleted: int = 3) -> Column:
    """Kinds by crc32 of the id as text, mod 7."""
    m = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7))
    return F.when(m == held, HELD_OUT).when(m == deleted, DELETED).otherwise(TRAIN)


def scored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Rows whose fold is 2 are held out; null and empty texts, repeats and empty tables as in interpolated_scores.
    """
    out = interpolated_scores(docs, folds())
    return out.select("doc_id", (F.col("kind") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
