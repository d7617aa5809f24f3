"""Benchmark passages in documents, by spaced seeds.

A seed is the hash of those tokens of a span that a mask keeps; a substituted token under a mask's gap leaves it
whole. Seeds of the benchmark and of the documents are joined; a Bloom filter of the benchmark's, of bounded size, goes out
first, so that of the documents only seeds (and texts) that may be joined move. Where a document and an item share a seed they
are laid side by side, and of the stretches of which SHARE of the tokens agree that with most agreeing tokens
is taken: it counts if these are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, ship, stored, texts
from .textnum import WORDLIKE, column_bytes, mix, runs, word_hashes

#: One of them fits wherever at most one of five tokens disagrees, and no overlap is without such a place: 13 agreeing
#: tokens with at most a quarter as many others between them have a run of four, and in items of 5 to 16 tokens the
#: agreeing ones have such a run or two that make four around one other token. Items of fewer tokens must agree in
#: all of them, and have one seed: the whole item.
MASKS = ("1111", "11101", "11011", "10111")
SHORT = 4
#: Agreeing tokens that an overlap needs (or SHARE of the item's, if those are fewer), and their share of its length.
OVERLAP, SHARE = 13, 0.8
#: Bits of the filter a seed, its probes, and the least and most bits of all (as powers of two: 512 KB and 32 MB).
SEED_BITS, PROBES, LEAST_BITS, MOST_BITS = 32, 6, 22, 28
_SLICES = 64
_RNG = np.random.default_rng(991)
_WEIGHTS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int("1" + mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64))


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """Seeds at each place of t where the mask fits."""
    n = max(0, len(t) - len(mask) + 1)
    out = np.full(n, hash_of(mask), np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            out += t[k : k + n] * _WEIGHTS[k]
    return mix(out)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return MASKS if n > SHORT else ("1" * n,) if n else ()


def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's places of each seed."""
    step = mix(h ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for _ in range(PROBES):
        yield (h >> np.uint64(64 - bits)).astype(np.int64)
        h = h + step


def maybe(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Places in h of seeds that the filter does not rule out."""
    at = np.arange(len(h))
    step = mix(h ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for _ in range(PROBES):
        place = h >> np.uint64(64 - bits)
        ok = (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, h, step = at[ok], h[ok] + step[ok], step[ok]
    return at


def best_stretch(agree: np.ndarray, share: float = SHARE) -> tuple[int, int, int]:
    """Start, end and agreeing tokens of the stretch with most agreeing tokens of which the share agrees; the shortest, then first of equals."""
    percent = round(100 * share)
    total = np.concatenate([[0], np.cumsum(np.where(agree, 100 - percent, -percent))])
    count = np.concatenate([[0], np.cumsum(agree)])
    place = np.flatnonzero(agree)
    if not len(place):
        return 0, 0, 0
    end = place + 1
    # the least start from which the gain up to an end isn't negative, and from it the next agreeing token
    start = np.searchsorted(-np.minimum.accumulate(total), -total[end], "left")
    start = place[np.searchsorted(place, start)]
    n = count[end] - count[start]
    k = int(np.lexsort((start, end - start, -n))[0])
    return int(start[k]), int(end[k]), int(n[k])


def enough(agreeing, item_tokens):
    """Whether so many agreeing tokens are an overlap with an item of so many."""
    return 100 * agreeing >= np.minimum(100 * OVERLAP, round(100 * SHARE) * item_tokens)


def side_by_side(t: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """Overlap, agreeing tokens and first token of the best stretch of t with the item at one of the shifts; None if none is enough."""
    best = None
    for shift in sorted(set(shifts)):
        lo, hi = max(shift, 0), min(shift + len(item), len(t))
        agree = t[lo:hi] == item[lo - shift : hi - shift]
        if not enough(int(agree.sum()), len(item)):
            continue
        start, end, n = best_stretch(agree)
        if enough(n, len(item)) and (best is None or (-n, lo + start) < (-best[1], best[2])):
            best = (end - start, n, lo + start)
    return best


def tokens_of(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORDLIKE)[0]


def _key(id_col: str) -> Column:
    """A 128-bit name of a row's id and text."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), "text"), 256), 1, 32))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k, text in enumerate(batch.column(1)):
            t = tokens_of((text.as_py() or "").encode("utf-8", "replace"))
            for mask in masks_of(len(t)):
                found.append(seeds(t, mask))
                item.append(np.full(len(found[-1]), k))
                place.append(np.arange(len(found[-1]), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(item))), pa.array(np.concatenate(place))], ["seed", "item_key", "item_place"])


def bloom(found: DataFrame) -> tuple[np.ndarray, int]:
    """The filter of seeds (seed) and its number of bits, a power of two. What comes to the driver are slices of fixed size."""
    n = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (SEED_BITS * n - 1).bit_length() if n else 0))
    piece = (1 << bits) // _SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(probes(np.asarray(batch.column(0)).view(np.uint64), bits))))
            yield pa.RecordBatch.from_arrays([pa.array(at // piece), pa.array(at % piece)], ["slice", "at"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            which, at = (np.asarray(c) for c in batch.columns)
            for k in np.unique(which).tolist():
                held.setdefault(k, np.zeros(piece, bool))[at[which == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])

    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    marks = mapped(found.select("seed"), places, "slice long, at long").distinct()
    for r in mapped(marks.repartition(_SLICES, "slice"), slices, "slice long, bits binary").collect():
        bitmap[r.slice * piece // 8 : (r.slice + 1) * piece // 8] = np.frombuffer(r.bits, np.uint8)
    return bitmap, bits


_SUSPECT = "doc_id {}, text string, seeds array<long>, places array<int>"


def suspects(docs: DataFrame, bitmap: np.ndarray, bits: int, masks: tuple[str, ...]) -> DataFrame:
    """Rows of docs (doc_id, text) with seeds that the filter does not rule out, and where in the text they start."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in runs(offsets):
                t, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDLIKE)
                found, places = [], []
                for mask in masks:
                    h = seeds(t, mask)
                    at = maybe(h, shared.value, bits)
                    at = at[at + len(mask) <= first[np.searchsorted(first, at, "right")]] if len(at) else at
                    found.append(h[at])
                    places.append(at)
                h, at = np.concatenate(found), np.concatenate(places)
                if not len(at):
                    continue
                d = np.searchsorted(first, at, "right") - 1
                order = np.argsort(d, kind="stable")
                d, h, at = d[order], h[order], (at - first[d])[order]
                own, start = np.unique(d, return_index=True)
                cut = pa.array(np.append(start, len(d)).astype(np.int32))
                rows = batch.take(pa.array(own + i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32)))], ["doc_id", "text", "seeds", "places"])

    return mapped(docs, run, _SUSPECT.format(docs.schema["doc_id"].dataType.simpleString()))


_FOUND = "item_id long, item_tokens int, overlap_tokens int, agreeing int, first_token int"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, item_id, item_text, shifts); those of a text come one after another."""
    last, t = None, None
    for batch in batches:
        rows, at = [], []
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py().encode("utf-8", "replace")
            if text != last:
                last, t = text, tokens_of(text)
            item = tokens_of(batch.column(3)[k].as_py().encode("utf-8", "replace"))
            got = side_by_side(t, item, batch.column(4)[k].as_py())
            if got is not None:
                at.append(k)
                rows.append((len(item), *got))
        size, overlap, agreeing, first = zip(*rows, strict=True) if rows else ((),) * 4
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array(x, pa.int32()) for x in (size, overlap, agreeing, first))], ["doc_id", "item_id", "item_tokens", "overlap_tokens", "agreeing", "first_token"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_tokens, overlap_tokens, agreeing, first_token) for each document and item that overlap.

    Tokens are runs of letters and digits, A-Z lower-cased; an item of any number of tokens is looked for, one without
    tokens isn't. Of several overlaps of a pair, that with most agreeing tokens is given, the first of equals. Null and
    empty texts overlap with nothing; texts may be of any length. Rows of docs that repeat give rows that repeat; a
    benchmark row that repeats in full counts once, and items of equal texts are found each. Other columns are ignored; empty
    tables of either kind give no rows.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item_key", _key("item_id"))
    items = stored(items, "items")
    found = stored(mapped(items.select("item_key", "text"), _item_seeds, "seed long, item_key binary, item_place int"), "seeds")
    bitmap, bits = bloom(found)
    d = stored(suspects(texts(docs), bitmap, bits, (*("1" * n for n in range(1, SHORT)), *MASKS)).withColumn("doc_key", _key("doc_id")), "suspects")
    # rows that repeat have one key; a seed that a third of the documents hold is split by Spark's skew join
    hits = d.select("doc_key", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("doc_key", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    met = hits.join(found, "seed").select("doc_key", "item_key", shift).groupBy("doc_key", "item_key").agg(F.collect_set("shift").alias("shifts"))
    pairs = met.join(items.select("item_key", "item_id", F.col("text").alias("item_text")), "item_key")
    both = d.select("doc_key", "doc_id", "text").join(pairs, "doc_key").select("doc_id", "text", "item_id", "item_text", "shifts")
    return mapped(both, _verified, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}")
