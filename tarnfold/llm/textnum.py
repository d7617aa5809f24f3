"""Vectorised views of texts: Arrow columns as byte arrays, words and their hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_TABLE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a multi-byte character.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    had = _POWERS.get(key)
    if had is None or len(had) < n:
        out = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        out[0] = 1
        had = np.multiply.accumulate(out, out=out)
        if n <= SLICE_BYTES + 4096:  # those of a longer text are not kept
            _POWERS[key] = had
    return had[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and len+1 offsets; nulls are empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer text is a range of its own (see pieces)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of hashed bytes times powers, from which the hash of any substring comes: see span_hash."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_TABLE[data] * powers(_R, len(data)), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * powers(_RINV, len(p))[start] + (end - start).astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which inside holds, cut at the texts' ends: starts, ends, and the first run of each text."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside[data]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[flag[cut] & flag[cut + 1] == 1]) if len(cut) else cut
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def pieces(data: np.ndarray, inside: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about so many bytes of one text that cut no run of bytes for which inside holds; a longer run is in one range."""
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        if b < len(data):
            gaps = np.flatnonzero(~inside[data[a:b]])
            while not len(gaps) and b < len(data):
                a_, b = b, min(b + most, len(data))
                gaps = np.flatnonzero(~inside[data[a_:b]]) + (a_ - a)
            if len(gaps) and b < len(data):
                b = a + int(gaps[-1]) + 1
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and len+1 offsets by text.

    A long text is hashed a piece at a time, so its words take little memory beside their hashes.
    """
    inside = ~SPACE if inside is None else inside

    def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[data]
        start, end, first = spans(data, offsets, inside)
        return span_hash(prefix(data), start, end), first

    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        found = np.concatenate([hashed(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data, inside)])
        return found, np.array([0, len(found)])
    return hashed(data, offsets)


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words each; len(h) - n + 1 of them."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out)
