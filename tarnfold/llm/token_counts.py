"""Token counts by a two-tier lookup on the map side.

A pre-token here is a maximal run of bytes other than ASCII white space: the tokenizer's normaliser and
splitter never look across one, so a text has as many tokens as its pre-tokens have. Lengths of frequent
pre-tokens are broadcast in one compact table of bounded size; a worker encodes any other pre-token once
and keeps it in a bounded cache. No pre-token is shuffled. Which ones are frequent is learned from a sample of about
SAMPLE_ROWS rows over the whole table: what the table lacks costs time and changes no count.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, mapped, ship, texts

#: Most entries of the broadcast table (bounds it to a few MB), rows of the sample, and words that a row adds to its task's list.
FREQUENT, SAMPLE_ROWS, PER_ROW = 65_536, 4_000, 256
#: Bytes of a worker's cache, counted with what Python adds to them.
CACHED = 64 << 20

_TOKENIZERS: dict = {}
_MODELS: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets write a printable byte as itself and the n-th other byte as the character 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(plain))}


_BYTES = _byte_letters()


def _word_model(path: str):
    """The model itself for words of Latin letters, if the file's steps leave those whole: it skips per-call set-up."""
    t = json.loads(tokenizer(path).to_str())
    steps = [x["type"] for x in (t["normalizer"] or {}).get("normalizers", [])]
    split, level = ((t["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
    plain = steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and r"[\p{L}]+" in split["pattern"].get("Regex", "") and level.get("type") == "ByteLevel"
    return tokenizer(path).model if plain else None


def length(path: str, word: bytes, model) -> int:
    if model is not None:
        s = word.decode("utf-8", "replace")
        if s.isalpha() and max(s) < "\u0250" and "\u0130" not in s:
            return len(model.tokenize(s.lower().encode().decode("latin-1").translate(_BYTES)))
    return len(tokenizer(path).encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)


def lengths(path: str, words: list[bytes]) -> list[int]:
    if path not in _MODELS:
        _MODELS[path] = _word_model(path)
    model = _MODELS[path]
    return [length(path, w, model) for w in words]


def _frequent(batches: Iterator[pa.RecordBatch], per_row: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for text in batch.column(0).cast(pa.large_binary()):
            counts.update(w for w in (text.as_py() or b"").split() if len(w) <= 64)
    top = counts.most_common(per_row * rows)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w for w, _ in top)]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "counts"])


def frequent_lengths(docs: DataFrame, path: str, n_frequent: int = FREQUENT, rows: int = SAMPLE_ROWS) -> tuple[bytes, np.ndarray]:
    """The compact table: frequent pre-tokens joined by spaces, and their lengths. At most n_frequent of 64 bytes.

    The driver gets one row a task, and in all at most PER_ROW words for each of about rows rows.
    """
    n = docs.count()
    some = texts(docs).select("text")
    some = some.sample(rows / n, 1) if n > rows else some
    counts: Counter = Counter()
    for r in mapped(some, lambda b: _frequent(b, PER_ROW), "words binary, counts array<long>").collect():
        for w, k in zip(bytes(r.words).split(), r.counts, strict=True):
            counts[w] += k
    words = sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:n_frequent]
    return b" ".join(words), np.array(lengths(path, words), np.uint16)


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer drops white space and looks at no neighbour across it, as probes show."""
    n = lambda x: len(tokenizer(path).encode(x, add_special_tokens=False).ids)
    return all(n(a + s + b) == n(a) + n(b) for a in ("the", "it", "9", "x,", "Über") for b in ("end", "'s", "!", "7th") for s in (" ", "  ", "\n", "\t ", "\r\n"))


class Lengths(dict):
    """Pre-token to length: frequent ones from the broadcast table, others encoded when first met."""

    def __init__(self, path: str, words: bytes, n: np.ndarray):
        super().__init__(zip(words.split(), n.tolist(), strict=True))
        self.path, self.fixed, self.size, self.missed = path, len(self), 0, 0
        self.marks = lengths(path, [b"a", b"a,", b"a."]) == [1, 2, 2] and _MODELS[path] is not None

    def count(self, text: bytes) -> int:
        if self.size > CACHED:  # the cache holds so much, and one text's words at most
            for w in list(self)[self.fixed :]:
                del self[w]
            self.size = 0
        words = text.split()
        misses = [w for w in dict.fromkeys(words) if w not in self]
        if misses:
            # a word before one comma or stop: both are pre-tokens of their own for the splitter, and the mark is one token
            short = [w[:-1] if self.marks and w[-1:] in b",." and w[-2:-1].isalpha() else w for w in misses]
            need = [w for w in dict.fromkeys(short) if w not in self]
            self.update(zip(need, lengths(self.path, need), strict=True))
            self.update((w, self[x] + 1) for w, x in zip(misses, short, strict=True) if w is not x)
            self.missed += len(misses)
            self.size += sum(map(len, misses)) + 200 * len(misses)
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, n_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    Null and empty texts have 0 bytes and tokens; repeated rows are counted once each; other columns are
    ignored; an empty table gives an empty result. Special strings inside texts are special tokens, as is the
    library's default. A text may be of any length. A tokenizer whose tokens hold white space is refused.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or default_path()
    if not splits_at_space(path):
        raise ValueError("this tokenizer's tokens may hold white space; its texts can't be counted by pre-tokens")
    words, n = frequent_lengths(docs, path, n_frequent)
    shared = spark.sparkContext.broadcast((words, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = shared.value
        of = kept("lengths", f"{path} {hash(words)}", lambda: Lengths(path, words, n))
        for batch in batches:
            got = batch.column(1).cast(pa.large_binary())
            sizes, tokens = [], []
            for x in got:
                text = x.as_py() or b""
                sizes.append(len(text))
                tokens.append(of.count(text))
            t = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(t), pa.array(t > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(texts(docs), count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", "lengths")
