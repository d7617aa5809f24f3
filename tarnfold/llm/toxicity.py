"""A convolutional text classifier: hashed word embeddings, several filter widths, max pooling; trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word, and of its first four and five bytes, so
that unseen forms of a known stem count. Filters of one to three words run over a text, the largest value of
each is kept, and a logistic layer scores them. Training and the score's calibration take a bounded sample of labelled
rows, whole texts (TRAIN_ROWS of each class, negatives twice as many, and no more than TRAIN_CHARS characters of a class).
Scoring reads every text whole, and thresholds by language are set from the scores of all labelled rows outside the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped, ship, texts
from .textnum import LOWER, SLICE_BYTES, WORDLIKE, column_bytes, pieces, prefix, runs, span_hash, spans

BUCKETS, DIM, FILTERS, WIDTH = 1 << 17, 8, 8, 3
#: Rows of each class (negatives twice as many) of the sample that a model is fitted on, and the most characters of a class's texts.
TRAIN_ROWS, TRAIN_CHARS = 2_000, 32_000_000
#: Steps of the scores' histogram.
STEPS = 1000
#: One in so many sampled rows calibrates, and is not trained on.
CALIBRATE = 4
#: The decision where a language has fewer calibration rows of either class than LEAST.
THRESHOLD, LEAST = 0.7, 10


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (n, 3), each text followed by WIDTH - 1 rows of padding (bucket 0); and the texts' offsets."""
    data = LOWER[data]
    start, end, first = spans(data, offsets, WORDLIKE)
    p = prefix(data)
    n = np.diff(first)
    at = np.arange(len(start)) + np.repeat(np.arange(len(n)), n) * (WIDTH - 1)
    ids = np.zeros((len(start) + (WIDTH - 1) * len(n), 3), np.int32)
    for k, cut in enumerate((1 << 40, 4, 5)):
        ids[at, k] = (span_hash(p, start, np.minimum(end, start + cut)) >> np.uint64(13 + k)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return ids, first + np.arange(len(first)) * (WIDTH - 1)


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same of a list, some MB at a time."""
    data = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    ids, bounds, n = [np.zeros((0, 3), np.int32)], [np.zeros(1, np.int64)], 0
    for i, j in runs(offsets):
        own, at = features(np.frombuffer(b"".join(data[i:j]), np.uint8), offsets[i : j + 1] - offsets[i])
        ids.append(own)
        bounds.append(at[1:] + n)
        n += len(own)
    return np.concatenate(ids), np.concatenate(bounds)


@dataclass
class Model:
    """tables (3, BUCKETS, DIM), filters (WIDTH * DIM, WIDTH * FILTERS) with bias, logistic weights; scale and shift of the score."""

    tables: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = -1.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    sample: list = field(default_factory=list)  # the ids it has seen

    def windows(self, ids: np.ndarray) -> np.ndarray:
        x = self.tables[0, ids[:, 0]] + self.tables[1, ids[:, 1]] + self.tables[2, ids[:, 2]]
        wide = np.zeros((len(x), WIDTH * DIM), np.float32)
        for j in range(WIDTH):
            wide[: len(x) - j, j * DIM : (j + 1) * DIM] = x[j:]
        return wide

    def _logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        conv = self.windows(ids) @ self.filters
        for k in range(1, WIDTH):  # a window starts at a word: after the last one it would reach into the next text
            conv[bounds[1:] - k] = -np.inf
        top = np.maximum.reduceat(conv, bounds[:-1], axis=0)
        return self._logits(np.where(np.isinf(top), np.float32(0), top))

    def long_logits(self, data: np.ndarray) -> np.ndarray:
        """The same of one long text, a piece at a time: a filter's largest value is that of the pieces', which overlap by a window."""
        top, kept = np.full(self.filters.shape[1], -np.inf, np.float32), np.zeros((0, 3), np.int32)
        for a, b in pieces(data, WORDLIKE):
            ids = np.concatenate([kept, features(data[a:b], np.array([0, b - a]))[0]])
            ids = ids if b == len(data) else ids[: -(WIDTH - 1)]  # padding is for the end
            whole = max(0, len(ids) - (WIDTH - 1))
            if whole:
                top = np.maximum(top, (self.windows(ids) @ self.filters)[:whole].max(0))
            kept = ids[whole:]
        return self._logits(np.where(np.isinf(top), np.float32(0), top)[None])

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64) + self.shift, -30, 30)))


def _mask() -> np.ndarray:
    """A filter of k words has no weight on the words after them."""
    m = np.zeros((WIDTH * DIM, WIDTH * FILTERS), np.float32)
    for k in range(WIDTH):
        m[: (k + 1) * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return m


def fit(rows: list[tuple[str, int]], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Model:
    """Train on (text, label). The first dimension of an embedding starts as the bucket's log odds, shrunk where it is rare."""
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in rows], np.float32)
    ids, bounds = features_of([t for t, _ in rows])
    tables = rng.standard_normal((3, BUCKETS, DIM), np.float32) * np.float32(0.05)
    seen = np.zeros((3, BUCKETS, 2), np.float32)
    for i in range(len(rows)):
        for k in range(3):
            seen[k, np.unique(ids[bounds[i] : bounds[i + 1], k]), int(y[i])] += 1
    sums = np.array([max(1, (y == v).sum()) for v in (0, 1)])
    odds = np.log((seen[..., 1] + 0.5) / (sums[1] + 1)) - np.log((seen[..., 0] + 0.5) / (sums[0] + 1))
    tables[..., 0] = odds * seen.sum(-1) / (seen.sum(-1) + 4) / 3
    tables[seen.sum(-1) == 0] = 0  # what was never seen says nothing
    tables[:, 0] = 0
    mask = _mask()
    w = (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32)
    w[0, :FILTERS] += 0.5
    m = Model(tables, w, np.full(WIDTH * FILTERS, -0.5, np.float32), rng.normal(0.3, 0.1, WIDTH * FILTERS).astype(np.float32))
    squares = {"tables": np.full(tables.shape, 1e-2, np.float32), "filters": np.full(w.shape, 1e-2, np.float32), "bias": np.full(len(m.bias), 1e-2, np.float32), "out": np.full(len(m.out), 1e-2, np.float32)}

    def step(name: str, g: np.ndarray, at=...) -> None:
        s, v = squares[name], getattr(m, name)
        s[at] += g * g
        v[at] -= rate * g / np.sqrt(s[at])

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            chosen = order[lo : lo + batch]
            own = [ids[bounds[i] : bounds[i + 1]] for i in chosen]
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            sub = np.concatenate(own)
            wide = m.windows(sub)
            conv = wide @ m.filters
            best = np.stack([conv[a : max(a + 1, b - WIDTH + 1)].argmax(0) + a for a, b in zip(at, at[1:], strict=False)])  # (docs, filters)
            top = np.take_along_axis(conv, best, 0) + m.bias
            h = np.maximum(top, 0)
            d = ((1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))) - y[chosen]).astype(np.float32) / len(chosen)
            dh = d[:, None] * m.out * (top > 0)
            x = wide[best]  # (docs, filters, WIDTH * DIM)
            dx = np.zeros_like(sub, shape=(len(sub), DIM), dtype=np.float32)
            spread = dh[:, :, None] * m.filters.T[None]
            for j in range(WIDTH):
                np.add.at(dx, np.minimum(best + j, len(sub) - 1).ravel(), spread[:, :, j * DIM : (j + 1) * DIM].reshape(-1, DIM))
            step("filters", np.einsum("df,dfx->xf", dh, x) * mask + 1e-4 * m.filters)
            step("bias", dh.sum(0))
            step("out", h.T @ d + 1e-4 * m.out)
            m.out_bias -= rate * float(d.sum())
            hit = np.flatnonzero(np.abs(dx).any(1))
            for k in range(3):
                g = np.zeros((len(buckets := np.unique(sub[hit, k])), DIM), np.float32)
                np.add.at(g, np.searchsorted(buckets, sub[hit, k]), dx[hit])
                step("tables", g[buckets > 0], (k, buckets[buckets > 0]))
    return m


def calibrate(m: Model, rows: list[tuple[str, int]]) -> Model:
    """Fit the score's scale and shift on rows (text, label) that fit() has not seen."""
    ids, bounds = features_of([t for t, _ in rows])
    z = np.concatenate([np.zeros(0), *(m.logits(ids[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i in range(0, len(rows), 256) for j in [min(i + 256, len(rows))])])
    y = np.array([v for _, v in rows], float)
    if 0 < y.sum() < len(y):
        a, b = 1.0, 0.0
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g, weight = p - soft, np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(weight * z * z).sum() + 1e-3, (weight * z).sum()], [(weight * z).sum(), weight.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, [(g * z).sum(), g.sum()])
            a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
        m.scale, m.shift = float(a), float(b)
    return m


def threshold(toxic: np.ndarray, other: np.ndarray) -> float | None:
    """The score of fewest errors, from both classes' counts by step of the score (the middle of several); None for too few rows."""
    if toxic.sum() < LEAST or other.sum() < LEAST:
        return None
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(other[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    return float(best[np.abs(best - np.median(best)).argmin()] / STEPS)


def _known(labels: DataFrame, usable: Column | None) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return known if usable is None else known.where(usable)


def learned(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model fitted to docs (doc_id, text) and labels (doc_id, toxic); usable limits the labels that may be seen.

    Without labels of both classes every score is about the share of positives in the sample. Labels without a document,
    or null, are left out; of rows that repeat a doc_id all may be taken; null texts are empty ones.
    """
    known = _known(labels, usable).join(docs.select("doc_id"), "doc_id", "left_semi").distinct()
    order = F.xxhash64("doc_id"), "doc_id"
    picked = [known.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, rows), (0, 2 * rows))]
    picked = picked[0].unionByName(picked[1])
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most 3 * rows ids
    sizes = got.groupBy("toxic", F.xxhash64("doc_id").alias("o"), "doc_id").agg(F.sum(F.length("text")).alias("size")).collect()
    left, chosen = {0: TRAIN_CHARS, 1: TRAIN_CHARS}, []
    for r in sorted(sizes, key=lambda r: (r.o, r.doc_id)):
        if r["size"] <= left[r.toxic]:
            left[r.toxic] -= r["size"]
            chosen.append((r.doc_id, r.toxic))
    got = got.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, picked.schema)), ["doc_id", "toxic"])
    sample = [r for v, n in ((1, rows), (0, 2 * rows)) for r in got.where(F.col("toxic") == v).orderBy(*order, "text").limit(n).collect()]
    held = [i for i in range(len(sample)) if i % CALIBRATE == 0]
    m = calibrate(fit([(r.text, r.toxic) for i, r in enumerate(sample) if i % CALIBRATE]), [(sample[i].text, sample[i].toxic) for i in held])
    m.sample = sorted({r.doc_id for r in sample})
    return m


def with_thresholds(m: Model, docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Set each language's threshold from all labelled rows outside the model's sample, of docs (doc_id, text, lang).

    All rows are scored; what comes together are counts by language, class and step of the score. A language (null
    counts as one without a name) of fewer than LEAST rows of either class gets none.
    """
    spark = docs.sparkSession
    seen = spark.createDataFrame([(i,) for i in m.sample], "doc_id long")
    known = _known(labels, usable).join(F.broadcast(seen), "doc_id", "left_anti")  # no more ids than the sample has
    scored = score(docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), m, "toxic_score").select("doc_id", "lang", F.floor(F.col("toxic_score") * STEPS).cast("int").alias("step"))
    counts = scored.join(known, "doc_id").groupBy("lang", "toxic", "step").count().collect()
    by: dict[str, np.ndarray] = {}
    for r in counts:
        if r.toxic in (0, 1):
            by.setdefault(r.lang or "", np.zeros((2, STEPS + 1)))[r.toxic, r.step] += r["count"]
    m.thresholds = {lang: t for lang, x in by.items() if (t := threshold(x[1], x[0])) is not None}
    return m


def _model(shared) -> Model:
    tables, *rest = shared.value
    return Model(tables.astype(np.float32), *rest)


def score(docs: DataFrame, m: Model, out_col: str = "toxic_score") -> DataFrame:
    """docs with a column out_col (0 to 1) added or replaced; null and empty texts are scored as texts without words."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((m.tables.astype(np.float16), m.filters, m.bias, m.out, m.out_bias, m.scale, m.shift))
    key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    names = [c for c in docs.columns if c != out_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("classifier", key, lambda: _model(shared))
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
            out = np.zeros(batch.num_rows)
            for i, j in runs(offsets):
                text = data[offsets[i] : offsets[j]]
                out[i:j] = own.scores(own.long_logits(text) if j == i + 1 and len(text) > 2 * SLICE_BYTES else own.logits(*features(text, offsets[i : j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, out_col])

    return mapped(docs.select(*[F.col(f"`{c}`") for c in names]), run, f"{schema}, `{out_col}` double", "classifier")


def rejected(m: Model, score_col: str = "toxic_score", lang_col: str = "lang") -> Column:
    """Whether a row's score reaches its language's threshold (THRESHOLD for languages without one, or null)."""
    cut = F.lit(THRESHOLD)
    for x, t in sorted(m.thresholds.items()):
        cut = F.when(F.coalesce(lang_col, F.lit("")) == x, F.lit(t)).otherwise(cut)
    return F.col(score_col) >= cut


def scored_documents(docs: DataFrame, labels: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text mod 3 is fold; those labels are never seen), score and predicted.

    Null and empty texts are scored as texts without words, a text of any length whole; a null doc_id is not held out;
    repeated rows are scored once each; other columns are ignored; an empty table gives an empty result.
    """
    of = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3))
    m = learned(docs, labels, of("doc_id") != fold)
    return score(texts(docs), m).select("doc_id", F.coalesce(of("doc_id") == fold, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
