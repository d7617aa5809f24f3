"""Source divergence audit: how the term shares of a language's sources differ, by a frequent-pattern tree of term rows.

Every kept term is a row: its nonzero counts by source, in a fixed order of the sources (those with most terms first). Rows
are counted, sorted and inserted into a prefix tree, dealt over ranges of rows: terms whose rows begin alike share
a path. With p(0) as the share of a term that a source doesn't have, the sum of f over all kept terms is, for two sources,

    V f(p0, q0) + corrections of terms that one has + of terms that the other has + of terms that both have,

where the first two come from counts of each source's different shares, and the last, for a node of the tree and an ancestor,
is its multiplicity times f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0): once for each pair of node and ancestor, however many
terms go through the node. f is whole for every term, so the sums are exact; shares are computed in decimals.

Null text, lang and source are ''. Every row is a document, repeated ones and those with a null id too. A group
without kept terms has a pair row of value 0 or more for each other source; a language of one source has none; an
empty table gives no rows. Other columns are ignored. Very long texts are counted in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, parts, stored

LEAST_DOCS, TOP = 10, 10
#: Entries that a task counts before it passes them on, rows of a batch, bytes of a long text counted at once, and
#: pairs of nodes and ancestors summed at once.
HELD, ROWS, PIECE, PAIRS = 300_000, 20_000, 1 << 20, 1 << 20

#: Letters stay (A-Z as a-z), as do bytes beyond ASCII; all others part terms.
_PARTED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    t = text.translate(_PARTED)
    at = 0
    while at < len(t):
        end = len(t) if at + PIECE >= len(t) else t.rfind(b" ", at, at + PIECE) + 1 or t.find(b" ", at + PIECE) + 1 or len(t)
        yield t[at:end].split()
        at = end


def _emitted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        for i in range(0, len(terms), ROWS):
            some = terms[i : i + ROWS]
            columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts of a task's own rows, as far as it has held them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set = set()
                for words in _pieces(text):
                    n.update(words)
                    seen.update(words)
                docs_with.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from _emitted(held)
                held = {}
        yield from _emitted(held)

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return mapped(docs.select(blank("lang"), blank("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")), run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), null without terms."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast(nullif({total} + 2 * {terms}, 0) as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): corrections of a sorted batch of rows (lang, path, m), summed by pairs of sources a < b."""
    path, m = batch.column("path"), batch.column("m").to_numpy()
    langs = pc.dictionary_encode(batch.column("lang"))
    lang = langs.indices.to_numpy()
    size, at = np.asarray(pc.list_value_length(path)).astype(np.int64), path.offsets.to_numpy().astype(np.int64)[:-1] - path.offsets[0].as_py()
    flat = path.flatten()
    r, p, p0 = (flat.field(c).to_numpy().astype(np.int64) for c in ("rank", "p", "p0"))
    begins = np.r_[True, lang[1:] != lang[:-1]]  # rows that share nothing with the one before
    seen, sums = [], []
    for depth in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > depth)
        before = rows - 1
        item = at[rows] + depth
        other = np.where((before >= 0) & (size[before] > depth), at[before] + depth, item)
        begins[rows] |= (size[before] <= depth) | (r[item] != r[other]) | (p[item] != p[other])
        begins[size <= depth] = True
        first = np.flatnonzero(begins[rows])
        nodes, times = rows[first], np.add.reduceat(m[rows], first)
        if depth:
            step = max(1, PAIRS // depth)
            for i in range(0, len(nodes), step):
                some = nodes[i : i + step]
                b, a = (at[some] + depth)[:, None], at[some][:, None] + np.arange(depth)[None]
                value = times[i : i + step, None] * (_apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b]))
                key = (lang[some][:, None].astype(np.int64) << 52) | (r[a] << 26) | r[b]
                keys, inverse = np.unique(key.ravel(), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, inverse, value.ravel())
                seen.append(keys)
                sums.append(total)
    if sums:
        keys, inverse = np.unique(np.concatenate(seen), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate(sums))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys >> 52)), pa.array((keys >> 26) & 0x3FFFFFF), pa.array(keys & 0x3FFFFFF), pa.array(total)], ["lang", "a", "b", "value"])


def term_rows(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, cells): the kept terms with their counts by source, cells (source, n)."""
    cells = counted(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return rows.where(F.col("docs") >= least_docs).drop("docs")


def groups_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, rank, n_all, terms, lang_all, p0) of every group; p0 is the share of a term that it doesn't have."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    occurring = docs.select(blank("lang"), blank("source")).distinct()
    own = rows.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n_all"), F.count("*").alias("own_terms"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_all"))
    g = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_all", "own_terms", "terms", "lang_all"])
    order = Window.partitionBy("lang").orderBy(F.desc("own_terms"), "source")
    return g.withColumn("rank", F.row_number().over(order)).withColumn("p0", share("0L", "n_all", "terms")).drop("own_terms")


def pair_corrections(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) by ranks of sources, to be added to both orders of a pair."""
    several = F.struct(F.col("rank"), F.col("p"), F.col("p0"))
    path = priced.groupBy("lang", "term").agg(F.array_sort(F.collect_list(several)).alias("path"))
    path = path.groupBy("lang", "path").agg(F.count("*").alias("m"))
    dealt = path.repartitionByRange(parts(priced.sparkSession), "lang", "path").sortWithinPartitions("lang", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _tree(b)

    both = mapped(dealt, run, "lang string, a long, b long, value long")
    shares = priced.groupBy("lang", F.col("rank").alias("a"), "p", "p0").agg(F.count("*").alias("m"))
    met = shares.join(groups.select("lang", F.col("rank").alias("b"), F.col("p0").alias("q0")), "lang").where("a <> b")
    one = met.select("lang", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.col("m") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    return both.union(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of each group (part pair) and its top terms (part term)."""
    rows = stored(term_rows(docs, least_docs), "terms")
    groups = stored(groups_of(docs, rows), "groups")
    cells = rows.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    priced = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "n_all", "terms"))

    fixes = pair_corrections(priced, groups)
    fixes = fixes.union(fixes.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("fix"))
    a = groups.select("lang", "source", F.col("rank").cast("long").alias("a"), F.col("p0").alias("p"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("rank").cast("long").alias("b"), F.col("p0").alias("q"))
    pairs = a.join(b, "lang").where("a <> b").join(fixes, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("terms") * apart("p", "q"), F.lit(0)) + F.coalesce("fix", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    shown = priced.withColumn("q", share("total", "lang_all", "terms")).where("p > q")
    shown = shown.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(first)
