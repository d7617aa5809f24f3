"""SpotSigs: chains of content words that follow common words, as a document's fingerprint. DataFrame functions only.

An anchor is a common word of one of the languages below; a content word right after one starts a chain with
the next two content words, whatever common words lie between. A text without chains (a list, a table, another language)
has one at every content word. A fingerprint is the sorted set of the chains' 32-bit hashes. Sets are compared
by Jaccard similarity; a search keeps them in partitions by set length, of which only neighbours can be similar enough,
and prunes by prefixes and by the ratio of lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

THRESHOLD = 0.75
#: Rows of one range of ids while each document finds the next, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4_000, 1_000

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by can did do for from had has have he in is it its not of on or she so that the their there they this to was we were which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qui que sa se son sur un une vous cette ont être été aussi "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen er es ist im ich mit nach nicht noch nur oder sich sie sind so um und von vor war wie zu zum zur für über sein wird durch werden bis oder "
    "al como con del el era este esta ha las lo los mas no para pero por se su sus y una uno sobre también fue son"
).split()


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted set of chain hashes of a text column. Without any chain every content word starts one;
    without content words the text itself is hashed: a set is never empty. Nulls are not expected (see edited_documents)."""
    w, c, s = f"_{out}_w", f"_{out}_c", f"_{out}_s"
    mark = "^"
    df = df.withColumn(w, words(F.col(text)))
    # content words, marked where the word before is an anchor
    kept = F.transform(F.col(w), lambda x, i: F.when(x.isin(ANCHORS) | (x == ""), F.lit(None)).when((i > 0) & F.get(F.col(w), i - 1).isin(ANCHORS), F.concat(F.lit(mark), x)).otherwise(x))
    df = df.withColumn(c, F.filter(kept, lambda x: x.isNotNull()))
    bare = lambda x: F.ltrim(F.coalesce(x, F.lit("")), F.lit(mark))
    chain = lambda x, i: F.hash(bare(x), bare(F.get(F.col(c), i + 1)), bare(F.get(F.col(c), i + 2)))
    chains = F.transform(F.col(c), lambda x, i: F.when(x.startswith(mark), chain(x, i)))
    df = df.withColumn(s, F.filter(chains, lambda x: x.isNotNull()))
    chosen = F.when(F.size(s) > 0, F.col(s)).when(F.size(c) > 0, F.transform(F.col(c), chain)).otherwise(F.array(F.hash(F.col(text))))
    return df.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop(w, c, s)


def fingerprint(signatures: str) -> Column:
    """The set as text: eight hexadecimal digits a chain."""
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(df: DataFrame, id_col: str, text: str, lead: dict[str, str], finish=lambda d: d) -> DataFrame:
    """Adds columns of the next row by ascending id (the first after the last); equal ids are ordered by text, null ids come first.

    Rows are dealt over ranges of ids of like size; each range ends with a copy of the first row of the next one,
    so no range needs another and nothing is sorted in one task. finish adds the columns that lead takes.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = df.count()
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = df.agg(F.percentile_approx(key, [i / k for i in range(1, k)], 10_000).alias("c")).first().c if k > 1 else []
    cuts = sorted(set(cuts or []))
    at = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<long>"), lambda x: x <= F.col("_key"))) if cuts else F.lit(0)
    d = df.withColumn("_key", key).withColumn("_range", at.cast("int"))
    firsts = sorted((r["_range"], r["k"]) for r in d.groupBy("_range").agg(F.min("_key").alias("k")).collect())  # at most k rows
    if not firsts:
        firsts = [(0, 0)]
    before = F.create_map(*[F.lit(x) for (r, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True) for x in (int(first), int(r))])
    copies = d.where(F.col("_key").isin([int(x) for _, x in firsts])).withColumn("_range", before[F.col("_key")]).withColumn("_copy", F.lit(1))
    rows = finish(d.withColumn("_copy", F.lit(0)).unionByName(copies))
    order = Window.partitionBy("_range").orderBy("_copy", "_key", F.xxhash64(text), text)
    for new, old in lead.items():
        rows = rows.withColumn(new, F.lead(old).over(order))
    return rows.where("_copy = 0").drop("_key", "_range", "_copy")


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of docs (doc_id, text).

    A text is edited by replacing its last quarter of code points (rounded down) with as many first ones, or all,
    of the next document's. Null texts are empty; repeated rows are neighbours of each other; a single row is its
    own next one; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, "doc_id", "text", {"next_text": "text", "next_sigs": "sigs"}, lambda x: with_signatures(x, "text", "sigs"))
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    d = with_signatures(d, "edited", "edited_sigs")
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class) and classes (class, sigs, n): documents of equal fingerprints are one class.

    Signatures are written first: a filter on a class would otherwise be pushed below them, and make them once for each word.
    """
    d = with_signatures(docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    d = stored(d.select("doc_id", "sigs"), "signatures")
    d = d.withColumn("class", F.sha2(F.concat_ws(",", F.col("sigs").cast("array<string>")), 256))
    return d.select("doc_id", "class"), d.groupBy("class").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))


def search(queries: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (query_class, class, likeness) of threshold or more between the classes of a stated query set and of all
    documents, and both sides' membership (side, doc_id, class).

    Similar sets lie in the same or a neighbouring length partition, and share one of their n - ceil(threshold n) + 1
    first chains (by hash). Null texts are empty ones, and alike; equal texts and repeated rows are one class; a text may be
    of any length; other columns are ignored; an empty table on either side gives no links.
    """
    (qm, q), (dm, d) = classes(queries), classes(docs)
    band = F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).cast("int")
    first = F.slice("sigs", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    probes = q.select(F.col("class").alias("query_class"), F.explode(F.array(band - 1, band, band + 1)).alias("band"), first.alias("f")).select("query_class", "band", F.explode("f").alias("chain"))
    index = d.select("class", band.alias("band"), F.explode(first).alias("chain"))
    met = probes.join(index, ["band", "chain"]).select("query_class", "class").distinct()
    q, d = q.select(F.col("class").alias("query_class"), F.col("sigs").alias("q_sigs"), F.col("n").alias("q_n")), d
    near = met.join(q, "query_class").join(d, "class").where(F.least("n", "q_n") >= threshold * F.greatest("n", "q_n"))
    links = near.withColumn("likeness", likeness("q_sigs", "sigs")).where(F.col("likeness") >= threshold).select("query_class", "class", "likeness")
    return links, qm.select(F.lit("query").alias("side"), "doc_id", "class").union(dm.select(F.lit("document").alias("side"), "doc_id", "class"))


def linked(queries: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, doc_id and likeness of search's links, each class by its least doc_id, and the classes' numbers of rows.

    A class of which no row has an id has a null one. Nulls, empties, repeats and empty tables are as in search.
    """
    links, members = search(queries, docs, threshold)
    least = members.groupBy("side", "class").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    q = least.where("side = 'query'").select(F.col("class").alias("query_class"), F.col("id").alias("query_id"), F.col("n").alias("queries"))
    d = least.where("side = 'document'").select("class", F.col("id").alias("doc_id"), F.col("n").alias("documents"))
    return links.join(q, "query_class").join(d, "class").select("query_id", "doc_id", "likeness", "queries", "documents")
