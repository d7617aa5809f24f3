"""Queries through stored indexes, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation, indexing, models, text_index, vector_index
from ..operators import retrieval as R
from ..storage import fresh, stored
from .queries import _COS, _POST, _TOK, query

_PATTERNS = ", ".join(f"({b}, {vector_index.pattern(b, 64)})" for b in range(vector_index.BITS))
_DOT = "list_sum(list_transform(list_zip({}, {}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH n AS (SELECT least({vector_index.MOST_LISTS}, ceil(2 * sqrt(count(*))))::BIGINT AS lists FROM embeddings),
 b AS (SELECT embedding, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS list FROM embeddings QUALIFY list < (SELECT lists FROM n)),
 l AS (SELECT a.vec_id, list, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, list) AS place FROM embeddings a, b),
 p AS (SELECT * FROM (VALUES {_PATTERNS}) AS t(bit, pattern)),
 s AS (SELECT vec_id, list({_DOT.format('embedding', 'pattern')} > 0 ORDER BY bit) AS bits FROM embeddings, p GROUP BY vec_id),
 m AS (SELECT q.vec_id AS query_id, r.vec_id AS chunk_id, list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: (z[1] <> z[2])::INT)) AS apart
  FROM l q JOIN l r ON q.list = r.list AND r.place = 1 AND q.vec_id <> r.vec_id JOIN s x ON x.vec_id = q.vec_id JOIN s y ON y.vec_id = r.vec_id WHERE q.vec_id % 100 = 0 AND q.place <= (SELECT ceil({vector_index.PROBED} * lists) FROM n)),
 c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY apart, chunk_id) <= {5 * vector_index.RESCORED}),
 x AS (SELECT query_id, chunk_id, round({_COS}, 4) AS score FROM c JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 5""")
def indexed_vector_topk(t):
    e = t("embeddings")
    index = vector_index.write(e, fresh(e.sparkSession, "vector-index"), "vec_id")
    return vector_index.search(index, e.where("vec_id % 100 = 0"), 5, "vec_id")


# --- versions of an index


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?-s)!\[.*?\]\(.*?\)', '', 'g'), '(?-s)\[(.+?)\]\(.+?\)', '\1', 'g'), '(?-s)\*\*(.+?)\*\*', '\1', 'g'), '(?-s)~~(.+?)~~', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_PIECES = "SELECT *, unnest(range(n)) AS chunk_index, md5(substr(text, CAST(unnest(range(n)) * 450 + 1 AS INT), 500)) AS chunk FROM (SELECT *, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS INT) + 1 END AS n FROM d)"


def _edited(docs, which):
    return docs.where(which).withColumn("text", F.concat(F.lit("Edited. "), F.coalesce("text", F.lit(""))))


@query(f"""WITH e AS (SELECT doc_id, source AS material_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 10 = 0 THEN 'Edited. ' || coalesce(text, '') ELSE coalesce(text, '') END AS raw FROM documents WHERE doc_id % 10 = 0 OR doc_id % 17 > 0),
 d AS (SELECT doc_id, material_id, version, {_CLEAN.format('raw')} AS text FROM e) SELECT material_id, doc_id, version, chunk_index, chunk, true AS embedded FROM ({_PIECES})""")
def index_after_edits(t):
    """A load, and one of edited and unchanged documents that leaves others out: siblings of a material stay as they were."""
    docs = t("documents").select(F.col("source").alias("material_id"), "doc_id", "text")
    index = indexing.DocumentIndex(docs.sparkSession, fresh(docs.sparkSession, "index"))
    index.load(docs, embed=models.hashed_embedder(8), chunker=indexing.by_size)
    index.load(_edited(docs, "doc_id % 10 = 0").unionByName(docs.where("doc_id % 10 = 1")), docs.where("doc_id % 17 = 0"), models.hashed_embedder(8), indexing.by_size)
    d = index.chunks().join(index.vectors(), "key", "left")
    return d.select("material_id", "doc_id", F.col("version").cast("long").alias("version"), F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("chunk"), F.col("embedding").isNotNull().alias("embedded"))


@query("""WITH m AS (SELECT source AS course_id, CASE WHEN bool_or(doc_id % 10 = 0 AND source LIKE 'src1%') THEN 2 ELSE 1 END AS index_version FROM documents GROUP BY source),
 c AS (SELECT item_id, 'src' || item_id % 20 AS course_id FROM benchmark) SELECT item_id, course_id, coalesce(index_version = 1, false) AS hit FROM c LEFT JOIN m USING (course_id)""")
def stale_cache_entries(t):
    """Entries written from a first version of the index; after edits of some materials, only those of the others still hit."""
    docs = t("documents").select(F.col("source").alias("material_id"), "doc_id", "text")
    index = indexing.DocumentIndex(docs.sparkSession, fresh(docs.sparkSession, "index"))
    index.load(docs, chunker=indexing.by_size)
    asked = t("benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("course_id"))
    cache = stored(indexing.stamped(asked, index.material_versions()), "cache")
    index.load(_edited(docs, "doc_id % 10 = 0 and material_id like 'src1%'"), chunker=indexing.by_size)
    hits = indexing.valid(cache, index.material_versions()).select("item_id", F.lit(True).alias("hit"))
    return asked.join(hits, "item_id", "left").select("item_id", "course_id", F.coalesce("hit", F.lit(False)).alias("hit"))


_STEPS = "SELECT event_id, user_id, event_type, epoch_ms(ts) AS ms, CASE WHEN event_id % 11 > 0 THEN epoch_ms(ts) + 1000 * (3600 + event_id % 7200) END AS until FROM events"


@query(f"""WITH l AS ({_STEPS}), a AS (SELECT unnest(range(1, 5)) AS step), w AS (SELECT step, min(ms) + (max(ms) - min(ms)) // 4 * step AS upto FROM l, a GROUP BY step),
 n AS (SELECT * FROM l, w WHERE ms <= upto QUALIFY row_number() OVER (PARTITION BY step, user_id, event_type ORDER BY ms DESC, event_id DESC) = 1)
 SELECT step, event_id FROM n WHERE until IS NULL OR until > upto""")
def cache_over_time(t):
    """A cache log's live entries at four times, each read from the log as it was compacted at the time before."""
    e = t("events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    log = e.select("event_id", "user_id", "event_type", F.col("ms").alias("written_at"), F.when(F.col("event_id") % 11 > 0, F.col("ms") + 1000 * (3600 + F.col("event_id") % 7200)).alias("expires_at"))
    first, last = log.agg(F.min("written_at"), F.max("written_at")).first()
    out = None
    for step in range(1, 5):
        at = F.lit(first + (last - first) // 4 * step)
        live = indexing.as_of(log, ["user_id", "event_type"], at, tie="event_id").select(F.lit(step).cast("long").alias("step"), "event_id")
        out = live if out is None else out.unionByName(live)
        log = indexing.compacted(log, ["user_id", "event_type"], at, tie="event_id")
    return out


# --- stored postings


_BM25 = f"""{_POST}, x AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY 1, 2)
 SELECT item_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 5"""


@query(f"WITH {_BM25}")
def stored_text_topk(t):
    d = t("documents")
    index = text_index.write(d, fresh(d.sparkSession, "text-index"))
    return index.search(t("benchmark"), 5).select("item_id", "doc_id", "rank", "score")


@query("WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Edited. ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 10 = 0 OR doc_id % 17 > 0), " + _BM25)
def updated_text_topk(t):
    """The same after an update of some documents' blocks and the removal of others."""
    d = t("documents").select("doc_id", "text")
    index = text_index.write(d, fresh(d.sparkSession, "text-index"))
    index.update(d.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("Edited. "), "text")), d.where("doc_id % 17 = 0 and doc_id % 10 > 0"))
    return index.search(t("benchmark"), 5).select("item_id", "doc_id", "rank", "score")


@query(f"""WITH w AS (SELECT item_id, ({_TOK.format('text')})[:2] AS w FROM benchmark), d AS (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents),
 m AS (SELECT item_id, doc_id FROM w, d WHERE len(w) > 0 AND list_has_all(toks, w)),
 x AS (SELECT m.item_id AS query_id, b.vec_id AS chunk_id, round({_COS}, 4) AS score FROM m JOIN embeddings a ON m.item_id = a.vec_id JOIN embeddings b ON m.doc_id = b.vec_id)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 5""")
def hybrid_vector_topk(t):
    """Vectors of the documents alone that have all words of a query (here the first two of an item)."""
    d, e = t("documents"), t("embeddings")
    index = text_index.write(d, fresh(d.sparkSession, "text-index"))
    words = t("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(R.tokens(F.col("text")), 1, 2), " ").alias("text"))
    asked = words.join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return R.vector_top(asked, e, 5, "query_id", "vec_id", same=True, allowed=text_index.containing(index, words))


# --- generation


def _asked_well(texts):
    return [f"What of {t[:30]}?" for t in texts]


def _refusing(texts):
    """A model that refuses batches whose first text begins with a vowel."""
    if texts[0][:1].lower() in "aeiou":
        raise RuntimeError("refused")
    return _asked_well(texts)


@query("""WITH b AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS no FROM documents), x AS (SELECT *, (no - 1) // 10 AS batch FROM b),
 f AS (SELECT batch, list_contains(['', 'a', 'e', 'i', 'o', 'u'], lower(left(arg_min(text, no), 1))) AS refused FROM x GROUP BY batch)
 SELECT printf('Q%03d', no) AS query_id, chunk_id, 'What of ' || left(text, 30) || '?' AS question, CASE WHEN refused THEN 2 ELSE 1 END AS run FROM x JOIN f USING (batch)""")
def generated_questions(t):
    """A first run whose model refuses some batches, and a second that is asked for those alone."""
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    g = generation.Generation(d.sparkSession, fresh(d.sparkSession, "generation"))
    g.run(d, _refusing)
    g.run(d, _asked_well)
    return g.questions().join(g.done().select("chunk_id", F.col("run").cast("long").alias("run")), "chunk_id")
