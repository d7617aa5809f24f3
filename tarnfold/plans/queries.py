"""Queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import catalogue as C
from ..operators import chunking, evaluation, ingest, replay
from ..operators import retrieval as R
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- catalogue: filters, pages, sorts, lookups, access


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size >= 10 AND p_name ILIKE '%a%' ORDER BY p_partkey LIMIT 10 OFFSET 10")
def paged_list(t):
    return C.paged(C.filtered(t("part"), low={"p_size": 10}, keyword="a", columns=["p_name"]), [F.col("p_partkey")], 2, 10).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950 AND p_retailprice <= 1500 ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def price_band_sort(t):
    d = C.filtered(t("part"), low={"p_retailprice": 950}, high={"p_retailprice": 1500, "p_size": None})
    return C.paged(d, [F.desc("p_retailprice"), F.col("p_partkey")], 1, 50).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_brand ILIKE '%1%' OR p_type ILIKE '%1%' ORDER BY p_partkey LIMIT 5")
def page_with_total(t):
    d = C.filtered(t("part"), keyword=" 1 ", columns=["p_brand", "p_type"])
    return C.with_total(d, C.paged(d, [F.col("p_partkey")], 1, 5)).select("p_partkey", "p_name", "total")


@query("SELECT o_orderkey, o_custkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS paid_at, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def order_history(t):
    o = C.filtered(t("orders"), equal={"o_orderstatus": "F", "o_custkey": None})
    return C.looked_up(o, t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("paid_at"), "o_totalprice")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def eager_lookup(t):
    d = C.looked_up(t("supplier"), t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return C.looked_up(d, t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


def _paid(t):
    """(user, material) of paid orders."""
    o = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return o.join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("p_partkey"))


_ASKED = "SELECT DISTINCT o_custkey AS user_id, l_partkey AS p_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'"
_PAID = "SELECT o_custkey AS user_id, l_partkey AS p_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'"


def _asked(t):
    return t("lineitem").join(t("orders").where("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("p_partkey")).distinct()


@query(f"SELECT * FROM ({_ASKED}) SEMI JOIN ({_PAID}) USING (user_id, p_partkey)")
def paid_access_semi(t):
    return C.having(_asked(t), _paid(t), ["user_id", "p_partkey"])


@query(f"SELECT * FROM ({_ASKED}) ANTI JOIN ({_PAID}) USING (user_id, p_partkey)")
def not_purchased_anti(t):
    return C.lacking(_asked(t), _paid(t), ["user_id", "p_partkey"])


def _published(t):
    return t("part").select((F.col("p_partkey") % 1500).alias("user_id"), "p_partkey")


@query(f"SELECT DISTINCT user_id, 'purchased' AS kind, p_partkey AS id FROM ({_PAID}) UNION ALL SELECT p_partkey % 1500, 'published', p_partkey FROM part")
def my_items_union(t):
    tagged = lambda d, kind: d.select("user_id", F.lit(kind).alias("kind"), F.col("p_partkey").alias("id"))
    return tagged(_paid(t), "purchased").distinct().unionByName(tagged(_published(t), "published"))


@query(f"SELECT user_id, p_partkey AS id FROM ({_PAID}) UNION SELECT p_partkey % 1500, p_partkey FROM part")
def accessible_ids_union(t):
    return _paid(t).select("user_id", F.col("p_partkey").alias("id")).union(_published(t)).distinct()


@query("SELECT r_regionkey, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation) THEN 1 ELSE 0 END AS refused FROM region")
def category_children_guard(t):
    return C.guarded_delete(t("region"), t("region"), "r_regionkey", [(t("nation"), "n_regionkey")])


@query("SELECT o_orderkey, list_sort(list(l_linenumber)) AS line_numbers, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
def detail_nested(t):
    lines = C.nested(t("lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"], "lines").withColumnRenamed("l_orderkey", "o_orderkey")
    return t("orders").where("o_orderstatus = 'P'").join(lines, "o_orderkey").select("o_orderkey", F.transform("lines", lambda x: x["l_linenumber"]).alias("line_numbers"), F.size("lines").cast("long").alias("n"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS rating, count(*) AS review_count FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10 GROUP BY l_partkey")
def newest10_avg_rating(t):
    d = C.newest(t("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 10)
    return d.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("rating"), F.count("*").alias("review_count"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def group_count_desc(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def children_per_parent(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return t("part").select("p_partkey").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS paid FROM orders")
def pay_guard(t):
    pending = F.col("o_orderstatus") == "P"
    return t("orders").select("o_orderkey", F.when(pending, "F").otherwise(F.col("o_orderstatus")).alias("status"), pending.alias("paid"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.0 ELSE p_retailprice END AS p_retailprice, p_name FROM part")
def partial_update(t):
    p = t("part").select("p_partkey", "p_retailprice", "p_name")
    return C.updated(p, t("part").where("p_size < 10").select("p_partkey", F.lit(0.0).alias("p_retailprice")), "p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def cascade_delete(t):
    gone = t("region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"))
    return C.deleted(t("nation"), gone, "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'new'")
def upsert_rows(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return C.upserted(c, new.union(c.limit(1).select(F.lit(-1).cast("long"), F.lit("new"))), ["c_custkey"])


@query("SELECT part.p_partkey, p_brand, coalesce(n, 0) + p_size AS views FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def view_rollup(t):
    n = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t("part").join(n, "p_partkey", "left").select("p_partkey", "p_brand", (F.coalesce("n", F.lit(0)) + F.col("p_size")).alias("views"))


@query("SELECT user_id, event_type, max_by(value, (floor(value), event_id)) AS value FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL")
def memory_upsert(t):
    w = t("events").select("user_id", "event_type", "value", "event_id", F.floor("value").alias("confidence"))
    return C.remembered(w, ["user_id", "event_type"], "confidence", "event_id", ["click", "view", "purchase"], "event_type").select("user_id", "event_type", "value")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def purchased_csv(t):
    return t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id, title FROM (SELECT doc_id, concat_ws('-', source, lang, n_chars) AS title FROM documents) WHERE title NOT IN (SELECT concat_ws('-', source, lang, n_chars) FROM documents JOIN labels USING (doc_id))")
def incremental_skip(t):
    d = t("documents").select("doc_id", F.concat_ws("-", "source", "lang", "n_chars").alias("title"))
    had = d.join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return ingest.to_load(d, had, ["title"])[0]


# --- text


@query(r"""WITH m AS (SELECT doc_id, translate(text, 'xjqkwz', '[]()!*') AS text FROM documents)
 SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?-s)!\[.*?\]\(.*?\)', '', 'g'), '(?-s)\[(.+?)\]\(.+?\)', '\1', 'g'),
 '(?-s)\*\*(.+?)\*\*', '\1', 'g'), '(?-s)~~(.+?)~~', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM m""")
def clean_markdown(t):
    marked = F.translate("text", "xjqkwz", "[]()!*")  # texts full of marks, paired and not
    return t("documents").select("doc_id", F.md5(X.clean_markdown(marked)).alias("clean"))


@query("SELECT doc_id, md5(translate(translate(text, 'aEinoR13', 'ａＥｉｎｏＲ１３'), 'ａＥｉｎｏＲ１３', 'aEinoR13')) AS half FROM documents")
def halfwidth(t):
    return t("documents").select("doc_id", F.md5(X.half_width(F.translate("text", "aEinoR13", "ａＥｉｎｏＲ１３"))).alias("half"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
 k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line, ' ' || chr(9) || chr(13))) AS n FROM l)
 SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (n >= 3 AND length(trim(line, ' ' || chr(9) || chr(13))) BETWEEN 1 AND 49)), '')) AS kept FROM k GROUP BY doc_id""")
def repeat_line_removal(t):
    return ingest.without_repeating_lines(t("documents")).select("doc_id", F.md5("text").alias("kept"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[\s\-]*\d{1,5}[\s\-]*$'))) AS numbers, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '.....') OR contains(x, '……'))) AS contents FROM documents")
def page_number_filter(t):
    n = lambda x: F.size(X.lines(x))
    x = F.col("text")
    return t("documents").select("doc_id", (n(x) - F.when(X.without_page_numbers(x) == "", F.when(F.size(F.filter(X.lines(x), lambda v: ~X.trimmed(v).rlike(r"^[\s\-]*\d{1,5}[\s\-]*\z"))) == 0, 0).otherwise(1)).otherwise(n(X.without_page_numbers(x)))).cast("long").alias("numbers"), F.size(F.filter(X.lines(x), lambda v: v.contains(".....") | v.contains("……"))).cast("long").alias("contents"))


@query(r"SELECT doc_id, length(text) >= 50 AND length(regexp_replace(text, '[^a-zA-Z0-9一-鿿\s.,;:!?()，。；：！？（）、-]', '', 'g')) / length(text) > 0.7 AS readable FROM documents")
def readability_gate(t):
    return t("documents").select("doc_id", X.readable(F.col("text")).alias("readable"))


@query("SELECT doc_id, unnest(range(n)) AS chunk_index, md5(substr(text, CAST(unnest(range(n)) * 450 + 1 AS INT), 500)) AS chunk FROM (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS INT) + 1 END AS n FROM documents)")
def fixed_chunks(t):
    return t("documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("c").alias("chunk"))


@query("""WITH g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS g FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)),
 p AS (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM g)
 SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(g, b))) = 0 THEN 0 ELSE len(list_intersect(g, b)) / len(list_distinct(list_concat(g, b))) END, 6) AS likeness FROM p WHERE b IS NOT NULL""".replace("\\\\", "\\"))
def bigram_jaccard(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t("conversations").select("conv_id", "turn", X.collapsed(F.col("text")).alias("x")).repartition("conv_id").select("conv_id", "turn", X.bigrams(F.col("x")).alias("g")).withColumn("b", F.lag("g").over(w)).where("b is not null")
    return d.select("conv_id", "turn", F.round(X.jaccard(F.col("g"), F.col("b")), 6).alias("likeness"))


@query(r"""SELECT item_id, 'rag:exact:' || md5(trim(regexp_replace(translate(translate(text, 'etaoinshrdlucm', '的，了。《和》与，是…即！呀'), '，。！？；：""' || chr(39) || chr(39) || '（）《》【】、—…的了吗呢啊吧和与及或在是有被把对从到让给为以也就都而但却所者之仍便则虽即', repeat(' ', 55)), '\s+', ' ', 'g')) || '_' || item_id) || ':full' AS cache_key FROM benchmark""")
def cache_key_md5(t):
    said = F.translate("text", "etaoinshrdlucm", "的，了。《和》与，是…即！呀")  # texts full of particles and marks, and one that stays
    return t("benchmark").select("item_id", R.exact_key(said, F.col("item_id"), R.access_pool(F.lit(True))).alias("cache_key"))


@query("SELECT doc_id, CASE WHEN n_chars < 5000 THEN 9.90 WHEN n_chars < 15000 THEN 19.90 ELSE 29.90 END::DOUBLE AS price FROM documents")
def price_tier(t):
    return t("documents").select("doc_id", F.when(F.col("n_chars") < 5000, 9.90).when(F.col("n_chars") < 15000, 19.90).otherwise(29.90).alias("price"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(left(text, 200), '^\s+|\s+$', '', 'g') || '...' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS description FROM documents")
def default_description(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.when(F.length(x) > 200, F.concat(X.trimmed(F.substring(x, 1, 200)), F.lit("..."))).otherwise(X.trimmed(x)).alias("description"))


@query("SELECT conv_id, turn, unnest(range(CAST(ceil(length(text) / 3.0) AS INT))) AS seq, substr(text, CAST(unnest(range(CAST(ceil(length(text) / 3.0) AS INT))) * 3 + 1 AS INT), 3) AS piece FROM conversations WHERE role = 'user'")
def answer_triples(t):
    d = t("conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(X.pieces(F.col("text"))).alias("seq", "piece"))
    return d.withColumn("seq", F.col("seq").cast("long"))


@query("SELECT doc_id, octet_length(encode(text)) > 3000 AS long, octet_length(encode(text)) AS bytes FROM documents")
def byte_length_gate(t):
    return t("documents").select("doc_id", (F.octet_length("text") > 3000).alias("long"), F.octet_length("text").cast("long").alias("bytes"))


# --- retrieval

_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "))"
_POST = f"""q AS (SELECT DISTINCT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark), d AS (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents),
 p AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS len FROM (SELECT doc_id, len(toks) AS l, unnest(toks) AS token FROM d) GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), s AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d)"""


@query(f"""WITH {_POST}, x AS (SELECT item_id, doc_id, sum(tf * log10(n / df) * log10(n / df)) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY 1, 2)
 SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def tfidf_topk(t):
    s = R.text_scores(t("documents"), t("benchmark")).withColumn("score", F.round("score", 6))
    return R.top(s, "item_id", "doc_id", 5).select("item_id", "doc_id", "rank", "score")


@query(f"""WITH {_POST}, x AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY 1, 2)
 SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def bm25_topk(t):
    s = R.text_scores(t("documents"), t("benchmark"), scorer="bm25").withColumn("score", F.round("score", 6))
    return R.top(s, "item_id", "doc_id", 5).select("item_id", "doc_id", "rank", "score")


@query("""SELECT doc_id, 0.5 AS score FROM documents WHERE source = 'src3' AND (text ILIKE '%the%' OR text ILIKE '%nicht%') ORDER BY doc_id LIMIT 10""")
def keyword_or_search(t):
    words = F.split(F.lit("the nicht"), r"\s+")
    return t("documents").where((F.col("source") == "src3") & F.exists(words, lambda k: F.contains(F.lower("text"), F.lower(k)))).select("doc_id", F.lit(0.5).alias("score")).orderBy("doc_id").limit(10)


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z::DOUBLE))))"


@query(f"""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_COS}, 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 5""")
def cosine_topk(t):
    e = t("embeddings")
    return R.vector_top(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "vec_id")


@query(f"""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 5""")
def filtered_vector_topk(t):
    e = t("embeddings")
    return R.vector_top(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "vec_id", on="label")


_RANKED = "a AS (SELECT l_orderkey AS q, l_partkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS q, l_partkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_discount) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_RANKED}, f AS (SELECT coalesce(a.q, b.q) AS query_id, coalesce(a.c, b.c) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 8) AS score FROM (SELECT * FROM a WHERE rank <= 3) a FULL JOIN (SELECT * FROM b WHERE rank <= 3) b ON a.q = b.q AND a.c = b.c)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 3""")
def rrf_fusion(t):
    d = t("lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id")).agg(F.max("l_quantity").alias("x"), F.max("l_discount").alias("y"))
    a, b = (R.top(d.withColumn("score", F.col(c)), "query_id", "chunk_id", 3) for c in "xy")
    return R.fused(a, b, "query_id", "chunk_id", 3).select("query_id", "chunk_id", "score", "rank")


@query("SELECT user_id, CASE WHEN max(value) / 100 >= 0.7 THEN '高' WHEN max(value) / 100 >= 0.4 THEN '中' ELSE '低' END AS recall_quality, CASE WHEN bool_or(length(props) < 50) THEN '短碎片' ELSE '正常' END AS chunk_quality FROM events GROUP BY user_id")
def confidence_labels(t):
    return R.quality(t("events").withColumn("s", F.col("value") / 100), "user_id", "s", "props")


@query("""WITH c AS (SELECT user_id, event_type, max(event_id) AS entry_id, max(ts) + INTERVAL 20 DAY AS expires_at FROM events GROUP BY 1, 2)
 SELECT event_id, entry_id FROM events JOIN c USING (user_id, event_type) WHERE expires_at > (SELECT max(ts) FROM events)""")
def exact_cache_hit(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    cache = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("entry_id"), (F.max("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"))
    return R.exact_hits(e, cache, ["user_id", "event_type"], F.lit(e.agg(F.max("ts")).first()[0]))[0].select("event_id", "entry_id")


@query(f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 10),
 n AS (SELECT a.vec_id AS request_id, b.vec_id AS entry_id, round({_COS}, 4) AS similarity FROM embeddings a JOIN c b ON a.label = b.label)
 SELECT request_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY entry_id DESC) AS k FROM n WHERE similarity >= 0.2) WHERE k = 1""")
def semantic_cache_hit(t):
    e = t("embeddings")
    cache = e.select("label", F.col("vec_id").alias("entry_id"), F.col("vec_id").alias("ts"), F.col("embedding").alias("cached_vector"))
    asked = e.select("label", F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    return R.similar_hit(asked, cache, ["label"], 0.2).select("request_id", "entry_id", "similarity")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 10")
def recent_cache_entries(t):
    return C.newest(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")], 10).select("user_id", "event_id")


# --- logs and state


@query("SELECT event_id, coalesce(event_type = lag(event_type) OVER w AND props = lag(props) OVER w, false) AND event_type <> 'purchase' AS blocked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def repeat_breaker(t):
    return replay.repeats(t("events"), "user_id", "event_id", "event_type", "props", ["purchase"]).select("event_id", "blocked")


@query("""WITH g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS a FROM (SELECT conv_id, turn, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS s FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM conversations))),
 p AS (SELECT *, lag(a) OVER w AS b, lag(a, 2) OVER w AS c FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, coalesce(c IS NOT NULL AND len(list_intersect(a, b)) > 0.8 * len(list_distinct(list_concat(a, b))) AND len(list_intersect(a, c)) > 0.8 * len(list_distinct(list_concat(a, c))) AND len(list_intersect(b, c)) > 0.8 * len(list_distinct(list_concat(b, c))), false) AS looping FROM p""".replace("\\\\", "\\"))
def loop_detector(t):
    return replay.loops(t("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "looping")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS used, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 10 WHEN 'click' THEN 5 ELSE 0 END AS within FROM events")
def tool_budget(t):
    return replay.budgeted(t("events"), "user_id", "event_id", "event_type", {"purchase": 3, "view": 10, "click": 5}).select("event_id", F.col("used").cast("long").alias("used"), "within")


@query("SELECT event_id, coalesce(last_value(CASE event_type WHEN 'purchase' THEN 'shopping' WHEN 'error' THEN 'support' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'tutoring') AS mode FROM events")
def mode_machine(t):
    decided = F.when(F.col("event_type") == "purchase", "shopping").when(F.col("event_type") == "error", "support")
    return replay.modes(t("events"), "user_id", "event_id", decided, "tutoring").select("event_id", "mode")


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id DESC) = 1 THEN 'fact' ELSE 'discarded' END AS layer FROM events")
def fact_supersession(t):
    return replay.facts(t("events"), "user_id", ["event_type", "props"], "event_id").select("event_id", "layer")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE NOT (role = 'assistant' AND contains(text, '\"purchase_offer\"'))) WHERE r <= 20")
def context_window(t):
    d = t("conversations").where(~((F.col("role") == "assistant") & F.col("text").contains('"purchase_offer"')))
    return C.newest(d, ["conv_id"], [F.desc("turn")], 20).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 5")
def last5_user_msgs(t):
    return C.newest(t("conversations").where("role = 'user'"), ["conv_id"], [F.desc("turn")], 5).select("conv_id", "turn")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
 r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS second, []::BIGINT[] AS log, false AS admitted FROM e WHERE n = 1 UNION ALL
  SELECT user_id, n, event_id, second, CASE WHEN len(live) < 3 AND (len(live) = 0 OR live[-1] <> second) THEN list_append(live, second) ELSE live END, len(live) < 3 FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.second - 86400) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
 SELECT event_id, user_id, second, admitted FROM r WHERE n > 0""")
def rate_limiter(t):
    e = t("events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return replay.admitted(e, "user_id", "second", 3, 86_400, ("event_id",))


# --- evaluation


_RET = "list(chunk_id ORDER BY rank)"


@query(f"""WITH x AS (SELECT a.vec_id AS query_id, a.label AS la, b.vec_id AS chunk_id, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 4) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 n AS (SELECT a.vec_id AS query_id, count(*) AS rel FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1)
 SELECT query_id, round(sum((la = lb)::INT) / 5.0, 6) AS precision_at_5, round(sum((la = lb)::INT) / any_value(rel), 6) AS recall_at_5, bool_or(la = lb) AS hit FROM x JOIN n USING (query_id) WHERE rank <= 5 GROUP BY query_id""")
def precision_recall_hit(t):
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0")
    label = e.select("vec_id", "label")
    per_label = e.groupBy("label").agg((F.count("*") - 1).alias("rel"))
    ret = R.vector_top(q, e, 5, "vec_id", "vec_id").join(label.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("lb")), "chunk_id")
    ret = ret.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lb"))), lambda x: x["lb"]).alias("returned"))  # five a query
    d = ret.join(label.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(per_label.where("rel > 0"), "label")
    x, y = F.col("returned"), F.array("label")  # what counts is whether a chunk has the query's label
    return d.select("query_id", F.round(A.precision_at(x, y, 5), 6).alias("precision_at_5"), F.round(A.hits(x, y, 5) / F.col("rel"), 6).alias("recall_at_5"), A.hit_at(x, y, 5).alias("hit"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
 SELECT event_type, max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY event_type""")
def floor_percentiles(t):
    return evaluation.percentiles(t("events"), ["event_type"], "value")


@query("""WITH s AS (SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1)
 SELECT event_type, mean, n, round(mean - lag(mean) OVER (ORDER BY event_type), 6) AS d_mean FROM s""")
def config_summary_delta(t):
    s = t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return evaluation.deltas(s, "event_type", ["mean"])


@query("""SELECT source, count(*) AS total, sum((l.quality = 1)::INT)::BIGINT AS passed, round(sum((l.quality = 1)::INT) * 100.0 / count(*), 6) AS pass_rate, round(sum(coalesce(l.toxic, 0)) / count(*), 6) AS avg_toxic
 FROM documents d JOIN labels l USING (doc_id) GROUP BY source""")
def category_rollup(t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return evaluation.rolled_up(d, "source", "ok", ["toxic"])


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, 1 + CAST(floor((100 - (SELECT count(*) FROM s)) * n / (SELECT sum(n) FROM s)) AS BIGINT) AS quota FROM s""")
def stratified_quota(t):
    return evaluation.quotas(t("documents").groupBy("source").agg(F.count("*").alias("n")), "n", 100)


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT source, 1 + CAST(floor((100 - (SELECT count(*) FROM s)) * n / (SELECT sum(n) FROM s)) AS BIGINT) AS quota FROM s),
 r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0-' || doc_id), doc_id) AS place FROM documents) SELECT doc_id, source FROM r JOIN q USING (source) WHERE place <= quota""")
def stratified_sample(t):
    return evaluation.sampled(t("documents").select("doc_id", "source"), "source", "doc_id", 100)


# --- ingestion


_LINK = """'<a href="([^"]*)">([^<]*)</a>'"""


@query(f"""WITH n AS (SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
 a AS (SELECT page_id, url, unnest(regexp_extract_all(nav, {_LINK}, 1)) AS href, unnest(regexp_extract_all(nav, {_LINK}, 2)) AS title, unnest(range(len(regexp_extract_all(nav, {_LINK})))) AS pos FROM n),
 f AS (SELECT * FROM a WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, trim(title) AS title, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS link FROM f""")
def pages_links(t):
    p = t("pages")
    d = files.page_articles(p, side=("nav", *files.SIDE)).join(p.select("page_id", "url"), "page_id")
    d = d.select("page_id", "url", F.posexplode("links").alias("pos", "x"))
    return d.select("page_id", (F.col("pos") + 1).alias("place"), F.col("x.text").alias("title"), X.resolved(F.col("x.href"), F.col("url")).alias("link"))


@query()
def pages_markdown(t):
    return files.page_articles(t("pages")).select("page_id", "title", X.clean_markdown(F.col("markdown")).alias("markdown"))


@query()
def structural_chunks(t):
    d = files.page_articles(t("pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return chunking.structural_chunks(d)


_TEXT_RANK = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(tf * log10(n / df) * log10(n / df)), 6) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY 1, 2)) WHERE rank <= 20)"
_OVERLAP = f"""qt AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS qt FROM benchmark), dt AS (SELECT doc_id, {_TOK.format('text')} AS dt FROM documents)"""


@query(f"""WITH {_POST}, {_TEXT_RANK}, {_OVERLAP},
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT i.item_id, b.vec_id AS doc_id, round({_COS}, 4) AS score FROM benchmark i JOIN embeddings a ON i.item_id = a.vec_id, embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 20),
 u AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT coalesce(v.item_id, t.item_id) AS item_id, coalesce(v.doc_id, t.doc_id) AS doc_id, v.score AS vector_score, t.score AS text_score, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0), 8) AS score FROM v FULL JOIN t ON v.item_id = t.item_id AND v.doc_id = t.doc_id)),
 o AS (SELECT item_id AS query_id, doc_id AS chunk_id, score, vector_score, text_score, rank AS place, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END, 6) AS share FROM u JOIN qt USING (item_id) JOIN dt USING (doc_id) WHERE rank <= 20)
 SELECT query_id, chunk_id, score, rank, vector_score, text_score, score AS rrf_score, share AS rerank_score, CASE WHEN share >= 0.7 THEN '高' WHEN share >= 0.4 THEN '中' ELSE '低' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, place) AS rank FROM o) WHERE rank <= 5""")
def retrieve_full(t):
    e = t("embeddings").select(F.col("vec_id"), "embedding")
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "text").join(e.withColumnRenamed("vec_id", "chunk_id"), "chunk_id", "left")
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    return R.retrieve(asked, chunks, R.Config(k=5, text=True, rerank=True)).withColumn("label", R.confidence())


@query("SELECT doc_id, md5(text) AS key, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def embedding_cache_keys(t):
    d = t("documents").select("doc_id", F.md5("text").alias("key"), "lang")
    return C.newest(d, ["key"], [F.col("doc_id")], 1)
