"""More queries: parsing, guards, evaluation rules and state, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import parse as P
from ..functions import text as X
from ..operators import catalogue as C
from ..operators import ingest, replay
from ..operators import retrieval as R
from ..sources import routes
from .queries import _OVERLAP, _POST, _TEXT_RANK, query

# --- scans and lists


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2 ORDER BY r_regionkey LIMIT 1")
def point_lookup(t):
    return t("region").where("r_regionkey = 2").orderBy("r_regionkey").limit(1)


@query("SELECT l_orderkey, list_sort(list(l_partkey)) AS ids FROM lineitem GROUP BY l_orderkey")
def pluck_ids(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))  # an order has few lines


@query("SELECT p_partkey, lower(regexp_extract(p, '\\.([^.]*)$', 1)) AS format, CASE WHEN p_size < 20 THEN 'unsupported' END AS error FROM (SELECT *, p_name || CASE WHEN p_size < 20 THEN '.EXE' ELSE '.Md' END AS p FROM part)".replace("\\\\", "\\"))
def format_router(t):
    d = t("part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") < 20, ".EXE").otherwise(".Md")).alias("path"))
    return routes.routed(d).select("p_partkey", "format", "error")


@query("""SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'docs/' || p WHEN 1 THEN replace(p, '/', '-') WHEN 2 THEN 'docs/vendor/' || p ELSE p END || CASE WHEN page_id % 7 = 0 THEN '.rst' ELSE '.md' END AS path
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS p FROM pages)) WHERE page_id % 5 > 0 AND ends_with(path, '.md') AND NOT regexp_matches(path, 'vendor/|node_modules/|testdata/') AND (starts_with(path, 'docs/') OR NOT contains(path, '/'))""")
def path_predicate(t):
    p, i = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("docs/"), p)).when(i % 4 == 1, F.replace(p, F.lit("/"), F.lit("-"))).when(i % 4 == 2, F.concat(F.lit("docs/vendor/"), p)).otherwise(p)
    path = F.concat(path, F.when(i % 7 == 0, ".rst").otherwise(".md"))
    return t("pages").where(routes.wanted_path(path, F.when(i % 5 > 0, "blob").otherwise("tree"))).select("page_id")


# --- joins and guards


@query("SELECT p_partkey, n FROM (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS n FROM part) WHERE n > 0")
def requires_purchase(t):
    n = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return C.having(t("part").select("p_partkey"), n, "p_partkey").join(n, "p_partkey")


@query("SELECT p_partkey, coalesce(s, '') AS supplier FROM part LEFT JOIN (SELECT l_partkey, min(s_name) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount > 0.09 GROUP BY 1) ON p_partkey = l_partkey")
def decorrelated_lookup(t):
    s = t("lineitem").where("l_discount > 0.09").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("s_name").alias("s"))
    return C.looked_up(t("part").select("p_partkey"), s, "p_partkey").select("p_partkey", F.coalesce("s", F.lit("")).alias("supplier"))


@query("SELECT s_suppkey, n_nationkey, CASE WHEN n_nationkey IS NULL THEN 'unknown' END AS error FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def name_to_id(t):
    n = t("nation").where("n_nationkey % 2 = 0").select("n_nationkey")
    return C.looked_up(t("supplier"), n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", F.when(F.col("n_nationkey").isNull(), "unknown").alias("error"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 11 OR o_orderpriority LIKE '1%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 49)")
def access_predicate(t):
    paid = t("lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("paid", F.lit(True))
    return t("orders").join(paid, "o_orderkey", "left").where((F.col("o_custkey") == 11) | F.col("o_orderpriority").like("1%") | F.coalesce("paid", F.lit(False))).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey % 3 = c_nationkey % 3 AS may_edit FROM orders JOIN customer ON o_custkey = c_custkey")
def owner_guard(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("o_custkey") % 3 == F.col("c_nationkey") % 3).alias("may_edit"))


@query("SELECT event_id FROM (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL 7 DAY END AS expires_at FROM events) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-15 00:00:00'")
def expiry_predicate(t):
    e = t("events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), F.lit(1).alias("one"))
    return R.exact_hits(e.select("event_id"), e, ["event_id"], F.lit("2024-01-15 00:00:00").cast("timestamp"))[0].select("event_id")


@query("SELECT event_id FROM events WHERE CASE WHEN user_id % 3 = 0 THEN event_type IN ('click', 'view') WHEN user_id % 3 = 1 THEN event_type = 'error' ELSE true END")
def mode_memory_filter(t):
    mode = F.col("user_id") % 3
    return t("events").where(F.when(mode == 0, F.col("event_type").isin("click", "view")).when(mode == 1, F.col("event_type") == "error").otherwise(True)).select("event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_name IS NULL THEN '' ELSE concat('《', p_name, '》> ', l_linestatus) END AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25")
def source_labels(t):
    p = t("part").where("p_size > 25").select("p_partkey", "p_name")
    return C.looked_up(t("lineitem"), p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.when(F.col("p_name").isNull(), "").otherwise(F.format_string("《%s》> %s", "p_name", "l_linestatus")).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 AND c_mktsegment = 'BUILDING' THEN 'closed' ELSE 'active' END AS status FROM customer")
def soft_delete(t):
    d = t("customer").withColumn("status", F.lit("active"))
    return C.closed(d, (F.col("c_nationkey") < 5) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "status")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 100000, s_name FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)")
def find_or_create(t):
    c = t("customer").select("c_custkey", "c_name")
    return C.found_or_created(c, t("supplier").select((F.col("s_suppkey") + 100000).alias("c_custkey"), F.col("s_name").alias("c_name")), ["c_name"])


@query("SELECT doc_id, lang FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE source = 'src1'")
def replace_by_key(t):
    d = t("documents").select("doc_id", "lang", "source")
    fresh = d.where("source = 'src1'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("lang"), "source")
    load, stay = ingest.to_load(fresh, d, ["source"], force=True)
    return stay.unionByName(load).select("doc_id", "lang")


@query("""SELECT user_id AS run, event_id AS seq, unnest([0, 1]) AS part, unnest(['assistant', 'tool']) AS role, unnest(['', props]) AS content, unnest(['{"id":"c' || event_id || '","name":"' || event_type || '","arguments":"{}"}', NULL]) AS tool_calls, unnest([NULL, 'c' || event_id]) AS tool_call_id FROM events""")
def message_pairs(t):
    calls = t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), "event_id").alias("call_id"), F.col("event_type").alias("tool"), F.lit("{}").alias("args"), F.col("props").alias("result"))
    return replay.message_pairs(calls)


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined FROM conversations GROUP BY conv_id")
def concatenated_documents(t):
    return ingest.concatenated(t("conversations"), "conv_id", ["turn"], "text").select("conv_id", F.md5("text").alias("joined"))


# --- sets


@query("SELECT c.user_id, list_sort(list_filter(['click', 'error', 'login', 'scroll'], lambda x: NOT list_contains(c.tools, x))) AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS tools FROM events GROUP BY 1) c")
def required_tools_missing(t):
    required = F.array(*[F.lit(x) for x in ("click", "error", "login", "scroll")])
    return t("events").groupBy("user_id").agg(F.array_sort(F.array_except(required, F.collect_set("event_type"))).alias("missing"))


@query("SELECT l_orderkey, len(list_filter(list(l_partkey ORDER BY l_linenumber), lambda x: x % 7 < 3)) AS hits FROM lineitem GROUP BY l_orderkey")
def intersection_count(t):
    relevant = t("part").where("p_partkey % 7 < 3").select(F.col("p_partkey").alias("l_partkey"))
    n = C.having(t("lineitem").select("l_orderkey", "l_partkey"), relevant, "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("hits"))
    return t("lineitem").select("l_orderkey").distinct().join(n, "l_orderkey", "left").select("l_orderkey", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("SELECT o_custkey, list_sort(list_distinct(list_concat(list(o_orderkey % 10), [1::BIGINT, 2::BIGINT]))) AS ids FROM orders GROUP BY o_custkey")
def ground_truth_union(t):
    return t("orders").groupBy("o_custkey").agg(F.array_sort(F.array_union(F.collect_set(F.col("o_orderkey") % 10), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).alias("ids"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS tools, count(*) AS rounds, sum(length(props)) AS tokens FROM events GROUP BY user_id")
def trace_totals(t):
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tools"), F.count("*").alias("rounds"), F.sum(F.length("props")).alias("tokens"))


# --- parsing


#: White space in DuckDB's expressions, as functions.text.SPACE.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(rf"""WITH RECURSIVE m AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([a-z]+) (of|de|der) ', '[\1](\2)', 'g'), ' (in|la|das) ', '!![\1](x)[a](b) ', 'g'), 'qu', '[**') AS t FROM documents),
 i AS (SELECT doc_id, t, 0 AS n FROM m UNION ALL SELECT doc_id, t[: s - 1] || t[s + e + c + 1 :], n + 1 FROM (SELECT *, strpos(substr(t, s + e + 1), ')') AS c FROM (SELECT *, strpos(substr(t, s), '](') AS e FROM (SELECT *, strpos(t, '![') AS s FROM i) WHERE s > 0) WHERE e > 0) WHERE c > 0),
 l AS (SELECT doc_id, arg_max(t, n) AS t, 0 AS n FROM i GROUP BY doc_id UNION ALL SELECT doc_id, t[: s - 1] || substr(t, s + 1, e - 2) || t[s + e + c + 1 :], n + 1 FROM (SELECT *, strpos(substr(t, s + e + 1), ')') AS c FROM (SELECT *, strpos(substr(t, s), '](') AS e FROM (SELECT *, strpos(t, '[') AS s FROM l) WHERE s > 0) WHERE e > 0) WHERE c > 0)
 SELECT doc_id, md5({_trim("regexp_replace(arg_max(t, n), '[*]{2}|__|~~|[`#*>]', '', 'g')")}) AS plain FROM l GROUP BY doc_id""")
def strip_markdown(t):
    marked = F.regexp_replace("text", "([a-z]+) (of|de|der) ", "[$1]($2)")  # links, images, images that a removal makes, and openings without a pair
    marked = F.replace(F.regexp_replace(marked, " (in|la|das) ", "!![$1](x)[a](b) "), F.lit("qu"), F.lit("[**"))
    return t("documents").select("doc_id", F.md5(P.stripped_markdown(marked)).alias("plain"))


_BROKEN = "replace(replace(replace(text, ', ', chr(10) || ' ' || chr(10)), '. ', chr(10) || chr(10)), 'q', chr(12288))"


@query(rf"""SELECT doc_id, md5({_trim("array_to_string(list_transform(list_filter(list_transform(string_split(" + _trim(_BROKEN) + ", chr(10) || chr(10)), lambda p: " + _trim("p") + "), lambda p: p <> ''), lambda p: replace(p, chr(10), '  ' || chr(10))), chr(10) || chr(10))")}) AS md FROM documents""")
def text_to_markdown(t):
    broken = F.col("text")  # sentences part paragraphs, clauses only lines; ideographic spaces
    for a, b in ((", ", "\n \n"), (". ", "\n\n"), ("q", "\u3000")):
        broken = F.replace(broken, F.lit(a), F.lit(b))
    return t("documents").select("doc_id", F.md5(X.text_to_markdown(broken)).alias("md"))


@query("SELECT conv_id, turn, regexp_matches(text, '[a-z一-鿿]$') AS mid_sentence FROM conversations")
def mid_sentence_break(t):
    return t("conversations").select("conv_id", "turn", X.breaks_mid_sentence(F.col("text")).alias("mid_sentence"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, 'de', '#'), '\. ', chr(10) || '## ', 'g'), chr(10))) AS line, unnest(range(len(string_split(regexp_replace(replace(text, 'de', '#'), '\. ', chr(10) || '## ', 'g'), chr(10))))) AS pos FROM documents)
 SELECT doc_id, pos, length(regexp_extract(line, '(?-s)^(#{1,6})\s+(.+)$', 1)) AS level, md5(regexp_replace(regexp_extract(line, '(?-s)^(#{1,6})\s+(.+)$', 2), '^\s+|\s+$', '', 'g')) AS title FROM l""")
def heading_parse(t):
    text = F.regexp_replace(F.replace("text", F.lit("de"), F.lit("#")), r"\. ", "\n## ")  # every sentence starts a line that may be a heading
    l = t("documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return l.select("doc_id", F.col("pos").cast("long").alias("pos"), X.heading_level(F.col("line")).cast("long").alias("level"), F.md5(X.heading_title(F.col("line"))).alias("title"))


@query(r"""SELECT doc_id, coalesce(regexp_replace(substr(list_filter(string_split(regexp_replace(text, '[,;] ', chr(10) || '# ', 'g'), chr(10))[1:9], lambda v: starts_with(v, '# '))[1], 3), '^\s+|\s+$', '', 'g'), source) AS title FROM documents""")
def markdown_title(t):
    text = F.regexp_replace("text", "[,;] ", "\n# ")  # every clause starts a heading
    return t("documents").select("doc_id", P.markdown_title(text, F.concat(F.lit("docs/a/"), "source", F.lit(".md"))).alias("title"))


@query("SELECT o_orderkey, concat('pay ¥', CASE WHEN o_custkey % 5 = 1 THEN '' ELSE o_custkey::VARCHAR END, CASE WHEN o_custkey % 5 = 1 THEN 'nothing' ELSE '.50' END, ' or ¥', o_custkey, '.50') AS answer, concat('¥', o_custkey, '.50') AS claimed FROM orders")
def hard_field_correction(t):
    right = F.concat(F.lit("¥"), F.col("o_custkey"), F.lit(".50"))
    none = F.col("o_custkey") % 5 == 1  # nothing is claimed there before the right amount
    said = F.when(none, F.concat(F.lit("pay ¥nothing or "), right)).otherwise(F.concat(F.lit("pay ¥1.50 or "), right))
    d = t("orders").select("o_orderkey", right.alias("right"), said.alias("said"))
    return d.select("o_orderkey", P.corrected(F.col("said"), P.amount(F.col("said")), F.col("right")).alias("answer"), F.col("right").alias("claimed"))


@query(rf"""SELECT conv_id, turn, CASE WHEN length(c) > 40 THEN left(c, 40) || '...' ELSE c END AS cleaned FROM (SELECT conv_id, turn, {_trim(f"regexp_replace('[TRANSFER:human] ' || CASE WHEN turn % 2 = 0 THEN translate(replace(text, 'th', ''), 'z', chr(160)) ELSE replace(replace(text, 'th', ''), ' ', chr(12288)) END, '{_SPACE}+', ' ', 'g')")} AS c FROM conversations)""")
def transfer_cleaning(t):
    marked = F.replace("text", F.lit("th"), F.lit("[TRANSFER:qa][TRANSFER:course_recommend][TRANSFER:customer_service]"))  # and one that stays
    marked = F.when(F.col("turn") % 2 == 0, F.translate(marked, "z", "\u00a0")).otherwise(F.regexp_replace(marked, " ", "\u3000"))  # spaces beyond ASCII
    return t("conversations").select("conv_id", "turn", X.cleaned_answer(F.concat(F.lit("[TRANSFER:human] "), marked), 40).alias("cleaned"))


@query("SELECT conv_id, turn, contains(text, 'j') AS has_citation, contains(text, 'qu') OR contains(text, 'ß') AS has_refusal FROM conversations")
def answer_flags(t):
    said = F.replace(F.replace(F.translate("text", "j", "《"), F.lit("qu"), F.lit("未涉及")), F.lit("ß"), F.lit("未找到"))
    a, b = P.answer_flags(said)
    return t("conversations").select("conv_id", "turn", a.alias("has_citation"), b.alias("has_refusal"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\. ', chr(10) || ' 12、)', 'g'), chr(10))) AS line FROM documents),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[0-9.、)）]+', ''), '^\s+|\s+$', '', 'g') AS item FROM l) SELECT doc_id, md5(item) AS item FROM c WHERE item <> ''""")
def list_line_cleaning(t):
    lines = F.regexp_replace("text", r"\. ", "\n 12、)")  # every sentence becomes a numbered line
    return t("documents").select("doc_id", F.explode(P.list_items(lines)).alias("item")).select("doc_id", F.md5("item").alias("item"))


@query("SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/', 1) AS category FROM pages")
def category_from_path(t):
    return t("pages").select("page_id", F.split_part(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), F.lit("/"), F.lit(1)).alias("category"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM conversations")
def json_fence(t):
    fenced = F.concat(F.when(F.col("turn") % 2 == 0, "```json\n").otherwise(" ```"), "text", F.when(F.col("turn") % 3 == 0, "\n``` \n").otherwise("```"))
    return t("conversations").select("conv_id", "turn", F.md5(X.without_fence(fenced)).alias("body"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 10 END AS INT) AS relevance, CAST(CASE WHEN event_id % 3 = 1 THEN event_id // 10 % 10 ELSE 0 END AS INT) AS style FROM events")
def score_fallback(t):
    i = F.col("event_id")  # one score among words, both out of order, or none
    said = F.when(i % 3 == 0, F.concat(F.lit('so "relevance" : '), i % 10, F.lit(" and \"style\" is good")))
    said = said.when(i % 3 == 1, F.concat(F.lit('{"style":'), F.floor(i / 10) % 10, F.lit(', "relevance":\n '), i % 10, F.lit("}"))).otherwise("relevance: 7")
    return t("events").select("event_id", P.named_score(said, "relevance").alias("relevance"), P.named_score(said, "style").alias("style"))


@query("SELECT o_orderkey, concat('ORD', epoch_ms(o_orderdate), o_custkey) AS order_no, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created_at, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id, o_orderdate + INTERVAL 1 DAY AS expires_at FROM orders")
def order_numbers(t):
    ts = F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", P.order_number(ts, F.col("o_custkey")).alias("order_no"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("created_at"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("run_id"), F.expr("o_orderdate + interval 1 day").alias("expires_at"))


@query("SELECT c_custkey, concat('user_', substr('1380000' || CAST(c_custkey AS VARCHAR), 8)) AS username FROM customer")
def username_from_phone(t):
    return t("customer").select("c_custkey", F.concat(F.lit("user_"), F.substring(F.concat(F.lit("1380000"), F.col("c_custkey")), 8, 100)).alias("username"))


@query(r"SELECT event_id, 1 AS one, CAST(event_id % 4 AS INT) AS many, regexp_matches(props, ':\s*7\}') AS bad FROM events")
def json_objects(t):
    many = F.concat(F.lit("["), F.array_join(F.array_repeat("props", (F.col("event_id") % 4).cast("int")), ","), F.lit("]"))
    return t("events").select("event_id", P.objects_in(F.col("props")).alias("one"), P.objects_in(many).alias("many"), F.regexp_like("props", F.lit(r":\s*7\}")).alias("bad"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS rest FROM events""")
def json_key_delete(t):
    return t("events").select("event_id", P.without_key(F.concat(F.lit('{"__action":"x","k":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")), F.lit("}")), "__action").alias("rest"))


@query("SELECT source, 0 AS code, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages, min(doc_id) AS first_id FROM documents GROUP BY source")
def paged_envelope(t):
    d = t("documents").select("source", "doc_id")
    first = C.newest(d, ["source"], [F.col("doc_id")], 10).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("rows"))  # ten a source
    e = first.join(d.groupBy("source").agg(F.count("*").alias("n")), "source").select("source", P.envelope(F.col("rows"), F.col("n"), 1, 10).alias("e"))
    return e.select("source", "e.code", "e.data.total", F.ceil(F.col("e.data.total") / 10).alias("pages"), F.get("e.data.list", F.lit(0)).alias("first_id"))


@query("SELECT n_nationkey, CASE WHEN p <= 7 THEN p ELSE 7 END AS slots, p FROM (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) + 1 AS p FROM nation)")
def page_number_window(t):
    p = F.col("n_nationkey") + 1
    return t("nation").select("n_nationkey", F.size(P.page_numbers(p, F.least(p, F.lit(9)))).alias("slots"), p.alias("p"))


@query("SELECT conv_id, turn, trim(text) <> '' AND octet_length(encode(text)) <= 100 AS query_ok, turn * 20 <= 100 AND length(text) % 15 <= 10 AND role <> 'system' AS search_ok FROM conversations")
def argument_validators(t):
    sort = F.when(F.col("role") == "system", "oldest").when(F.col("role") == "user", "popular")
    return t("conversations").select("conv_id", "turn", P.valid_query(F.col("text")).alias("query_ok"), P.valid_search(sort, F.col("turn") * 20, F.length("text") % 15).alias("search_ok"))


# --- state and evaluation


@query("SELECT user_id, coalesce(list(event_id ORDER BY event_id) FILTER (event_type <> 'error'), []) AS completed, coalesce(list(event_id ORDER BY event_id) FILTER (event_type = 'error'), []) AS failed, count(*) FILTER (event_type <> 'error') > 0 AND count(*) FILTER (event_type = 'error') = 0 AS deliverable FROM events GROUP BY user_id")
def step_lists(t):
    return replay.steps(t("events"), "user_id", "event_id", F.col("event_type") != "error")


_CALLS = """c AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'view' THEN 'get_material_detail' WHEN 'click' THEN 'search_documents' WHEN 'signup' THEN 'search_materials' WHEN 'error' THEN 'my_materials' ELSE event_type END AS tool FROM events)"""


def _calls(t):
    """A user's events as calls: their arguments and results by the number in props."""
    tool, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    for a, b in {"view": "get_material_detail", "click": "search_documents", "signup": "search_materials", "error": "my_materials"}.items():
        tool = F.when(F.col("event_type") == a, b).otherwise(tool)
    d, k = t("events").select("user_id", "event_id", tool.alias("tool"), k.alias("k")), F.col("k")
    one = F.concat(F.lit('{"id":'), "k", F.lit(',"title":"t'), "k", F.lit('"}'))
    args = F.when(F.col("tool") == "get_material_detail", F.concat(F.lit('{"material_id":'), "k", F.lit("}"))).when(k % 3 == 0, '{"material_ids":[]}').otherwise(F.concat(F.lit('{"material_ids":['), "k", F.lit(",1]}")))
    result = F.when(F.col("tool") == "get_material_detail", F.when(k == 9, '{"is_owner":true}').otherwise("{}")).when(F.col("tool") == "search_documents", F.when(k == 8, "full text").otherwise("preview"))
    result = result.when(F.col("tool") == "search_materials", F.when(k == 7, "not json").otherwise(F.concat(F.lit('{"materials":['), one, F.lit("]}"))))
    result = result.when(k == 5, F.lit(None)).when(k > 5, F.concat(F.lit('{"materials":{"purchased":['), one, F.lit('],"published":['), one, F.lit("]}}"))).otherwise('{"materials":{}}')
    return d.withColumn("args", args).withColumn("result", result)


@query(f"""WITH {_CALLS}, d AS (SELECT *, tool = 'get_material_detail' AND row_number() OVER (PARTITION BY user_id, tool, k ORDER BY event_id) = 1 AS views,
  CASE tool WHEN 'get_material_detail' THEN k WHEN 'search_documents' THEN CASE WHEN k % 3 > 0 THEN k END END AS focus,
  CASE WHEN tool = 'search_materials' THEN CASE WHEN k = 7 THEN '' ELSE 't' || k END WHEN tool = 'my_materials' THEN CASE WHEN k > 5 THEN 't' || k || ',t' || k ELSE '' END END AS listed,
  (tool = 'get_material_detail' AND k = 9) OR (tool = 'search_documents' AND k = 8) OR (tool = 'my_materials' AND k > 5) AS access FROM c)
 SELECT event_id, views, last_value(focus IGNORE NULLS) OVER w AS focus_id, count(*) FILTER (views) OVER w AS viewed, last_value(listed IGNORE NULLS) OVER w AS candidates, bool_or(tool = 'purchase') OVER w AS card_sent, bool_or(access) OVER w AS has_access
 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def context_fold(t):
    d = replay.context(_calls(t), "user_id", "event_id", "tool", "args", "result")
    return d.select("event_id", "views", "focus_id", "viewed", F.array_join(F.transform("candidates", lambda c: c["title"]), ",").alias("candidates"), "card_sent", "has_access")


@query(f"""WITH {_CALLS}, d AS (SELECT *, (tool = 'get_material_detail' AND k = 0) OR (tool <> 'get_material_detail' AND k % 3 = 0) AS bad,
  CASE WHEN tool = 'get_material_detail' THEN k::VARCHAR WHEN k % 3 = 0 THEN '' ELSE k || ',1' END AS args FROM c),
 g AS (SELECT *, lag(tool) OVER w = tool AND lag(args) OVER w = args AS rep, row_number() OVER (PARTITION BY user_id, tool ORDER BY event_id) AS used FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, CASE WHEN rep THEN 'repeat' WHEN tool = 'my_materials' THEN 'unknown' WHEN bad THEN 'arguments' WHEN used > 5 AND tool <> 'purchase' THEN 'budget' ELSE 'executed' END AS gate FROM g""")
def gate_chain(t):
    known = ["get_material_detail", "search_documents", "search_materials", "purchase"]
    return replay.gated(_calls(t), "user_id", "event_id", "tool", "args", known, dict.fromkeys(known[:3], 5)).select("event_id", "gate")


@query("SELECT user_id, min(event_id) AS first_repeat FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS r FROM events WHERE event_type <> 'purchase') WHERE r >= 2 GROUP BY user_id")
def rule_duplicate(t):
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("event_id")
    d = t("events").where("event_type <> 'purchase'").withColumn("r", F.row_number().over(w)).where("r >= 2")
    return d.groupBy("user_id").agg(F.min("event_id").alias("first_repeat"))


@query("""WITH e AS (SELECT user_id, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, event_type, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_other FROM events)
 SELECT user_id, bool_or(coalesce(last_other > event_id, false)) AS recovered FROM e WHERE event_type = 'error' GROUP BY user_id""")
def rule_recovery(t):
    d = t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("last_other"), F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first_error"))
    return d.where("first_error is not null").select("user_id", F.coalesce(F.col("last_other") > F.col("first_error"), F.lit(False)).alias("recovered"))


@query("SELECT round(sum((quality = 1)::INT) * 100.0 / count(*), 6) AS pass_rate, printf('%.1f%%', sum((quality = 1)::INT) * 100.0 / count(*)) AS shown FROM labels")
def global_pass_rate(t):
    rate = F.sum((F.col("quality") == 1).cast("long")) * 100.0 / F.count("*")
    return t("labels").agg(F.round(rate, 6).alias("pass_rate"), F.format_string("%.1f%%", rate.cast("double")).alias("shown"))


@query("SELECT event_type, max(value) AS top, count(*) FILTER (value IS NULL) AS incomplete FROM events GROUP BY event_type")
def max_and_incomplete(t):
    return t("events").groupBy("event_type").agg(F.max("value").alias("top"), F.count_if(F.col("value").isNull()).alias("incomplete"))


@query("SELECT event_id, list_sum(list_transform(range(1, 2 + event_id % 3), lambda x: 1.0::DOUBLE / (60 + x))) AS s FROM events")
def reciprocal_ranks(t):
    n = F.col("event_id") % 3 + 1
    return t("events").select("event_id", F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda a, x: a + A.reciprocal_rank(x)).alias("s"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%b%' OR p_type ILIKE '%b%' ORDER BY p_partkey LIMIT 5")
def faq_top5(t):
    return t("part").where(C.contains_any(["p_name", "p_type"], "b")).orderBy("p_partkey").limit(5).select("p_partkey")


@query(f"""WITH {_POST}, {_TEXT_RANK}, {_OVERLAP},
 o AS (SELECT item_id, doc_id, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END, 6) AS score FROM t JOIN qt USING (item_id) JOIN dt USING (doc_id))
 SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o) WHERE rank <= 5""")
def rerank_by_overlap(t):
    q, d = t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text")
    first = R.top(R.text_scores(d, q).withColumn("score", F.round("score", 6)), "item_id", "doc_id", R.Config(k=5, rerank=True).candidates).select("item_id", "doc_id")
    s = first.join(q.withColumnRenamed("text", "question"), "item_id").join(d, "doc_id")
    s = s.select("item_id", "doc_id", F.round(R.overlap_rerank(F.col("question"), F.col("text")), 6).alias("score"))
    return R.top(s, "item_id", "doc_id", 5)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem")
def positional_reorder(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))
