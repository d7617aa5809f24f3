"""More queries: rules over traces of tool calls, searches through caches, extraction and ingestion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import catalogue as C
from ..operators import evaluation, ingest, replay
from ..operators import retrieval as R
from ..sources import files, routes
from .queries import _COS, _POST, query

# --- traces: a user's events in stretches of a thousand ids are the runs of a tool-calling agent

_TASKS = """c AS (SELECT user_id AS u, user_id || '-' || (event_id // 1000) AS task_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) AS k, props,
  CASE event_type WHEN 'view' THEN 'get_material_detail' WHEN 'click' THEN 'search_documents' WHEN 'signup' THEN 'get_orders' WHEN 'error' THEN 'search_faq' ELSE event_type END AS tool FROM events),
 d AS (SELECT *, CASE k % 7 WHEN 0 THEN '{"material_id":0}' WHEN 1 THEN '{"material_ids": [],"query":""}' WHEN 2 THEN '{"query":" "}' ELSE props END AS args,
  tool = 'search_faq' AND k % 3 = 1 AND k % 2 = 0 AS failed, u % 4 = 0 AND tool = 'search_faq' AS bad FROM c),
 t AS (SELECT task_id, any_value(u) AS u, count(*) AS n, bool_or(tool = 'purchase') AS bought, bool_or(tool = 'get_material_detail') AS looked, bool_or(tool = 'get_orders') AS ordered, bool_or(bad) AS bad FROM d GROUP BY 1)"""


def _tasks(t):
    kinds = {"view": "get_material_detail", "click": "search_documents", "signup": "get_orders", "error": "search_faq"}
    tool = F.col("event_type")
    for a, b in kinds.items():
        tool = F.when(F.col("event_type") == a, b).otherwise(tool)
    k = F.get_json_object("props", "$.k").cast("int")
    args = F.when(k % 7 == 0, '{"material_id":0}').when(k % 7 == 1, '{"material_ids": [],"query":""}').when(k % 7 == 2, '{"query":" "}').otherwise(F.col("props"))
    code = F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "NOT_FOUND").when(k % 3 == 1, "TIMEOUT").otherwise(""))
    call = F.struct(F.col("event_id").alias("seq"), tool.alias("tool"), args.alias("args"), code.alias("error_code"), (k % 2 == 0).alias("recoverable"))
    d = t("events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.array_sort(F.collect_list(call)).alias("calls"))  # at most a thousand
    u = F.col("user_id")
    said = F.when(u % 3 == 0, "我要学 Go").when(u % 3 == 1, "就这个").otherwise("hello")
    return d.select(
        F.concat_ws("-", "user_id", "part").alias("task_id"), "calls", said.alias("input"), F.repeat(F.lit("答"), (u % 200 + 400).cast("int")).alias("answer"), (u % 2 == 0).alias("has_access"),
        F.array(F.lit("get_material_detail"), F.lit("get_orders")).alias("required"), F.when(u % 4 == 0, F.array(F.lit("search_faq"))).otherwise(F.array().cast("array<string>")).alias("forbidden"), (u % 8).cast("int").alias("max_steps"),
    )


@query(f"""WITH {_TASKS},
 f AS (SELECT task_id, min(seq) FILTER (failed) AS first_failed, max(seq) FILTER (tool <> 'search_faq') AS last_other FROM d GROUP BY 1),
 w AS (SELECT task_id, x FROM (SELECT task_id, seq, unnest([CASE WHEN contains(args, '"material_id":0') THEN 'material_id' END, CASE WHEN contains(args, '"material_ids":[]') OR contains(args, '"material_ids": []') THEN 'material_ids' END, CASE WHEN contains(args, '"query":""') OR contains(args, '"query":" "') THEN 'query' END]) AS x FROM d) WHERE x IS NOT NULL),
 p AS (SELECT task_id, max(m) AS m FROM (SELECT task_id, CASE WHEN tool = 'purchase' THEN 0 ELSE count(*) END AS m FROM d GROUP BY task_id, tool, args) GROUP BY 1)
 SELECT task_id, 'forbidden_tool' AS rule, false AS passed FROM d WHERE bad UNION ALL SELECT task_id, 'forbidden_tool', true FROM t WHERE NOT bad
 UNION ALL SELECT task_id, 'required_tool', false FROM t WHERE NOT looked UNION ALL SELECT task_id, 'required_tool', false FROM t WHERE NOT ordered UNION ALL SELECT task_id, 'required_tool', true FROM t WHERE looked AND ordered
 UNION ALL SELECT task_id, 'max_steps', NOT (u % 8 > 0 AND n > u % 8) FROM t UNION ALL SELECT task_id, 'duplicate_call', m < 2 FROM p
 UNION ALL SELECT task_id, 'purchase_before_check', NOT bought OR looked FROM t UNION ALL SELECT task_id, 'full_content_leak', u % 2 = 0 OR 400 + u % 200 <= 500 FROM t
 UNION ALL SELECT task_id, 'error_recovery', first_failed IS NULL OR coalesce(last_other > first_failed, false) FROM f UNION ALL SELECT task_id, 'premature_purchase', NOT bought OR u % 3 < 2 FROM t
 UNION ALL SELECT task_id, 'invalid_args', false FROM w UNION ALL SELECT task_id, 'invalid_args', true FROM t WHERE task_id NOT IN (SELECT task_id FROM w)""")
def rule_checks(t):
    return evaluation.scored(_tasks(t)).select("task_id", "rule", "passed")


@query(f"""WITH {_TASKS},
 x AS (SELECT tool, 1 AS called, bad::INT AS bad, 0 AS missing FROM d UNION ALL SELECT 'get_material_detail', 0, 0, 1 FROM t WHERE NOT looked UNION ALL SELECT 'get_orders', 0, 0, 1 FROM t WHERE NOT ordered)
 SELECT tool, sum(called) AS called, sum(bad) AS in_forbidden, sum(missing) AS missing_required, round((sum(called) - sum(bad)) / (sum(called) + sum(missing)), 6) AS accuracy FROM x GROUP BY tool""")
def tool_accuracy(t):
    return evaluation.tool_accuracy(_tasks(t))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS args FROM events),
 c AS (SELECT *, row_number() OVER (PARTITION BY user_id, args ORDER BY event_id) AS n FROM e WHERE event_type IN ('view', 'click')), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, args ORDER BY event_id) AS n FROM e WHERE event_type IN ('error', 'signup'))
 SELECT c.user_id, c.event_id, c.args, CASE WHEN r.event_id > c.event_id THEN r.event_id END AS result_id, CASE WHEN r.event_id > c.event_id THEN r.event_type END AS result FROM c LEFT JOIN r USING (user_id, args, n)""")
def paired_calls(t):
    e = t("events").select("user_id", "event_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 5).alias("args"))
    calls, results = e.where(F.col("event_type").isin("view", "click")), e.where(F.col("event_type").isin("error", "signup"))
    d = evaluation.paired(calls.drop("event_type"), results, "user_id", "event_id", ["args"])
    return d.select("user_id", "event_id", "args", F.col("result_event_id").alias("result_id"), F.col("result_event_type").alias("result"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE (l_quantity * l_discount + l_extendedprice * l_tax) / (l_discount + l_tax) END, 8) AS score FROM lineitem")
def weighted_scores(t):
    s = evaluation.weighted_score([F.col("l_quantity"), F.col("l_extendedprice")], [F.col("l_discount"), F.col("l_tax")])
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(s, 8).alias("score"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src1'")
def task_filter(t):
    return evaluation.selected(t("documents").withColumnsRenamed({"lang": "category", "source": "task_id"}), "de", "src1").select("doc_id")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '搜索「' || json_extract_string(props, '$.k') || '」→ 找到 ' || user_id || ' 门资料' WHEN 'view' THEN '检索「' || json_extract_string(props, '$.k') || '」→ ' || user_id || ' 条片段' WHEN 'error' THEN '查询「」→ ' || user_id || ' 条' ELSE event_type END AS step FROM events""")
def step_texts(t):
    tool = F.when(F.col("event_type") == "click", "search_materials").when(F.col("event_type") == "view", "search_documents").when(F.col("event_type") == "error", "search_faq").otherwise(F.col("event_type"))
    path = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "keyword").otherwise("other")
    args = F.concat(F.lit('{"'), path, F.lit('":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return t("events").select("event_id", P.step_text(tool, args, F.col("user_id")).alias("step"))


@query("""SELECT conv_id, turn, md5('{"role":' || to_json(role) || ',"content":' || to_json(text) || CASE WHEN turn % 3 = 0 THEN ',"tool_call_id":"c' || turn || '"' ELSE '' END || CASE WHEN role = 'assistant' THEN ',"tool_calls":[{"id":"c' || turn || '","type":"function","function":{"name":"f","arguments":"{}"}}]' ELSE '' END || '}') AS item FROM conversations""")
def message_traces(t):
    one = F.array(F.struct(F.concat(F.lit("c"), F.col("turn")).alias("id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments")))
    calls = F.when(F.col("role") == "assistant", one).otherwise(F.slice(one, 1, 0))
    call_id = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("c"), F.col("turn"))).otherwise("")
    return t("conversations").select("conv_id", "turn", F.md5(P.message_trace(F.col("role"), F.col("text"), call_id, calls)).alias("item"))


@query("""SELECT user_id AS run, event_id AS seq, 'assistant' AS role, '{"type":"' || event_type || '","payload":"' || user_id || '"}' AS content FROM events WHERE event_type = 'purchase'""")
def action_rows(t):
    result = F.when(F.col("event_type") == "purchase", F.format_string('{"__action":"%s","payload":%d}', "event_type", "user_id")).otherwise(F.col("props"))
    return replay.action_rows(t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), result.alias("result")))


@query("SELECT conv_id AS run, turn AS seq, 'assistant' AS role, md5(text) AS content, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_count FROM conversations WHERE role = 'assistant' AND text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def final_answers(t):
    last = C.newest(t("conversations").where("role = 'assistant' and text <> ''"), ["conv_id"], [F.desc("turn")], 1)
    d = replay.final_rows(last.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("text").alias("answer")), F.ceil(F.length("answer") / 4))
    return d.withColumn("content", F.md5("content"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN [event_id, user_id] ELSE [] END AS ids, event_type = 'error' AS nothing FROM events""")
def candidate_lists(t):
    listed = F.format_string('{"success":true,"materials":[{"id":%d,"title":"a"},{"id":%d,"title":"b"}]}', "event_id", "user_id")
    result = F.when(F.col("event_type") == "view", listed).when(F.col("event_type") == "error", '{"found":false}').otherwise(F.col("props"))
    return t("events").select("event_id", F.transform(P.candidates(result), lambda x: x["id"]).alias("ids"), P.found_nothing(result).alias("nothing"))


# --- searches


_ASKED = """a AS (SELECT item_id, text, item_id % 5 AS course, item_id % 2 = 0 AS paid, embedding FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""


def _asked(t):
    e = t("embeddings").select(F.col("vec_id").alias("request_id"), "embedding")
    i = t("benchmark").select(F.col("item_id").alias("request_id"), "text", (F.col("item_id") % 5).alias("course_id"), (F.col("item_id") % 2 == 0).alias("has_access"), (F.col("item_id") % 7).alias("user_id"))
    return i.join(e, "request_id", "left")


def _chunks(t):
    e = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return t("documents").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 5).alias("course_id")).join(e, "chunk_id", "left")


_SCORED = "SELECT item_id, doc_id, round(sum(tf * log10(n / df) * log10(n / df)), 6) AS score FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY 1, 2"


def _fused(asked: str, same: str) -> str:
    """SQL of vector and text ranks, fused, for rows (item_id, course, embedding) of asked; five of each (item_id, course)."""
    return f"""v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, course ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.item_id, a.course, b.vec_id AS doc_id, round({_COS}, 4) AS score FROM {asked} a, embeddings b WHERE a.embedding IS NOT NULL AND b.vec_id % 5 = {same} AND b.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 5),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, course ORDER BY score DESC, doc_id) AS rank FROM (SELECT x.item_id, a.course, x.doc_id, x.score FROM ({_SCORED}) x JOIN {asked} a ON x.item_id = a.item_id AND x.doc_id % 5 = {same})) WHERE rank <= 5),
 u AS (SELECT *, row_number() OVER (PARTITION BY item_id, course ORDER BY score DESC, doc_id) AS rank FROM (SELECT coalesce(v.item_id, t.item_id) AS item_id, coalesce(v.course, t.course) AS course, coalesce(v.doc_id, t.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0), 8) AS score FROM v FULL JOIN t ON v.item_id = t.item_id AND v.course = t.course AND v.doc_id = t.doc_id))"""


@query(f"""WITH {_POST}, {_ASKED}, l AS (SELECT max(item_id) AS last FROM benchmark),
 e AS (SELECT min(b.item_id) AS entry_id, a.item_id, count(*) AS k FROM a JOIN a b ON a.text = b.text AND a.course = b.course AND a.paid = b.paid AND b.item_id % 3 = 0 AND b.item_id % 2 = 0 GROUP BY 2),
 r AS (SELECT a.* FROM a WHERE item_id NOT IN (SELECT item_id FROM e)),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course, paid ORDER BY item_id DESC) AS place FROM a WHERE embedding IS NOT NULL) WHERE place <= 10),
 m AS (SELECT * FROM (SELECT a.item_id, b.item_id AS entry_id, row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id DESC) AS place FROM r a JOIN n b ON a.course = b.course AND a.paid = b.paid WHERE a.embedding IS NOT NULL AND round({_COS}, 4) >= 0.3) WHERE place = 1),
 z AS (SELECT * FROM r WHERE item_id NOT IN (SELECT item_id FROM m)), {_fused("z", "a.course")}
 SELECT item_id AS request_id, entry_id AS chunk_id, 1.0::DOUBLE AS score, 1 AS rank, 'exact' AS via FROM e UNION ALL SELECT item_id, entry_id, 0.5, 1, 'similar' FROM m UNION ALL SELECT item_id, doc_id, score, rank, 'search' FROM u WHERE rank <= 5""")
def cached_search(t):
    """Entries name the request that made them; those of the exact cache are of every third request, every other one live."""
    asked = _asked(t)
    one = lambda score: F.array(F.struct(F.col("request_id").alias("chunk_id"), F.lit(score).alias("score"))).alias("results")
    key = R.exact_key(F.col("text"), F.col("course_id"), R.access_pool(F.col("has_access")))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    until = F.when(F.col("request_id") % 2 == 0, now + F.expr("INTERVAL 1 HOUR")).otherwise(now)
    exact = C.newest(asked.where("request_id % 3 = 0").select(key.alias("key"), one(1.0), until.alias("expires_at"), "request_id"), ["key", "expires_at"], [F.col("request_id")], 1).drop("request_id")
    recent = asked.where("embedding is not null").select("course_id", R.access_pool(F.col("has_access")).alias("access"), F.col("request_id").alias("entry_id"), F.col("request_id").alias("ts"), F.col("embedding").alias("cached_vector"), one(0.5))
    return R.search(asked, _chunks(t), R.Config(alike=0.3), exact, recent, now).results


@query(f"""WITH {_POST}, {_ASKED}, y AS (SELECT item_id, embedding, c AS course FROM a, (SELECT unnest(range(5)) AS c) WHERE (item_id % 7 + c) % 2 = 0), {_fused("y", "a.course")}
 SELECT item_id AS request_id, course AS course_id, doc_id AS chunk_id, score, rank FROM u WHERE rank <= 5""")
def search_each_course(t):
    users = t("benchmark").select((F.col("item_id") % 7).alias("user_id")).distinct()
    accessible = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("course_id")).where((F.col("user_id") + F.col("course_id")) % 2 == 0)
    return R.search_each(_asked(t).drop("course_id"), accessible, _chunks(t), R.Config())


# --- extraction and ingestion

_MARKED = "'## Q' || doc_id || ': ' || lang || chr(10) || 'not yet' || chr(10) || '**参考回答：**' || chr(10) || regexp_replace(replace(replace(replace(text, ', ', chr(10) || '**追问：'), 'th', '--'), '; ', '**' || chr(10)), '\\. ', chr(10) || '## ', 'g') || chr(10) || '**Q: why?**' || chr(10) || source || chr(10) || '**追问：more**' || chr(10) || '---' || chr(10) || 'end'"


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, string_split({_MARKED}, chr(10)) AS ls FROM documents),
 s AS (SELECT doc_id, ls, 0 AS i, '' AS mode, false AS open, '' AS q, '' AS a, '' AS eq, '' AS ea FROM l UNION ALL
  SELECT doc_id, ls, i + 1,
   CASE WHEN kind = 'main' THEN 'main' WHEN kind IN ('extra', 'more') THEN 'extra' WHEN kind = 'end' THEN '' ELSE mode END,
   CASE WHEN kind IN ('main', 'end') THEN false WHEN kind IN ('extra', 'more', 'answer') THEN true ELSE open END,
   CASE kind WHEN 'main' THEN substr(line, 4) WHEN 'extra' THEN trim(regexp_replace(substr(line, 5), '\*\*$', '')) WHEN 'more' THEN trim(regexp_replace(substr(line, 6), '\*\*$', '')) WHEN 'end' THEN '' ELSE q END,
   CASE WHEN kind IN ('main', 'extra', 'more', 'end') THEN '' WHEN kind = 'inner' THEN a || chr(10) || chr(10) || regexp_replace(substr(line, 3), '\*\*$', '') WHEN kind = 'text' AND open AND line <> '' THEN a || line || chr(10) ELSE a END,
   CASE WHEN kind IN ('main', 'extra', 'more', 'end') THEN q ELSE '' END, CASE WHEN kind IN ('main', 'extra', 'more', 'end') THEN a ELSE '' END
  FROM (SELECT *, CASE WHEN starts_with(line, '## Q') AND contains(line, ':') THEN 'main' WHEN starts_with(line, '**Q:') THEN 'extra' WHEN starts_with(line, '**追问：') THEN CASE WHEN mode = 'main' AND open THEN 'inner' ELSE 'more' END
    WHEN starts_with(line, '### ') OR starts_with(line, '# ') OR (starts_with(line, '## ') AND NOT contains(line, 'Q')) THEN 'skip' WHEN starts_with(line, '**参考回答：**') OR starts_with(line, '**参考答案：**') THEN 'answer'
    WHEN starts_with(line, '---') AND mode = 'main' AND open THEN 'end' WHEN starts_with(line, '---') AND mode = 'extra' THEN 'skip' ELSE 'text' END AS kind FROM (SELECT *, ls[i + 1] AS line FROM s WHERE i < len(ls)))),
 f AS (SELECT doc_id, i, eq AS q, ea AS a FROM s WHERE eq <> '' UNION ALL SELECT doc_id, i + 1, q, a FROM s WHERE i = len(ls) AND q <> '')
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, q AS question, md5(regexp_replace(a, '^\s+|\s+$', '', 'g')) AS answer FROM f""")
def question_extraction(t):
    text = F.replace(F.replace(F.replace("text", F.lit(", "), F.lit("\n**追问：")), F.lit("th"), F.lit("--")), F.lit("; "), F.lit("**\n"))
    text = F.concat(F.lit("## Q"), "doc_id", F.lit(": "), "lang", F.lit("\nnot yet\n**参考回答：**\n"), F.regexp_replace(text, r"\. ", "\n## "), F.lit("\n**Q: why?**\n"), "source", F.lit("\n**追问：more**\n---\nend"))
    return routes.questions(t("documents").select("doc_id", text.alias("text"))).withColumn("answer", F.md5("answer"))


@query("SELECT count(*) AS articles, CAST(sum(greatest(n, 1)) AS BIGINT) AS documents FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id)")
def dry_run(t):
    section = F.struct(F.concat(F.lit("t"), "turn").alias("title"), F.col("text").alias("content"))
    d = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", section))).alias("sections"))
    return ingest.planned(d.select(F.lit("a").alias("title"), F.lit("c").alias("content"), "sections"))


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
 SELECT 'c' || conv_id AS article, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS sort_order, 't' || turn AS title, md5(text) AS content FROM u
 UNION ALL SELECT DISTINCT 'c' || conv_id, 0, 'c' || conv_id, md5('whole') FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM u)""")
def article_documents(t):
    section = F.when(F.col("role") == "user", F.struct("turn", "text"))
    d = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    d = d.select(F.concat(F.lit("c"), "conv_id").alias("title"), F.lit("whole").alias("content"), F.transform("s", lambda x: F.struct(F.concat(F.lit("t"), x["turn"]).alias("title"), x["text"].alias("content"))).alias("sections"))
    return ingest.documents_of(d).withColumn("content", F.md5("content"))


@query("""SELECT left(url || '.md', 200) AS title, CASE WHEN trim(html) = '' OR html IS NULL THEN NULL ELSE md5(html) END AS content, 'draft' AS status, 'md' AS format, CASE WHEN trim(coalesce(html, '')) = '' THEN 'empty' END AS error FROM pages
 UNION ALL SELECT left(p_name || '.exe', 200), NULL, 'draft', 'exe', 'unsupported' FROM part""")
def uploaded_files(t):
    d = t("pages").select(F.concat("url", F.lit(".md")).alias("name"), F.col("html").alias("text")).unionByName(t("part").select(F.concat("p_name", F.lit(".exe")).alias("name"), F.col("p_type").alias("text")))
    return ingest.uploaded(d).withColumn("content", F.md5("content"))


@query("SELECT o_orderkey, o_orderdate::DATE < DATE '1995-06-17' - 7 AND o_orderkey % 5 > 0 AS expired FROM orders")
def log_retention(t):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(F.col("o_orderkey") % 5 == 0, F.lit("app-current.log")).otherwise(F.concat(F.lit("app-"), date, F.lit(".log")))
    return t("orders").select("o_orderkey", files.log_expired(name, F.lit("1995-06-17").cast("date")).alias("expired"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_size % 3 = 1 THEN 7 ELSE p_size END AS p_size, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_retailprice END AS p_retailprice FROM part""")
def given_fields(t):
    """An empty name is a value (not null), a size of 0 is none (non-zero), a price of 0 is one and -1 none (not negative)."""
    p = t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    new = p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "new").alias("p_name"), F.when(F.col("p_size") % 3 == 1, 7).when(F.col("p_size") % 3 == 2, 0).alias("p_size"), F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(-1.0).alias("p_retailprice"))
    return C.changed(p, new, "p_partkey", {"p_name": "not_null", "p_size": "non_zero", "p_retailprice": "not_negative"})
