"""Fields inside text and JSON: headings, titles, amounts, scores, arguments, envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Markers of an answer.
CITATION, REFUSALS = "《", ("未涉及", "未找到")


def stripped_markdown(x: Column) -> Column:
    """Plain text: images out, links to their text, marks deleted everywhere.

    The first opening mark is paired with the first `](` after it and the first `)` after that, over lines too, and the
    text is looked at anew from its start; it ends at an opening mark without such a pair. So what a removal joins can
    be an image or a link itself.
    """
    x = _unpaired(_unpaired(x, "![", keep=False), "[", keep=True)
    for mark in ("**", "__", "~~", "`", "#", "*", ">"):
        x = F.replace(x, F.lit(mark), F.lit(""))
    return trimmed(x)


def _unpaired(x: Column, mark: str, keep: bool) -> Column:
    """One pass over what lies between `](`: done has no mark any more, rest may have one, and over is what follows a pair that still lacks its `)`."""

    def step(t: Column, piece: Column) -> Column:
        done, rest, over = t["done"], t["rest"], t["over"]
        start, end = F.instr(rest, mark), F.instr(piece, ")")
        inner = F.substring(rest, start + len(mark), F.length(rest)) if keep else F.lit("")
        before = F.substring(rest, F.lit(1), F.greatest(start - 2, F.lit(0)))  # all but a character that may make a mark with what follows
        held = F.when(start > 1, F.substring(rest, start - 1, F.lit(1))).otherwise("")
        state = lambda a, b, c: F.struct(a.alias("done"), b.alias("rest"), c.alias("over"))
        return (
            F.when(start == 0, state(F.concat(done, rest, F.lit("](")), piece, F.lit("")))
            .when(end == 0, state(done, rest, F.concat(over, F.lit("]("), piece)))
            .otherwise(state(F.concat(done, before), F.concat(held, inner, F.substring(piece, end + 1, F.length(piece))), F.lit("")))
        )

    pieces = F.split(x, r"\]\(")
    start = F.struct(F.lit("").alias("done"), F.get(pieces, F.lit(0)).alias("rest"), F.lit("").alias("over"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), start, step, lambda t: F.concat(t["done"], t["rest"], t["over"]))


def without_heading_marks(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, r"(?md)^#{1,6}\s+", ""))


def markdown_title(x: Column, name: Column) -> Column:
    """The first line among nine that starts with one hash, else the file's name."""
    head = F.filter(F.slice(F.split(x, "\n", 10), 1, 9), lambda v: v.startswith("# "))
    return F.coalesce(trimmed(F.substring(F.get(head, F.lit(0)), 3, 1 << 30)), F.regexp_replace(F.regexp_extract(name, r"([^/]*)\z", 1), r"\.md\z", ""))


def amount(x: Column) -> Column:
    return F.regexp_extract(x, r"¥[\d.]+", 0)


def book(x: Column) -> Column:
    return F.regexp_extract(x, "《[^》]*》", 0)


def corrected(answer: Column, claimed: Column, right: Column) -> Column:
    """The first occurrence of what is claimed replaced, if both are known and differ."""
    at = F.instr(answer, claimed)
    swap = F.concat(F.substring(answer, F.lit(1), at - 1), right, F.substring(answer, at + F.length(claimed), F.length(answer)))
    return F.when((claimed != "") & (right != "") & (claimed != right) & (at > 0), swap).otherwise(answer)


def answer_flags(x: Column) -> tuple[Column, Column]:
    refusal = F.lit(False)
    for w in REFUSALS:
        refusal = refusal | x.contains(w)
    return x.contains(CITATION), refusal


def list_items(x: Column) -> Column:
    """Lines without their numbers and blanks; empty ones dropped."""
    own = F.transform(F.split(x, "\n"), lambda v: trimmed(F.regexp_replace(trimmed(v), r"^[0-9.、)）]+", "")))
    return F.filter(own, lambda v: v != "")


def named_score(x: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.regexp_extract(x, f'"{name}"\\s*:\\s*(\\d)', 1), ","), F.lit(1)).try_cast("int"), F.lit(0))


def order_number(ts: Column, user: Column) -> Column:
    return F.concat(F.lit("ORD"), F.unix_millis(ts), user)


def invalid_arguments(args: Column) -> Column:
    """What is wrong with a call's arguments, as an array: an id of 0, no ids, no query. These forms alone are looked for."""
    found = lambda name, *forms: F.when(F.exists(F.array(*[F.lit(x) for x in forms]), lambda f: args.contains(f)), F.lit(name))
    return F.filter(F.array(found("material_id", '"material_id":0'), found("material_ids", '"material_ids":[]', '"material_ids": []'), found("query", '"query":""', '"query":" "')), lambda x: x.isNotNull())


#: The sorts that a search may ask for, its most pages and rows, and the most bytes of a query.
SORTS, MOST_PAGES, MOST_ROWS, MOST_QUERY = ("newest", "price_asc", "price_desc", "popular", ""), 100, 10, 100


def valid_search(sort_by: Column, page: Column, size: Column) -> Column:
    return F.coalesce(sort_by, F.lit("")).isin(*SORTS) & (F.coalesce(page, F.lit(0)) <= MOST_PAGES) & (F.coalesce(size, F.lit(0)) <= MOST_ROWS)


def valid_query(query: Column) -> Column:
    """1 to 100 bytes that are not all blank."""
    return (trimmed(F.coalesce(query, F.lit(""))) != "") & (F.octet_length(F.coalesce(query, F.lit(""))) <= MOST_QUERY)


def found_nothing(result: Column) -> Column:
    return result.contains('"found":false')


def candidates(result: Column) -> Column:
    """The materials (id, title) of a tool's result object; of anything else none."""
    kind = "array<struct<id:bigint,title:string>>"
    return F.coalesce(F.from_json(F.get_json_object(result, "$.materials"), kind), F.array().cast(kind))


def listed_candidates(result: Column, own: Column) -> Column:
    """The materials of a list; of the user's own first those published, then those purchased."""
    kind = "array<struct<id:bigint,title:string>>"
    part = lambda name: F.coalesce(F.from_json(F.get_json_object(result, f"$.materials.{name}"), kind), F.array().cast(kind))
    return F.when(own, F.concat(part("published"), part("purchased"))).otherwise(candidates(result))


#: How a step of each tool is told; the first blank is its argument, the second a count.
STEPS = {"search_materials": ("搜索「%s」→ 找到 %d 门资料", "$.keyword"), "search_documents": ("检索「%s」→ %d 条片段", "$.query"), "search_faq": ("查询「%s」→ %d 条", "$.keyword")}


def step_text(tool: Column, args: Column, n: Column) -> Column:
    """A step in words, from its arguments and the number of objects in its result; other tools by their name."""
    out = tool
    for name, (form, path) in STEPS.items():
        out = F.when(tool == name, F.format_string(form, F.coalesce(F.get_json_object(args, path), F.lit("")), n)).otherwise(out)
    return out


def message_trace(role: Column, content: Column, call_id: Column, calls: Column) -> Column:
    """A message as JSON: its calls (id, name, arguments) nested, empty parts left out."""
    nested = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    return F.to_json(F.struct(role.alias("role"), content.alias("content"), F.when(call_id != "", call_id).alias("tool_call_id"), F.when(F.size(calls) > 0, nested).alias("tool_calls")))


def without_key(x: Column, key: str) -> Column:
    """A flat JSON object without one key."""
    return F.to_json(F.map_filter(F.from_json(x, "map<string,string>"), lambda k, _: k != key))


def objects_in(x: Column) -> Column:
    """How many objects a JSON text holds at its top: those of an array, or one."""
    t = trimmed(x)
    return F.coalesce(F.when(t.startswith("["), F.json_array_length(t)).when(t.startswith("{"), F.lit(1)), F.lit(0))


def envelope(rows: Column, total: Column, page: int, size: int) -> Column:
    data = F.struct(rows.alias("list"), total.alias("total"), F.lit(page).alias("page"), F.lit(size).alias("page_size"))
    return F.struct(F.lit(0).alias("code"), F.lit("success").alias("message"), data.alias("data"))


def page_numbers(pages: Column, current: Column) -> Column:
    """All numbers of up to seven pages, else the first, those around the current one, and the last, with dots between (0)."""
    short = F.sequence(F.lit(1), F.greatest(pages, F.lit(1)))
    near_start, near_end = F.concat(F.sequence(F.lit(1), F.lit(5)), F.array(F.lit(0), pages)), F.concat(F.array(F.lit(1), F.lit(0)), F.sequence(pages - 4, pages))
    middle = F.concat(F.array(F.lit(1), F.lit(0)), F.sequence(current - 1, current + 1), F.array(F.lit(0), pages))
    return F.when(pages <= 7, short).when(current <= 4, near_start).when(current >= pages - 3, near_end).otherwise(middle)
