"""Rules over logs of tool calls, as windows: repeats, loops, budgets, modes, facts, and the request limiter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import invalid_arguments, listed_candidates
from ..functions.text import bigrams, collapsed, cut, jaccard
from ..shipping import ship

#: Calls a run may make of each tool.
BUDGETS = {"purchase": 3, "search_documents": 10, "search_materials": 5, "get_material_detail": 10, "my_materials": 5, "get_orders": 5, "search_faq": 5}


def repeats(calls: DataFrame, run: str, seq: str, tool: str, args: str, may_repeat: list[str] | None = None) -> DataFrame:
    """Adds blocked: whether the call before in the run had the same tool and arguments, and the tool may not repeat."""
    w = Window.partitionBy(run).orderBy(seq)
    same = (F.lag(tool).over(w) == F.col(tool)) & F.lag(args).over(w).eqNullSafe(F.col(args))
    return calls.withColumn("blocked", F.coalesce(same, F.lit(False)) & ~F.col(tool).isin(may_repeat or []))


def loops(results: DataFrame, run: str, seq: str, text: str, over: float = 0.8, most: int = 200) -> DataFrame:
    """Adds looping: whether the last three texts of the run are all alike, two by two."""
    w = Window.partitionBy(run).orderBy(seq)
    # behind the exchange that the window needs anyway, so that the text is cut once and not for each of its places
    d = results.withColumn("_x", cut(collapsed(F.col(text)), most)).repartition(run).withColumn("_g", bigrams(F.col("_x"))).drop("_x")
    d = d.withColumn("_g1", F.lag("_g", 1).over(w)).withColumn("_g2", F.lag("_g", 2).over(w))
    alike = [jaccard(F.col(a), F.col(b)) > over for a, b in (("_g", "_g1"), ("_g", "_g2"), ("_g1", "_g2"))]
    return d.withColumn("looping", F.col("_g2").isNotNull() & F.when(alike[0], F.when(alike[1], alike[2])).eqNullSafe(F.lit(True))).drop("_g", "_g1", "_g2")


def budgeted(calls: DataFrame, run: str, seq: str, tool: str, budgets: dict[str, int] | None = None) -> DataFrame:
    """Adds used (calls of the tool in the run so far) and within; unknown tools have no budget."""
    limit = F.lit(0)
    for t, n in (budgets or BUDGETS).items():
        limit = F.when(F.col(tool) == t, n).otherwise(limit)
    w = Window.partitionBy(run, tool).orderBy(seq)
    return calls.withColumn("used", F.row_number().over(w)).withColumn("within", F.col("used") <= limit)


def modes(calls: DataFrame, run: str, seq: str, decided: Column, start: str) -> DataFrame:
    """Adds mode: the latest decision at or before each call, or the start."""
    w = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("mode", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(start)))


def facts(calls: DataFrame, run: str, source: list[str], seq: str) -> DataFrame:
    """Adds layer: the newest call of a source is the fact, older ones are discarded."""
    w = Window.partitionBy(run, *source).orderBy(F.desc(seq))
    return calls.withColumn("layer", F.when(F.row_number().over(w) == 1, "fact").otherwise("discarded"))


#: What in a tool's result says that the user may read the material.
ACCESS_MARKS = {"search_documents": ("full",), "get_material_detail": ("has_purchased", "is_owner"), "my_materials": ("published", "purchased")}


def context(calls: DataFrame, run: str, seq: str, tool: str, args: str, result: str) -> DataFrame:
    """Adds what a run's context holds after each call: focus_id, viewed, views, candidates, card_sent and has_access.

    The focus is the material of the last detail, or the first of the last document search that names any. views tells whether a call adds a material
    to those viewed, viewed how many there are (their ids are those of the calls that add one, so no row carries a growing
    set). Candidates are those of the last list that was asked for, by material search or of the user's own, none where
    it can't be read. An offer sends the card; what a result says of access holds from then on.
    """
    name, said = F.col(tool), F.coalesce(F.col(result), F.lit(""))
    upto = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    named = F.coalesce(F.get_json_object(F.col(args), "$.material_id").try_cast("long"), F.lit(0))
    first = F.get_json_object(F.col(args), "$.material_ids[0]").try_cast("long")
    detail, lists = name == "get_material_detail", name.isin("search_materials", "my_materials")
    focus = F.when(detail, named).when(name == "search_documents", first)
    access = F.lit(False)
    for t, marks in ACCESS_MARKS.items():
        for m in marks:
            access = access | ((name == t) & said.contains(m))
    d = calls.withColumn("_seen", F.when(detail, named))
    again = F.row_number().over(Window.partitionBy(run, "_seen").orderBy(seq)) > 1
    d = d.withColumn("views", F.col("_seen").isNotNull() & ~again).drop("_seen")
    own = F.when(lists, F.struct(listed_candidates(said, name == "my_materials").alias("c")))
    return d.select(
        "*", F.last(focus, ignorenulls=True).over(upto).alias("focus_id"), F.count(F.when(F.col("views"), 1)).over(upto).alias("viewed"),
        F.last(own, ignorenulls=True).over(upto)["c"].alias("candidates"), F.max(name == "purchase").over(upto).alias("card_sent"), F.max(access).over(upto).alias("has_access"),
    )


def gated(calls: DataFrame, run: str, seq: str, tool: str, args: str, known: list[str], budgets: dict[str, int] | None = None, may_repeat: list[str] | None = None) -> DataFrame:
    """Adds gate: the first that stops each call, in the loop's order (repeat, unknown, arguments, budget), or executed.

    A budget counts all calls of a tool so far; a known tool without a budget has none to exceed.
    """
    limits = {t: n for t, n in (BUDGETS if budgets is None else budgets).items()}
    d = budgeted(repeats(calls, run, seq, tool, args, may_repeat), run, seq, tool, limits)
    gate = F.coalesce(
        F.when(F.col("blocked"), "repeat"), F.when(~F.coalesce(F.col(tool).isin(known), F.lit(False)), "unknown"), F.when(F.size(invalid_arguments(F.coalesce(F.col(args), F.lit("")))) > 0, "arguments"),
        F.when(F.col(tool).isin(list(limits)) & ~F.col("within"), "budget"), F.lit("executed"),
    )
    return d.withColumn("gate", gate).drop("blocked", "used", "within")


def steps(calls: DataFrame, run: str, seq: str, ok: Column, last: int | None = None) -> DataFrame:
    """(run, completed, failed, deliverable): the steps of each kind in order, and whether a run has done something and failed at nothing.

    Lists are those of one run, whose rounds are limited; where they aren't, last keeps so many of each kind, the newest.
    """
    d = calls.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    if last is not None:
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(run, "_ok").orderBy(F.desc(seq)))).where(F.col("_r") <= last)
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(seq))))
    d = d.groupBy(run).agg(pick(F.col("_ok")).alias("completed"), pick(~F.col("_ok")).alias("failed"))
    return d.withColumn("deliverable", (F.size("completed") > 0) & (F.size("failed") == 0))


def admitted(requests: DataFrame, key: str, second: str, limit: int, window: int = 60, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds admitted to each request, by a sliding log of the seconds in which requests were admitted.

    A request is admitted if fewer than limit different seconds of the last window hold admitted ones; rejected
    requests leave no trace, so the rule is a fold over each key's requests in order (of order within a second). Each key is a
    stream of its own through mapInPandas, over rows sorted by Spark: the state is one window of one key.
    """
    ship(requests.sparkSession)
    schema = requests.withColumn("admitted", F.lit(True)).schema

    def run(frames):
        from collections import deque

        now, log = None, deque()
        for frame in frames:
            out = []
            for k, s in zip(frame[key], frame[second], strict=True):
                if k != now:
                    now, log = k, deque()
                while log and log[0] <= s - window:
                    log.popleft()
                ok = len(log) < limit
                if ok and (not log or log[-1] != s):
                    log.append(s)
                out.append(ok)
            yield frame.assign(admitted=out)

    return requests.repartition(key).sortWithinPartitions(key, second, *order).mapInPandas(run, schema)


def message_pairs(calls: DataFrame) -> DataFrame:
    """Two messages a call (run, seq, call_id, tool, args, result): the assistant's with the call, and the tool's with the result."""
    call = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("args").alias("arguments")))
    pair = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), call.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")), F.struct(F.lit("tool").alias("role"), F.col("result").alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.col("call_id").alias("tool_call_id")))
    return calls.select("run", "seq", F.posexplode(pair).alias("part", "m")).select("run", "seq", "part", "m.*")


def action_rows(calls: DataFrame) -> DataFrame:
    """Assistant rows {type, payload} of results (run, seq, result) that hold an __action."""
    kind = F.get_json_object("result", "$.__action")
    return calls.where(kind.isNotNull()).select("run", "seq", F.lit("assistant").alias("role"), F.to_json(F.struct(kind.alias("type"), F.get_json_object("result", "$.payload").alias("payload"))).alias("content"))


def final_rows(answers: DataFrame, tokens: Column) -> DataFrame:
    """The final assistant message of each run (run, seq, answer), with its tokens; runs without an answer have none."""
    return answers.where(F.coalesce("answer", F.lit("")) != "").select("run", "seq", F.lit("assistant").alias("role"), F.col("answer").alias("content"), tokens.alias("token_count"))
