"""Offline evaluation: rules over traces, roll-ups, percentiles, comparisons and stratified samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import floor_percentile
from ..functions.parse import invalid_arguments

#: Words without which a purchase is premature.
PURCHASE_WORDS = ["买", "下单", "就这个", "来一份", "购买", "我要", "买了"]


def rule(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("rule"), passed.alias("passed"), F.when(~passed, detail).alias("detail"))


def scored(tasks: DataFrame) -> DataFrame:
    """One row a rule for tasks (task_id, input, answer, has_access, calls, required, forbidden, max_steps).

    calls is an array of structs (seq, tool, args, error_code, recoverable) in order, one run's and so short. A forbidden call, a
    missing tool and an invalid argument are rows of their own; where none is, the rule has one row that passed.
    """
    tools = F.transform("calls", lambda c: c["tool"])
    bad = F.filter("calls", lambda c: F.array_contains("forbidden", c["tool"]))
    missing = F.array_except("required", tools)
    keys = F.transform(F.filter("calls", lambda c: c["tool"] != "purchase"), lambda c: F.struct(c["tool"], c["args"]))
    real = lambda c: c["recoverable"] & ~F.coalesce(c["error_code"], F.lit("")).isin("", "NOT_FOUND")
    errors = F.filter("calls", real)
    recovered = F.exists(errors, lambda e: F.exists("calls", lambda c: (c["seq"] > e["seq"]) & (c["tool"] != e["tool"])))
    bought = F.array_contains(tools, "purchase")
    wanted = F.lit(False)
    for w in PURCHASE_WORDS:
        wanted = wanted | F.col("input").contains(w)
    invalid = F.flatten(F.transform("calls", lambda c: invalid_arguments(c["args"])))
    checks = F.array_contains(tools, "get_material_detail")
    none = F.lit(None).cast("string")
    ok = lambda name: F.array(rule(name, F.lit(True), none))
    rows = F.flatten(
        F.array(
            F.when(F.size(bad) == 0, ok("forbidden_tool")).otherwise(F.transform(bad, lambda c: rule("forbidden_tool", F.lit(False), c["tool"]))),
            F.when(F.size(missing) == 0, ok("required_tool")).otherwise(F.transform(missing, lambda t: rule("required_tool", F.lit(False), t))),
            F.array(
                rule("max_steps", ~((F.col("max_steps") > 0) & (F.size("calls") > F.col("max_steps"))), F.size("calls").cast("string")),
                rule("duplicate_call", F.size(F.array_distinct(keys)) == F.size(keys), F.lit("repeated")),
                rule("purchase_before_check", ~bought | checks, F.lit("no check")),
                rule("full_content_leak", F.col("has_access") | (F.length(F.coalesce("answer", F.lit(""))) <= 500), F.lit("long answer")),
                rule("error_recovery", (F.size(errors) == 0) | recovered, F.lit("not recovered")),
                rule("premature_purchase", ~bought | wanted, F.lit("not asked for")),
            ),
            F.when(F.size(invalid) == 0, ok("invalid_args")).otherwise(F.transform(invalid, lambda x: rule("invalid_args", F.lit(False), x))),
        )
    )
    return tasks.select("task_id", F.explode(rows).alias("_r")).select("task_id", "_r.*")


def selected(tasks: DataFrame, category: str = "", task_id: str = "") -> DataFrame:
    """Tasks of a category, or one of them; what is empty selects nothing away."""
    for c, v in (("category", category), ("task_id", task_id)):
        tasks = tasks.where(F.col(c) == v) if v else tasks
    return tasks


def paired(calls: DataFrame, results: DataFrame, run: str, seq: str, key: list[str]) -> DataFrame:
    """Each call (run, seq, key) with the result that answers it, or nulls: results answer equal calls of a run in order.

    A result that comes before its call answers nothing. Columns of results but run and key get the prefix result_.
    """
    w = Window.partitionBy(run, *key).orderBy(seq)
    rest = [c for c in results.columns if c not in (run, *key)]
    r = results.withColumn("_n", F.row_number().over(w)).select(run, *key, "_n", *[F.col(c).alias(f"result_{c}") for c in rest])
    met = calls.withColumn("_n", F.row_number().over(w)).join(r, [run, *key, "_n"], "left").drop("_n")
    late = F.col(f"result_{seq}") > F.col(seq)
    return met.select(*calls.columns, *[F.when(late, F.col(f"result_{c}")).alias(f"result_{c}") for c in rest])


def tool_accuracy(tasks: DataFrame) -> DataFrame:
    """tool, called, in_forbidden, missing_required and accuracy over tasks (calls, required, forbidden): the share of right calls
    among all calls and those that were required but missing."""
    tools = F.transform("calls", lambda c: c["tool"])
    used = F.transform("calls", lambda c: F.struct(c["tool"].alias("tool"), F.lit(1).alias("called"), F.array_contains("forbidden", c["tool"]).cast("int").alias("bad"), F.lit(0).alias("missing")))
    lacking = F.transform(F.array_except("required", tools), lambda t: F.struct(t.alias("tool"), F.lit(0).alias("called"), F.lit(0).alias("bad"), F.lit(1).alias("missing")))
    d = tasks.select(F.explode(F.concat(used, lacking)).alias("x")).select("x.*").groupBy("tool").agg(F.sum("called").alias("called"), F.sum("bad").alias("in_forbidden"), F.sum("missing").alias("missing_required"))
    return d.withColumn("accuracy", F.round((F.col("called") - F.col("in_forbidden")) / (F.col("called") + F.col("missing_required")), 6))


def weighted_score(scores: list[Column], weights: list[Column]) -> Column:
    """The mean of a task's scores under its weights; 0 without any weight."""
    total = sum(weights[1:], weights[0])
    return F.when(total == 0, F.lit(0.0)).otherwise(sum((s * w for s, w in zip(scores[1:], weights[1:], strict=True)), scores[0] * weights[0]) / total)


def verdicts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("task_id").agg(F.bool_and("passed").alias("passed"))


def rolled_up(results: DataFrame, by: str, passed: str, scores: list[str]) -> DataFrame:
    """Totals, pass rate in percent, and score means over all rows of a category (rows without scores count as 0)."""
    n = F.count("*")
    means = [F.round(F.sum(F.coalesce(F.col(s), F.lit(0))) / n, 6).alias(f"avg_{s}") for s in scores]
    return results.groupBy(by).agg(n.alias("total"), F.sum(F.col(passed).cast("long")).alias("passed"), F.round(F.sum(F.col(passed).cast("long")) * 100.0 / n, 6).alias("pass_rate"), *means)


def _beside(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by columns of one name, where nulls are equal."""
    names = {c: f"_on{i}" for i, c in enumerate(on)}
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(other.withColumnsRenamed(names), same).drop(*names.values())


#: Ranges that the values of a group are counted in before one of them is sorted.
RANGES = 100


def percentiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact floor-index percentiles of each group, in two passes.

    The first counts each group's values in ranges between approximate percentiles, which names for every percentile the one
    range that holds its rank; the second takes only the values of these ranges, counts equal ones and
    sums the counts in order. A window sees a hundredth of a group's different values, or one value.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, value)
    cuts = d.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"), F.count("*").alias("_n"))
    d = _beside(d, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    upto = Window.partitionBy(*by).orderBy("_range")
    hist = d.groupBy(*by, "_n", "_range").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(upto))
    wanted = hist.select("*", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("_p")).withColumn("_place", F.least(F.floor(F.col("_n") * F.col("_p")), F.col("_n") - 1))
    wanted = wanted.where((F.col("_place") < F.col("_to")) & (F.col("_place") >= F.col("_to") - F.col("_c"))).select(*by, "_range", "_p", (F.col("_place") - F.col("_to") + F.col("_c")).alias("_skip"))
    near = _beside(d, wanted, [*by, "_range"]).groupBy(*by, "_p", "_skip", value).agg(F.count("*").alias("_c"))
    near = near.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy(value))).where(F.col("_to") > F.col("_skip"))
    return near.groupBy(*by).agg(*[F.min(F.when(F.col("_p") == float(p), F.col(value))).alias(f"p{int(p * 100)}") for p in at])


def percentiles_of_few(values: Column, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """The same from an ascending array, for small groups."""
    return [floor_percentile(values, p).alias(f"p{int(p * 100)}") for p in at]


def deltas(summary: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Differences of each column to the configuration before; summary has a row a configuration."""
    w = Window.orderBy(order)
    return summary.select("*", *[F.round(F.col(c) - F.lag(c).over(w), 6).alias(f"d_{c}") for c in columns])


def quotas(strata: DataFrame, count: str, n: int) -> DataFrame:
    """Adds quota: one, and the truncated share of the rest."""
    total = strata.agg(F.sum(count).alias("_total"), F.count("*").alias("_strata"))
    d = strata.crossJoin(F.broadcast(total))
    return d.withColumn("quota", F.lit(1) + F.floor((F.lit(n) - F.col("_strata")) * F.col(count) / F.col("_total"))).drop("_total", "_strata")


def sampled(rows: DataFrame, by: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Each stratum's quota of its rows, by a hash of the id.

    No quota exceeds n, so each task first keeps at most n rows of a stratum (the limit is pushed into the sort), and only these meet.
    """
    q = quotas(rows.groupBy(by).agg(F.count("*").alias("_count")), "_count", n).select(by, "quota")
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(id_col))), id_col)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).join(q, by).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")
