"""Catalogue queries: optional filters, switchable sorts, pages, lookups, access joins, guards and merges of versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(number: int = 1, size: int = 10, most: int = 100) -> tuple[int, int]:
    """A valid page number and size."""
    return max(1, number), min(most, size if size > 0 else 10)


def clamp(size: int, most: int, usual: int) -> int:
    return size if 1 <= size <= most else usual


def contains_any(columns: list[str], keyword: str) -> Column:
    """Case-insensitive containment in any of the columns, blanks at the keyword's ends ignored."""
    pattern = "%" + keyword.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def filtered(df: DataFrame, equal: dict | None = None, low: dict | None = None, high: dict | None = None, keyword: str = "", columns: list[str] | None = None) -> DataFrame:
    """Only the conditions that are given are applied."""
    terms = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    terms += [F.col(c) >= v for c, v in (low or {}).items() if v is not None] + [F.col(c) <= v for c, v in (high or {}).items() if v is not None]
    if keyword.strip():
        terms.append(contains_any(columns or [], keyword))
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def paged(df: DataFrame, order: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    number, size = page(number, size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, page_df: DataFrame) -> DataFrame:
    """The page with the number of all rows that match beside it."""
    return page_df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def looked_up(df: DataFrame, other: DataFrame, on: Column | str) -> DataFrame:
    """Each row with the row it names, or nulls."""
    return df.join(other, on, "left")


def nested(df: DataFrame, by: str, order: str, columns: list[str], name: str) -> DataFrame:
    """One row a group, its rows as a sorted array of structs."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))


def having(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def newest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of df with the non-null values of changes (key, some columns) written over."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


#: When a field of an update counts as given: documents, materials and users, courses.
GIVEN = {"not_null": lambda c: c.isNotNull(), "non_zero": lambda c: c.isNotNull() & ~c.cast("string").isin("", "0", "0.0"), "not_negative": lambda c: c >= 0}


def changed(df: DataFrame, changes: DataFrame, key: str, given: dict[str, str]) -> DataFrame:
    """Rows of df with the fields of changes written over that are given, by the rule that given names for each column.

    With not_null an empty text is a value; a row without changes stays; there is one change a key.
    """
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = df.join(new, key, "left")
    return joined.select(*[F.when(GIVEN[given[c]](F.col(f"_new_{c}")), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns])


def closed(df: DataFrame, which: Column, status: str = "status", to: str = "closed") -> DataFrame:
    """Soft delete: the rows stay, their status is another."""
    return df.withColumn(status, F.when(which, to).otherwise(F.col(status)))


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def upserted(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key."""
    return df.join(rows.select(*key), key, "left_anti").unionByName(rows)


def found_or_created(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are added."""
    return df.unionByName(rows.join(df.select(*key), key, "left_anti"), allowMissingColumns=True)


def remembered(writes: DataFrame, by: list[str], confidence: str, seq: str, allowed: list[str] | None = None, key: str = "mem_key") -> DataFrame:
    """What remains of writes in order: a lower confidence never replaces a higher one, an equal one does."""
    w = writes if allowed is None else writes.where(F.col(key).isin(allowed))
    rest = [c for c in writes.columns if c not in by]
    return w.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(confidence, seq)).alias("_r")).select(*by, "_r.*")


def guarded_delete(parents: DataFrame, asked: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> DataFrame:
    """The asked keys with the guard that refuses each (its number from 1), or 0 for those that may go."""
    out = asked.select(key).join(parents.select(key), key, "left_semi").withColumn("refused", F.lit(0))
    for n, (child, fk) in enumerate(children, 1):
        used = child.select(F.col(fk).alias(key)).distinct().withColumn("_used", F.lit(1))
        out = out.join(used, key, "left").withColumn("refused", F.when((F.col("refused") == 0) & F.col("_used").isNotNull(), n).otherwise(F.col("refused"))).drop("_used")
    return out
