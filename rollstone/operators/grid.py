"""A generic grid over any table: filters by column, search, sorting, pages and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import page

#: Operators of a condition (column, operator, value).
OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c.isNull() | (c != v),  # null rows stay, as with not-in
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "nin": lambda c, v: c.isNull() | ~c.isin(v),
    "null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "icontains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    "startswith": lambda c, v: F.startswith(c, F.lit(v)),
    "istartswith": lambda c, v: F.startswith(F.lower(c), F.lit(v.lower())),
    "regex": lambda c, v: c.rlike(v),
    "all": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
    "any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
    "longer": lambda c, v: F.size(c) > v,
}


def condition(*tests: tuple, any_of: bool = False) -> Column:
    """All (or any) of the tests (column, operator, value); a column may be a path into structs. Without a test every row fits."""
    made = [OPERATORS[op](F.col(c), v) for c, op, v in tests]
    if not made:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), made)


def grid(df: DataFrame, tests: list[tuple], columns: list[str] | None = None, search: tuple[list[str], str] | None = None, sort: list[tuple[str, bool]] | None = None, key: str | None = None, number: int = 1, size: int | None = None) -> DataFrame:
    """Rows that pass the tests and contain the searched word in one of some columns; sorted (column, descending) with key as the last resort, and one page if size is given."""
    rows = df.where(condition(*tests))
    if search:
        rows = rows.where(condition(*((c, "icontains", search[1]) for c in search[0]), any_of=True))
    order = [F.desc(c) if down else F.asc(c) for c, down in sort or []] + ([F.col(key)] if key else [])
    if size is not None:
        rows = page(rows, order, number, size).drop("position")
    elif order:
        rows = rows.orderBy(*order)
    return rows.select(*columns) if columns else rows


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with chunk: rows in a total order, so many to a chunk."""
    from .numbering import numbered

    return numbered(df, order, "_at").withColumn("chunk", F.floor(F.col("_at") / size)).drop("_at")
