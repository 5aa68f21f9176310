"""Unions, distinct rows by key, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema, all rows."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def union_diagonal(tables: list[DataFrame]) -> DataFrame:
    """All columns of all tables; types are widened, missing values null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_relaxed(tables: list[DataFrame]) -> DataFrame:
    """Columns of the first table, each of the least type that holds the values of all: numbers and times are widened, what has nothing in common is text."""
    types = {c: reduce(_wider, [dict(t.dtypes)[c] for t in tables]) for c in tables[0].columns}
    return union_all([t.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in types.items()]) for t in tables])


_WHOLE, _TIMES = ["tinyint", "smallint", "int", "bigint"], ["date", "timestamp_ntz", "timestamp"]


def _wider(a: str, b: str) -> str:
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    for order in (_WHOLE, _TIMES):
        if a in order and b in order:
            return max(a, b, key=order.index)
    if {a, b} <= {*_WHOLE, "float", "double"}:
        return "double"
    exact = [x for x in (a, b) if x.startswith("decimal")]
    if exact and {a, b} <= {*_WHOLE, "float", "double", *exact}:
        if not {a, b} <= {*_WHOLE, *exact}:
            return "double"
        digits = [tuple(map(int, x[8:-1].split(","))) if x in exact else (20, 0) for x in (a, b)]
        scale = max(s for _, s in digits)
        return f"decimal({min(38, max(p - s for p, s in digits) + scale)},{scale})"
    return "string"


def union_distinct(tables: list[DataFrame]) -> DataFrame:
    return union_all(tables).distinct()


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def missing_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Dates between the first and the last that no row has."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias(column)).join(df.select(column).distinct(), column, "left_anti")
