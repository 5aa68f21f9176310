"""Column builders over numbers and arrays of numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that a survey gives in place of an estimate.
SENTINELS = (-666666666, -999999999, -888888888, -555555555, -222222222)


def safe_percent(part: Column, whole: Column) -> Column:
    """100 part / whole; null unless whole > 0."""
    return F.when(whole > 0, part / whole * 100)


def sentinel_null(c: Column, codes: tuple[int, ...] = SENTINELS) -> Column:
    return F.when(~c.isin(*codes), c)


def log_count(c: Column) -> Column:
    """log(c + 1); null for negative numbers."""
    return F.when(c >= 0, F.log1p(c))


def codes(expression: str) -> list[str]:
    """Column names in a sum, each once, in order."""
    return list(dict.fromkeys(re.findall(r"[A-Za-z_]\w*", expression)))


def total(expression: str) -> Column:
    """'A + B - C' as doubles with sentinels as nulls; null if a term is."""
    tokens = re.findall(r"[A-Za-z_]\w*|[+-]", expression)
    if re.sub(r"[\w+\-\s]", "", expression) or not tokens:
        raise ValueError(f"not a sum of columns: {expression!r}")
    out, sign = None, "+"
    for t in tokens:
        if t in "+-":
            sign = t
        else:
            c = sentinel_null(F.col(t).try_cast("double"))
            out = (c if sign == "+" else -c) if out is None else out + c if sign == "+" else out - c
    return out


def finite(c: Column) -> Column:
    """0 for null, NaN and infinite values."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def min_max(a: Column) -> Column:
    """Values of an array between 0 and 1; a constant array becomes zeros, non-finite values 0."""
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(high == low, F.lit(0.0)).otherwise(finite((x - low) / (high - low))))


def z_scores(a: Column) -> Column:
    """Values of an array less their mean, over their population deviation; a constant array becomes zeros."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.transform(a, lambda x: F.when(var <= 1e-20, F.lit(0.0)).otherwise(finite((x - mean) / F.sqrt(var))))
