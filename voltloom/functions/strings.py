"""Column builders over strings: padding, codes, names of intervals, months in file names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(c: Column, width: int) -> Column:
    """Zeros on the left up to width; longer strings stay whole (lpad alone would cut them)."""
    c = c.cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def digits_zfill(c: Column, width: int) -> Column:
    """Digits only, zero-filled; null where there is none."""
    own = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(F.length(own) > 0, zfill(own, width))


def zip4(c: Column) -> Column:
    """#####-#### from nine digits; trimmed otherwise; blank becomes null."""
    own = F.trim(c.cast("string"))
    return F.when(own == "", F.lit(None)).when(own.rlike("^[0-9]{9}$"), F.regexp_replace(own, "^([0-9]{5})([0-9]{4})$", "$1-$2")).otherwise(own)


def geoid(state: Column, county: Column, tract: Column, group: Column) -> Column:
    """Twelve-digit block group id."""
    return F.concat(zfill(state, 2), zfill(county, 3), zfill(tract, 6), zfill(group, 1))


def block_group(c: Column) -> Column:
    """The first 12 characters; null where there are fewer."""
    own = F.substring(F.trim(c.cast("string")), 1, 12)
    return F.when(F.length(own) == 12, own)


def year_month(c: Column, first: int = 2000, last: int = 2099) -> Column:
    """First six digits in a row in the text (a sliding scan of digit runs) that are a valid YYYYMM; null without any."""
    runs = F.regexp_extract_all(c, F.lit(r"(?=(\d{6}))"), F.lit(1))
    year, month = (lambda x: F.substring(x, 1, 4).cast("int")), (lambda x: F.substring(x, 5, 2).cast("int"))
    return F.get(F.filter(runs, lambda x: year(x).between(first, last) & month(x).between(1, 12)), F.lit(0))


def interval_clock(c: Column) -> tuple[Column, Column]:
    """(hour, minute) as written in INTERVAL_HRhhmm_ENERGY_QTY; hour may be 24 or 25."""
    own = F.regexp_extract(c, r"HR(\d{4})", 1)
    return F.substring(own, 1, 2).cast("int"), F.substring(own, 3, 2).cast("int")


def detect(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first column whose name, in lower-case letters and digits only, is among the candidates."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    wanted = {plain(c) for c in candidates}
    return next((c for c in columns if plain(c) in wanted), None)


def chosen(columns: list[str], wanted: str) -> list[str]:
    """A comma list of columns: in its order, without repeats; unknown names raise."""
    out = list(dict.fromkeys(x.strip() for x in wanted.split(",") if x.strip()))
    if missing := [x for x in out if x not in columns]:
        raise ValueError(f"no such columns: {missing}")
    return out
