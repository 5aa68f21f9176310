"""Descriptive aggregates: the data behind charts and summary tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(long: DataFrame) -> DataFrame:
    return long.agg(F.count("*").alias("n_rows"), F.countDistinct("account_identifier").alias("n_accounts"), F.countDistinct("zip_code").alias("n_zips"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


def statistics(df: DataFrame, keys: list[str], value: str = "kwh") -> DataFrame:
    """Customers, rows, mean, total, sample deviation, median, least and greatest value by key."""
    return df.groupBy(*keys).agg(
        F.countDistinct("account_identifier").alias("customers"), F.count("*").alias("n_rows"), F.avg(value).alias("mean_value"), F.sum(value).alias("total_value"),
        F.stddev_samp(value).alias("std_value"), F.median(value).alias("median_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
    )


def levels(df: DataFrame, value: str = "kwh") -> DataFrame:
    """Totals by month, zip code, hour and day kind, and overall, in one pass over the data (grouping sets)."""
    sets = [["month"], ["zip_code"], ["hour"], ["is_weekend"], []]
    cols = ["month", "zip_code", "hour", "is_weekend"]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return grouped.agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean_value"), F.sum(value).alias("total_value"))


def monthly_rollup(df: DataFrame, value: str = "kwh") -> DataFrame:
    """By month with a TOTAL row; the total's distinct customers are counted over all months."""
    out = df.rollup("month").agg(F.countDistinct("account_identifier").alias("customers"), F.count("*").alias("n_rows"), F.sum(value).alias("total_value"))
    return out.withColumn("month", F.coalesce("month", F.lit("TOTAL")))


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Exact percentiles with linear interpolation, named p1, p25, ..."""
    p = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("p"))
    return p.select(*keys, *[F.col("p")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(at)])


def quantiles_by_ranges(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], ranges: int = 1024) -> DataFrame:
    """As quantiles(), without any task that holds a group: values are counted, counts are summed over ranges of values, and ranks are looked up in the ranges."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ends = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_all"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    own = counted.alias("a").join(ends.alias("b"), on).select("a.*", "_low", "_high", "_all")
    own = own.withColumn("_r", F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (ranges - 1))).otherwise(F.lit(0)))
    by = own.groupBy(*keys, "_r").agg(F.sum("_n").alias("_t"))
    by = by.withColumn("_before", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_r")) - F.col("_t")).drop("_t")  # at most `ranges` rows a group
    on = F.col("a._r") == F.col("b._r")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    own = own.alias("a").join(by.alias("b"), on).select("a.*", "_before")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_v"))
    own = own.withColumn("_to", upto).withColumn("_from", upto - F.col("_n"))
    found = []
    for q in at:  # the value of rank k has _from <= k < _to, ranks from 0
        place = (F.col("_all") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        hit = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v")))
        found.append((hit(low) + (hit(high) - hit(low)) * F.max(place - low)).alias(f"p{round(q * 100)}"))
    return own.groupBy(*keys).agg(*found)


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """As quantiles(), from a mergeable sketch of bounded size."""
    p = df.groupBy(*keys).agg(F.percentile_approx(value, list(at), accuracy).alias("p"))
    return p.select(*keys, *[F.col("p")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(at)])


def heatmap(df: DataFrame, row: Column, column: Column, values: list, value: str = "kwh", how: str = "sum", prefix: str = "c") -> DataFrame:
    """A row for each `row`, a column for each of the values; empty cells are 0."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    wide = df.select(row.alias("row"), column.alias("col"), value).groupBy("row").pivot("col", values).agg(agg(value))
    return wide.select("row", *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{prefix}{v}") for v in values])


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def peak_and_base(df: DataFrame, keys: list[str], hour: str = "hour", value: str = "kwh") -> DataFrame:
    """(keys, peak_hour, base_hour): hours of greatest and least mean; ties go to the earlier hour."""
    mean = df.groupBy(*keys, hour).agg(F.avg(value).alias("m"))
    return mean.groupBy(*keys).agg(F.max_by(hour, F.struct("m", -F.col(hour))).alias("peak_hour"), F.min_by(hour, F.struct("m", hour)).alias("base_hour"))


def percent_of_total(df: DataFrame, key: str) -> DataFrame:
    by = df.groupBy(key).agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, std, low, p25, p50, p75, high): one pass, and two or three more for the exact percentiles."""
    at = (0.25, 0.5, 0.75)
    stats = [F.struct(F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(f"s{i}") for i, c in enumerate(columns)]
    one, found = df.agg(*stats).first(), quantiles_by_search(df, columns, at)
    rows = [(c, own.n, own.mean, own.std, own.low, *found[c], own.high) for c, own in zip(columns, one)]
    return df.sparkSession.createDataFrame(rows, f"column_name string, n long, mean double, std double, low double, {', '.join(f'p{round(q * 100)} double' for q in at)}, high double")


def quantiles_by_search(df: DataFrame, columns: list[str], at: tuple[float, ...], bins: int = 4096) -> dict[str, list[float | None]]:
    """Exact percentiles of whole columns with linear interpolation, null for columns without a value; infinities and NaN come last as in sorting.

    Each pass counts the values of the ranges that hold a wanted rank in bins and goes on with those bins, till a bin holds one
    value. A task never holds more than a few times `bins` counts, however many different values there are.
    """
    cast = {c: F.col(f"`{c}`").cast("double") for c in columns}
    n = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(cast.values())]).first()
    total = {c: n[i] for i, c in enumerate(columns)}
    ranks = {c: {k for q in at for k in (math.floor((total[c] - 1) * q), math.ceil((total[c] - 1) * q))} if total[c] else set() for c in columns}
    value: dict[str, dict[int, float]] = {c: {} for c in columns}
    ranges: dict[str, list[tuple[float, float, int]]] = {c: [(-math.inf, math.inf, 0)] for c in columns if total[c]}  # (low, high, values below); the first stand for all values
    first = True
    while any(ranges.values()):
        cells = []
        for c in ranges:
            v = cast[c]
            for k, (low, high, _) in enumerate(ranges[c]):
                if first:  # what isn't finite has bins of its own, all else one
                    inside, cell = v.isNotNull(), F.when(F.isnan(v), 2).when(v == math.inf, 1).when(v == -math.inf, -1).otherwise(0)
                else:  # a quarter of all numbers, so that no difference is infinite
                    inside, cell = v.between(low, high), F.floor((v / 4 - low / 4) / (high / 4 - low / 4) * bins).cast("int")
                cells.append(F.when(inside, F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), cell.cast("int").alias("cell"), v.alias("v"))))
        by = df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()))).groupBy("c", "k", "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # `bins` for each range
        new: dict[str, list[tuple[float, float, int]]] = {c: [] for c in ranges}
        below: dict[tuple[str, int], int] = {}
        for r in sorted(by, key=lambda r: (r.c, r.k, r.cell)):
            start = below.get((r.c, r.k), ranges[r.c][r.k][2])
            below[r.c, r.k] = start + r.n
            mine = [k for k in ranks[r.c] if start <= k < start + r.n]
            if mine and (r.low == r.high or r.low != r.low):
                value[r.c] |= dict.fromkeys(mine, r.low)
            elif mine:
                new[r.c].append((r.low, r.high, start))
        ranges, first = new, False
    out: dict[str, list[float | None]] = {}
    for c in columns:
        places = [(total[c] - 1) * q for q in at] if total[c] else []
        pairs = [(value[c][math.floor(p)], value[c][math.ceil(p)], p - math.floor(p)) for p in places]
        out[c] = [a if a == b else a + (b - a) * f for a, b, f in pairs] or [None] * len(at)
    return out


def correlations(df: DataFrame, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """(a, b, corr) of every pair (every one of columns with every one of others, where given), in one pass."""
    pairs = [(a, b) for a in columns for b in others] if others else [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("s")).select(F.inline("s"))


def standardised(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    """Columns less their mean, over their sample deviation; near-constant ones stay as they are."""
    one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = df.crossJoin(one)  # one row
    scaled = {c: F.when(F.col(f"_s_{c}") > least, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def z_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    """As standardised(), but of columns without any spread nothing is left: null where there is a single value, NaN where all are the same."""
    one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    off = {c: F.col(c) - F.col(f"_m_{c}") for c in columns}
    scaled = {c: F.when(F.col(f"_s_{c}") == 0, off[c] * float("inf")).otherwise(off[c] / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in columns}
    return df.crossJoin(one).withColumns(scaled).select(*df.columns)  # one row
