"""Manifests and seeded samples without replacement.

The order of a sample is that of a hash of the key with the seed, so it is the same for the same rows
however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions import times


def lot(key: Column, seed: int) -> Column:
    """Drawing order of a whole-number key."""
    return F.pmod(key.cast("long") % 1_000_003 * 7919 + seed * 104_729, F.lit(1_000_003)).cast("long")


def hashed(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def account_manifest(long: DataFrame) -> DataFrame:
    """Each account with its least zip code."""
    return long.groupBy("account_identifier").agg(F.min("zip_code").alias("zip_code"))


def date_manifest(long: DataFrame) -> DataFrame:
    """Each date, its ISO weekday, and whether it is Saturday or Sunday."""
    day = F.col("date")
    return long.select("date").distinct().select("date", times.iso_weekday(day).alias("weekday"), times.is_weekend(day).alias("is_weekend"))


def draw(df: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """Exactly n rows (all if there are fewer), those first in order."""
    return df.orderBy(order, *ties).limit(n)


def sample_dates(dates: DataFrame, n: int, weekday_share: float = 0.7, order: Column | None = None, seed: int = 42) -> DataFrame:
    """n dates, the given share weekdays; where one kind is short, it gives what it has and no other fills in.

    Where one kind is missing altogether, all n are of the other.
    """
    order = hashed(F.col("date"), seed) if order is None else order
    everything = Window.partitionBy()  # a row for each day
    both = F.bool_or("is_weekend").over(everything) & F.bool_or(~F.col("is_weekend")).over(everything)
    quota = F.when(~both, n).when(F.col("is_weekend"), n - int(n * weekday_share)).otherwise(int(n * weekday_share))
    ranked = dates.withColumn("q", quota).withColumn("r", F.row_number().over(Window.partitionBy("is_weekend").orderBy(order, "date")))
    return ranked.filter("r <= q").drop("r", "q")


def sample_by_month(df: DataFrame, most: int, order: Column) -> DataFrame:
    """At most `most` accounts of each sample_month, each once, with the first file that has it."""
    first = df.groupBy("sample_month", "account_identifier").agg(F.min("source_key").alias("source_key"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("sample_month").orderBy(order, "account_identifier"))).filter(F.col("r") <= most).drop("r")
