"""Daily load profiles as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions import numbers


def daily_profiles(long: DataFrame) -> DataFrame:
    """(account_identifier, zip_code, date, profile, is_weekend, weekday): the day's kwh in order of time."""
    pairs = F.array_sort(F.collect_list(F.struct("datetime", "kwh")))  # a day's readings, never more than a few dozen
    out = long.groupBy("account_identifier", "zip_code", "date").agg(pairs.alias("p"), F.min("is_weekend").alias("is_weekend"), F.min("weekday").alias("weekday"))
    return out.select("account_identifier", "zip_code", "date", F.transform("p", lambda x: x["kwh"]).alias("profile"), "is_weekend", "weekday")


def complete(profiles: DataFrame, n: int = 48) -> DataFrame:
    return profiles.filter(F.size("profile") == n)


def normalised(profiles: DataFrame, how: str = "minmax") -> DataFrame:
    """Profiles row by row: minmax, zscore or none."""
    build: dict[str, Column] = {"minmax": numbers.min_max(F.col("profile")), "zscore": numbers.z_scores(F.col("profile")), "none": F.col("profile")}
    return profiles.withColumn("profile", build[how])


def prepare(long: DataFrame, accounts: DataFrame, dates: DataFrame, n: int = 48) -> DataFrame:
    """Complete profiles of the sampled accounts on the sampled dates."""
    kept = long.join(accounts.select("account_identifier"), "account_identifier", "left_semi").join(dates.select("date"), "date", "left_semi")
    return complete(daily_profiles(kept), n)
