"""Data-quality reports. Each is a table, not a print."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.times import days_in_month, hour_start, year_month


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_nulls, pct_null) in one pass; pct_null is null for an empty table."""
    columns = columns or df.columns
    out = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return out.unpivot(["_n"], columns, "column_name", "n_nulls").select("column_name", "n_nulls", F.expr("try_divide(n_nulls, _n) * 100").alias("pct_null"))


def incomplete(df: DataFrame, limit: float = 50.0) -> DataFrame:
    """Columns with over limit percent nulls."""
    return null_profile(df).filter(F.col("pct_null") > limit)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_kinds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(kind, n_keys, n_rows) of repeated keys whose values are the same or differ; a null is a value of its own."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("d")).filter("n > 1")
    return by.groupBy(F.when(F.col("d") > 1, "different_value").otherwise("same_value").alias("kind")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, surplus rows. Grouping, rather than a distinct count, combines on the map side."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def interval_day_qc(long: DataFrame) -> DataFrame:
    """(account_identifier, date, n_intervals, day_type, is_odd_count, is_dst_transition): 48 readings are a normal day, 46 and 50 those clocks change on."""
    by = long.groupBy("account_identifier", "date").agg(F.count("*").alias("n_intervals"))
    n = F.col("n_intervals")
    return by.withColumns({"day_type": F.when(n == 48, "normal").when(n == 46, "spring_forward").when(n == 50, "fall_back").otherwise("odd"), "is_odd_count": ~n.isin(46, 48, 50), "is_dst_transition": n.isin(46, 50)})


def day_sizes(long: DataFrame) -> DataFrame:
    """(n_intervals, n_days): how many account-days have so many readings."""
    return long.groupBy("account_identifier", "date").agg(F.count("*").alias("n_intervals")).groupBy("n_intervals").agg(F.count("*").alias("n_days"))


def hour_gaps(long: DataFrame) -> DataFrame:
    """(account_identifier, n_hours, n_gaps, longest_gap_hours) over the distinct hours of each account."""
    hours = long.select("account_identifier", hour_start(F.col("datetime")).alias("h")).distinct()
    step = F.timestamp_diff("HOUR", F.lag("h").over(Window.partitionBy("account_identifier").orderBy("h")), F.col("h"))
    return hours.withColumn("step", step).groupBy("account_identifier").agg(F.count("*").alias("n_hours"), F.count_if(F.col("step") > 1).alias("n_gaps"), F.max("step").alias("longest_gap_hours"))


def checkpoint(df: DataFrame, required: list[str], expected: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(check_name, subject, value, status): missing columns, nulls over 50 % (issue) and 10 % (warning), repeated keys."""
    spark = df.sparkSession
    gone = [("column", c, 0.0, "FAIL") for c in required if c not in df.columns] + [("column", c, 0.0, "WARNING") for c in expected if c not in df.columns]
    out = null_profile(df).select(F.lit("pct_null").alias("check_name"), F.col("column_name").alias("subject"), F.col("pct_null").alias("value"), F.when(F.col("pct_null") > 50, "ISSUE").when(F.col("pct_null") > 10, "WARNING").otherwise("OK").alias("status"))
    if gone:
        out = out.unionByName(spark.createDataFrame(gone, "check_name string, subject string, value double, status string"))
    if keys and set(keys) <= set(df.columns):
        n = F.col("n_duplicates")
        out = out.unionByName(duplicate_rows(df, list(keys)).select(F.lit("duplicates").alias("check_name"), F.lit(",".join(keys)).alias("subject"), n.cast("double").alias("value"), F.when(n > 0, "ISSUE").otherwise("OK").alias("status")))
    return out


def compare(before: DataFrame, after: DataFrame, limit: float = 10.0) -> DataFrame:
    """One row: rows before and after, change in percent, WARNING where it exceeds the limit."""
    both = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after")))  # one row each
    change = F.expr("try_divide(rows_after - rows_before, rows_before) * 100")
    return both.withColumn("pct_change", change).withColumn("status", F.when(F.abs("pct_change") > limit, "WARNING").otherwise("OK"))


def interval_checks(long: DataFrame) -> DataFrame:
    """One row on kwh, time span and days: negative and very large readings, days spanned, complete account-days."""
    own = long.groupBy("account_identifier", "date").agg(F.count("*").alias("n"), F.count_if(F.col("kwh") < 0).alias("neg"), F.count_if(F.col("kwh") > 50).alias("big"), F.min("kwh").alias("low"), F.max("kwh").alias("high"))
    out = own.agg(F.sum("neg").alias("n_negative"), F.sum("big").alias("n_large"), F.min("low").alias("min_kwh"), F.max("high").alias("max_kwh"), (F.date_diff(F.max("date"), F.min("date")) + 1).alias("span_days"), F.count("*").alias("n_account_days"), F.count_if(F.col("n") == 48).alias("n_complete_days"))
    return out.withColumn("status", F.when((F.col("n_negative") > 0) | (F.col("n_complete_days") == 0), "ISSUE").when((F.col("n_large") > 0) | (F.col("span_days") > 400), "WARNING").otherwise("OK"))


def enrichment_checks(df: DataFrame, key: str, nullable: list[str]) -> DataFrame:
    """(check_name, value, status): matched share (below 90 % an error, 95 % a warning), nulls over 5 %, and ranges of hour, weekday and kwh."""
    matched = F.avg(F.col(key).isNotNull().cast("double")) * 100
    own = {"match_rate": matched, **{f"null_{c}": F.avg(F.col(c).isNull().cast("double")) * 100 for c in nullable}}
    for c, low, high in (("hour", 0, 23), ("weekday", 1, 7), ("kwh", 0, 100)):
        if c in df.columns:
            own[f"outside_{c}"] = F.count_if(~F.col(c).between(low, high)).cast("double")
    out = df.agg(*[v.alias(k) for k, v in own.items()]).unpivot([], list(own), "check_name", "value")
    v, n = F.col("value"), F.col("check_name")
    return out.withColumn("status", F.when(n == "match_rate", F.when(v < 90, "ERROR").when(v < 95, "WARNING").otherwise("OK")).when(n.startswith("null_"), F.when(v > 5, "ERROR").otherwise("OK")).otherwise(F.when(v > 0, "ERROR").otherwise("OK")))


def complete_months(long: DataFrame, days: int = 48, least: float = 0.9) -> DataFrame:
    """(sample_month, account_identifier, ok_days, days_in_month, ratio) of accounts with enough complete days; days with at least `days` readings are complete."""
    by = long.groupBy("account_identifier", "date").agg(F.count("*").alias("n")).filter(F.col("n") >= days)
    own = by.groupBy(year_month(F.col("date")).alias("sample_month"), "account_identifier").agg(F.count("*").alias("ok_days"), F.max(days_in_month(F.col("date"))).alias("days_in_month"))
    return own.withColumn("ratio", F.col("ok_days") / F.col("days_in_month")).filter(F.col("ratio") >= least)


def keep_complete_months(long: DataFrame, days: int = 48, least: float = 0.9) -> DataFrame:
    """The readings of such accounts and months. One exchange and one sort by account and month; none if long is partitioned by account already."""
    own = long.withColumn("sample_month", year_month(F.col("date"))).filter("sample_month is not null and account_identifier is not null")
    w = Window.partitionBy("sample_month", "account_identifier")
    day = w.orderBy("date")
    own = own.withColumns({"_n": F.count(F.lit(1)).over(day.rangeBetween(Window.currentRow, Window.currentRow)), "_first": F.row_number().over(day) == F.rank().over(day)})
    own = own.withColumn("_ok", F.count_if(F.col("_first") & (F.col("_n") >= days)).over(w))
    own = own.filter((F.col("_ok") > 0) & (F.col("_ok") / days_in_month(F.col("date")) >= least))
    return own.select("sample_month", "account_identifier", *[F.col(f"`{c}`") for c in long.columns if c not in ("sample_month", "account_identifier")])


def under_sampled(by_month: DataFrame, month: str = "sample_month", n: str = "customers") -> DataFrame:
    """Each month's customers against the mean of the other months: below 0.3 critical, below 0.5 low."""
    w = Window.partitionBy()  # a row for each month
    others = (F.sum(n).over(w) - F.col(n)) / (F.count(F.lit(1)).over(w) - 1)
    out = by_month.withColumn("others", F.when(F.count(F.lit(1)).over(w) > 1, others)).withColumn("ratio", F.expr(f"try_divide({n}, others)"))
    return out.withColumn("grade", F.when(F.col("ratio") < 0.3, "critical").when(F.col("ratio") < 0.5, "low").otherwise("ok"))


def topped_up(by_month: DataFrame, month: str = "sample_month", n: str = "customers") -> DataFrame:
    """under_sampled() after more customers were added: from 0.8 of the other months' mean comparable, from 0.5 usable, below low."""
    out = under_sampled(by_month, month, n)
    return out.withColumn("grade", F.when(F.col("ratio") >= 0.8, "comparable").when(F.col("ratio") >= 0.5, "usable").otherwise("low"))


def hour_balance(long: DataFrame, most: float = 5.0) -> DataFrame:
    """(hour, n, pct_off, balanced): readings of each hour against a 24th of all, in percent."""
    by = long.groupBy("hour").agg(F.count("*").alias("n"))
    even = F.sum("n").over(Window.partitionBy()) / 24  # of 24 rows
    return by.withColumn("pct_off", (F.col("n") - even) / even * 100).withColumn("balanced", F.abs("pct_off") < most)


def production_profile(long: DataFrame, days: int = 31, slots: int = 48) -> DataFrame:
    """One row: accounts, zip codes, days, rows an account against days * slots (in percent), nulls, repeated readings, range of kwh and a status."""
    by = long.groupBy("account_identifier", "datetime").agg(F.count("*").alias("n"), F.count_if(F.expr("kwh is null or zip_code is null or account_identifier is null or datetime is null")).alias("holes"), F.min("kwh").alias("low"), F.max("kwh").alias("high"))
    facts = by.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.sum("holes").alias("n_with_null"), F.min("low").alias("min_kwh"), F.max("high").alias("max_kwh"))
    sizes = long.agg(F.countDistinct("account_identifier").alias("n_accounts"), F.countDistinct("zip_code").alias("n_zips"), F.countDistinct("date").alias("n_days"))
    own = sizes.crossJoin(facts).withColumn("pct_coverage", F.expr(f"try_divide(n_rows, n_accounts) / {days * slots} * 100"))  # one row each
    bad = F.col("n_accounts").isNull() | (F.col("n_accounts") == 0) | (F.col("min_kwh") < 0) | (F.col("n_with_null") > 0)
    warn = (F.col("max_kwh") > 10) | (F.col("n_repeated") > 0) | (F.col("n_days") < days)
    return own.withColumn("status", F.when(bad, "ISSUE").when(warn, "WARNING").otherwise("OK"))


#: Columns that hold readings on the day clocks go back only.
EXTRA_SLOTS = ("INTERVAL_HR2430_ENERGY_QTY", "INTERVAL_HR2500_ENERGY_QTY")


def dst_columns(wide: DataFrame, day: str = "INTERVAL_READING_DATE") -> DataFrame:
    """(column_name, n_rows, n_nulls, pct_null, n_days, mean_value, low, high) of both extra slots; a column that isn't there is null throughout."""
    own = wide.withColumns({c: F.lit(None).cast("double") for c in EXTRA_SLOTS if c not in wide.columns})
    long = own.select(F.col(day).alias("_day"), *[F.col(c).cast("double").alias(c) for c in EXTRA_SLOTS]).unpivot(["_day"], list(EXTRA_SLOTS), "column_name", "value")
    out = long.groupBy("column_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("_day"))).alias("n_days"), F.avg("value").alias("mean_value"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("column_name", "n_rows", "n_nulls", (F.col("n_nulls") / F.col("n_rows") * 100).alias("pct_null"), "n_days", "mean_value", "low", "high")


def dst_days(wide: DataFrame, day: str = "INTERVAL_READING_DATE") -> DataFrame:
    """(day, n_rows) that have a reading in an extra slot; those that clocks don't go back on shouldn't be here."""
    there = [F.col(c).isNotNull() for c in EXTRA_SLOTS if c in wide.columns] or [F.lit(False)]
    some = there[0] if len(there) == 1 else there[0] | there[1]
    return wide.filter(some).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n_rows"))
