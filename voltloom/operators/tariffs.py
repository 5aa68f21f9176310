"""Real-time against flat tariffs: hourly prices, spreads, loads and bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions import times


def hourly_prices(feed: DataFrame, local: str = "datetime_local", utc: str | None = None, price: str = "price_cents") -> DataFrame:
    """(datetime_local, [datetime_utc,] price_cents, n_intervals): mean of the local hour. The hour that occurs twice is one, with its first UTC hour."""
    extra = [F.min(times.hour_start(F.col(utc))).alias("datetime_utc")] if utc else []
    return feed.groupBy(times.hour_start(F.col(local)).alias("datetime_local")).agg(F.avg(price).alias("price_cents"), F.count(price).alias("n_intervals"), *extra)


def spreads(hourly: DataFrame, flat: DataFrame, check: bool = True) -> DataFrame:
    """Hourly prices with the month's flat price and their difference; months without a flat price raise if check is set."""
    t = F.col("datetime_local")
    own = hourly.select(t, F.year(t).alias("year"), F.month(t).alias("month"), "price_cents")
    if check:
        lost = own.select("year", "month").distinct().join(flat, ["year", "month"], "left_anti").orderBy("year", "month").limit(5).collect()
        if lost:
            raise ValueError(f"no flat price for {[(r.year, r.month) for r in lost]}")
    return own.join(flat, ["year", "month"], "left").select("datetime_local", "year", "month", "price_cents", "flat_price_cents", (F.col("flat_price_cents") - F.col("price_cents")).alias("spread_cents"))


def hourly_load(long: DataFrame) -> DataFrame:
    """kwh of each account by hour of the stamp."""
    return long.groupBy("account_identifier", "zip_code", times.hour_start(F.col("datetime")).alias("hour_local")).agg(F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh_hour"))


def bills(load: DataFrame, spread: DataFrame) -> DataFrame:
    """Each account's totals under both tariffs, in dollars; pct_savings in percent, null without a flat bill."""
    cents = spread.select(F.col("datetime_local").alias("hour_local"), "price_cents", "flat_price_cents")
    own = load.join(cents, "hour_local")
    dollars = lambda c: F.coalesce(F.sum(F.col("kwh_hour") * F.col(c)), F.lit(0.0)) / 100
    out = own.groupBy("account_identifier", "zip_code").agg(F.sum("kwh_hour").alias("total_kwh"), F.max("kwh_hour").alias("peak_kwh_hour"), dollars("price_cents").alias("rtp_dollars"), dollars("flat_price_cents").alias("flat_dollars"))
    diff = F.col("flat_dollars") - F.col("rtp_dollars")
    return out.withColumns({"diff_dollars": diff, "pct_savings": F.when(F.col("flat_dollars") != 0, diff / F.col("flat_dollars") * 100)})


def net_bills(df: DataFrame, capacity_rate: float = 5.0, admin_fee: float = 0.39) -> DataFrame:
    """bills() with a charge for the greatest hour's load and a fixed fee taken off the savings."""
    out = df.withColumns({"capacity_kw": F.col("peak_kwh_hour"), "capacity_charge": F.col("peak_kwh_hour") * capacity_rate, "admin_fee": F.lit(admin_fee)})
    net = F.col("diff_dollars") - F.col("capacity_charge") - F.col("admin_fee")
    return out.withColumns({"net_diff_dollars": net, "net_pct_savings": F.when(F.col("flat_dollars") != 0, net / F.col("flat_dollars") * 100)})


def bill_summary(df: DataFrame, column: str = "diff_dollars") -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.count("*").alias("n_households"), F.avg(c).alias("mean_savings"), F.median(c).alias("median_savings"), F.min(c).alias("min_savings"), F.max(c).alias("max_savings"),
        (F.avg((c > 0).cast("double")) * 100).alias("pct_saving"), (F.avg((c < 0).cast("double")) * 100).alias("pct_paying_more"),
    )


def price_quality(hourly: DataFrame, expected_hours: int = 8760) -> DataFrame:
    """One row: hours there and missing, gaps of over an hour, hours with a negative price."""
    # one window: hourly prices are some thousand rows a year, whatever the size of the load data
    step = F.timestamp_diff("HOUR", F.lag("datetime_local").over(Window.orderBy("datetime_local")), F.col("datetime_local"))
    own = hourly.withColumn("step", step)
    return own.agg(F.count("*").alias("n_hours"), (F.lit(expected_hours) - F.count("*")).alias("missing_hours"), F.count_if(F.col("step") > 1).alias("n_gaps"), F.max("step").alias("longest_gap_hours"), F.count_if(F.col("price_cents") < 0).alias("negative_hours"))
