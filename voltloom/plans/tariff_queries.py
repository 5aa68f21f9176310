"""Queries on prices, loads and bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions.times import local_from_millis
from voltloom.operators import tariffs
from voltloom.plans.book import B, L, P, feed, query, readings, rounded, spread, table


@query(f"{L} SELECT account_identifier, zip_code, CAST(hour_local AS VARCHAR) AS hour_local, round(kwh_hour, 4) AS kwh_hour FROM load")
def hourly_load(spark, sf_dir):
    return rounded(tariffs.hourly_load(readings(spark, sf_dir)))


@query(f"{L}{P} SELECT CAST(datetime_local AS VARCHAR) AS datetime_local, round(price_cents, 4) AS price_cents, n_intervals FROM p")
def hourly_price_mean(spark, sf_dir):
    return rounded(tariffs.hourly_prices(feed(spark, sf_dir)))


@query(f"{L}{P} SELECT CAST(datetime_local AS VARCHAR) AS datetime_local, year, month, round(price_cents, 4) AS price_cents, round(flat_price_cents, 4) AS flat_price_cents, round(flat_price_cents - price_cents, 4) AS spread_cents FROM s")
def tariff_spread(spark, sf_dir):
    return rounded(spread(spark, sf_dir))


def _bills(spark, sf_dir):
    return tariffs.bills(tariffs.hourly_load(readings(spark, sf_dir)), spread(spark, sf_dir))


@query(f"{B} SELECT account_identifier, zip_code, round(total_kwh, 4) AS total_kwh, round(peak_kwh_hour, 4) AS peak_kwh_hour, round(rtp_dollars, 4) AS rtp_dollars, round(flat_dollars, 4) AS flat_dollars, round(diff_dollars, 4) AS diff_dollars, round(pct_savings, 4) AS pct_savings FROM bill")
def household_bill(spark, sf_dir):
    return rounded(_bills(spark, sf_dir))


@query(f"""{B} SELECT account_identifier, zip_code, round(peak_kwh_hour * 5.0, 4) AS capacity_charge, round(diff_dollars - peak_kwh_hour * 5.0 - 0.39, 4) AS net_diff_dollars,
    round(CASE WHEN flat_dollars <> 0 THEN (diff_dollars - peak_kwh_hour * 5.0 - 0.39) / flat_dollars * 100 END, 4) AS net_pct_savings FROM bill""")
def household_bill_net(spark, sf_dir):
    return rounded(tariffs.net_bills(_bills(spark, sf_dir)).select("account_identifier", "zip_code", "capacity_charge", "net_diff_dollars", "net_pct_savings"))


@query(f"""{B} SELECT count(*) AS n_households, round(avg(diff_dollars), 4) AS mean_savings, round(median(diff_dollars), 4) AS median_savings, round(min(diff_dollars), 4) AS min_savings, round(max(diff_dollars), 4) AS max_savings,
    round(avg(CASE WHEN diff_dollars > 0 THEN 1.0 ELSE 0 END) * 100, 4) AS pct_saving, round(avg(CASE WHEN diff_dollars < 0 THEN 1.0 ELSE 0 END) * 100, 4) AS pct_paying_more FROM bill""")
def bill_summary(spark, sf_dir):
    return rounded(tariffs.bill_summary(_bills(spark, sf_dir)))


@query(f"""{L}{P}, g AS (SELECT *, date_diff('hour', lag(datetime_local) OVER (ORDER BY datetime_local), datetime_local) AS step FROM p)
    SELECT count(*) AS n_hours, 8760 - count(*) AS missing_hours, count(*) FILTER (WHERE step > 1) AS n_gaps, max(step) AS longest_gap_hours, count(*) FILTER (WHERE price_cents < 0) AS negative_hours FROM g""")
def price_completeness(spark, sf_dir):
    return tariffs.price_quality(tariffs.hourly_prices(feed(spark, sf_dir)))


#: Local time by rule: clocks go forward on March's second Sunday at 8:00 UTC and back on November's first Sunday at 7:00 UTC.
_SUNDAY = "(date_trunc('day', {0}) + to_days(CAST((7 - isodow({0})) % 7 AS INTEGER)))"
_SUMMER = f"u >= {_SUNDAY.format('make_timestamp(year(u), 3, 8, 0, 0, 0)')} + INTERVAL 8 HOUR AND u < {_SUNDAY.format('make_timestamp(year(u), 11, 1, 0, 0, 0)')} + INTERVAL 7 HOUR"


@query(f"""WITH e AS (SELECT epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS u FROM events)
    SELECT ms, CAST(u AS VARCHAR) AS utc, CAST(u - CASE WHEN {_SUMMER} THEN INTERVAL 5 HOUR ELSE INTERVAL 6 HOUR END AS VARCHAR) AS local FROM e""")
def epoch_millis(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.expr("unix_millis(cast(concat(cast(ts as string), '+00:00') as timestamp))").alias("ms"))
    utc, local = local_from_millis(F.col("ms"))
    return own.select("ms", utc.cast("string").alias("utc"), local.cast("string").alias("local"))
