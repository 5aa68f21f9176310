"""Queries on the interval table, manifests, samples and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions import times
from voltloom.operators import intervals, profiles, quality, sampling, sets
from voltloom.plans.book import R, T, query, readings, rounded, table, timed

LOT = "((k % 1000003) * 7919 + 42 * 104729) % 1000003"
_TIMES = """SELECT id, CAST(date AS VARCHAR) AS date, hour(t) AS hour, isodow(date) AS weekday, isodow(date) >= 5 AS is_weekend FROM x"""


def _stamps(spark, sf_dir):
    """Midnights of orders and times of events."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_orderdate").alias("datetime"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.col("ts").alias("datetime"))
    return orders.unionByName(events)


_ALL = "SELECT 'o' || o_orderkey AS id, o_orderdate AS t FROM orders UNION ALL SELECT 'e' || event_id, ts FROM events"


@query(f"WITH x AS (SELECT id, t, CAST(t AS DATE) AS date FROM ({_ALL})) {_TIMES}")
def time_columns_calendar(spark, sf_dir):
    return rounded(intervals.add_time_columns(_stamps(spark, sf_dir)).select("id", "date", "hour", "weekday", "is_weekend"))


@query(f"WITH x AS (SELECT id, t, CASE WHEN hour(t) = 0 AND minute(t) = 0 THEN CAST(t AS DATE) - 1 ELSE CAST(t AS DATE) END AS date FROM ({_ALL})) {_TIMES}")
def time_columns_billing(spark, sf_dir):
    return rounded(intervals.add_time_columns(_stamps(spark, sf_dir), "billing").select("id", "date", "hour", "weekday", "is_weekend"))


@query(f"""WITH x AS (SELECT id, CAST(t AS DATE) AS date FROM ({_ALL})) SELECT id, date = DATE '1998-03-08' AS is_spring_forward_day, date = DATE '1998-11-01' AS is_fall_back_day FROM x""")
def dst_flags(spark, sf_dir):
    return intervals.add_time_columns(_stamps(spark, sf_dir), spring="1998-03-08", fall="1998-11-01").select("id", "is_spring_forward_day", "is_fall_back_day")


def _half_hours(spark, sf_dir):
    """Readings moved to the end of their half hour."""
    t = F.col("datetime")
    return readings(spark, sf_dir).withColumn("datetime", times.hour_start(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.minute(t) < 30, 30).otherwise(60), F.lit(0)))


_HALF = R + ", h AS (SELECT account_identifier, zip_code, date_trunc('hour', datetime) + CASE WHEN minute(datetime) < 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 60 MINUTE END AS datetime, kwh FROM r)"


@query(f"""{_HALF}, d AS (SELECT *, CASE WHEN hour(datetime) = 0 AND minute(datetime) = 0 THEN CAST(datetime AS DATE) - 1 ELSE CAST(datetime AS DATE) END AS day FROM h)
    SELECT account_identifier, zip_code, CAST(day AS VARCHAR) AS day, round(sum(kwh) FILTER (WHERE datetime = day + INTERVAL 30 MINUTE), 4) AS hr0030,
    round(sum(kwh) FILTER (WHERE datetime = day + INTERVAL 720 MINUTE), 4) AS hr1200, round(sum(kwh) FILTER (WHERE datetime = day + INTERVAL 1440 MINUTE), 4) AS hr2400 FROM d GROUP BY ALL""")
def long_to_wide(spark, sf_dir):
    wide = intervals.long_to_wide(_half_hours(spark, sf_dir))
    return rounded(wide.select("account_identifier", "zip_code", "day", *[F.col(f"INTERVAL_HR{h}_ENERGY_QTY").alias(f"hr{h}") for h in ("0030", "1200", "2400")]))


@query(f"{_HALF} SELECT account_identifier, zip_code, CAST(datetime AS VARCHAR) AS datetime, round(sum(kwh), 4) AS kwh FROM h GROUP BY ALL")
def wide_to_long(spark, sf_dir):
    wide = intervals.long_to_wide(_half_hours(spark, sf_dir))
    named = wide.withColumnsRenamed({"zip_code": "ZIP_CODE", "account_identifier": "ACCOUNT_IDENTIFIER"})
    named = named.withColumns({"DELIVERY_SERVICE_CLASS": F.lit("R"), "DELIVERY_SERVICE_NAME": F.lit("Residential"), "INTERVAL_READING_DATE": F.date_format("day", "MM/dd/yyyy")})
    return rounded(intervals.wide_to_long(named).select("account_identifier", "zip_code", "datetime", "kwh"))


@query(f"{R} SELECT account_identifier, min(zip_code) AS zip_code FROM r GROUP BY 1")
def account_manifest(spark, sf_dir):
    return sampling.account_manifest(readings(spark, sf_dir))


@query(f"{T} SELECT DISTINCT CAST(date AS VARCHAR) AS date, weekday, weekday >= 6 AS is_weekend FROM t")
def date_manifest(spark, sf_dir):
    return rounded(sampling.date_manifest(timed(spark, sf_dir)))


@query(f"WITH a AS (SELECT DISTINCT user_id AS k FROM events) SELECT k AS account FROM a ORDER BY {LOT}, k LIMIT 50")
def sample_households(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("account")).distinct()
    return sampling.draw(own, 50, sampling.lot(F.col("account"), 42), "account")


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), e AS (SELECT date, isodow(date) >= 6 AS is_weekend, date_diff('day', DATE '1970-01-01', date) AS k FROM d),
    n AS (SELECT *, row_number() OVER (PARTITION BY is_weekend ORDER BY {LOT}, date) AS r FROM e)
    SELECT CAST(date AS VARCHAR) AS date, is_weekend FROM n WHERE r <= CASE WHEN is_weekend THEN 3 ELSE 7 END""")
def sample_dates_stratified(spark, sf_dir):
    own = sampling.date_manifest(timed(spark, sf_dir))
    return rounded(sampling.sample_dates(own, 10, 0.7, sampling.lot(F.unix_date("date"), 42)).select("date", "is_weekend"))


@query(f"""WITH f AS (SELECT strftime(o_orderdate, '%Y%m') AS sample_month, o_custkey AS k, min('part-' || o_orderkey % 7) AS source_key FROM orders GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY sample_month ORDER BY {LOT}, k) AS r FROM f) SELECT sample_month, k AS account_identifier, source_key FROM n WHERE r <= 5""")
def sample_accounts_monthly(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(times.year_month(F.col("o_orderdate")).alias("sample_month"), F.col("o_custkey").alias("account_identifier"), F.concat(F.lit("part-"), F.col("o_orderkey") % 7).alias("source_key"))
    return sampling.sample_by_month(own, 5, sampling.lot(F.col("account_identifier"), 42))


@query(f"{T}, p AS (SELECT account_identifier, zip_code, date, list(kwh ORDER BY datetime, kwh) AS profile FROM t GROUP BY ALL) SELECT account_identifier, zip_code, CAST(date AS VARCHAR) AS date, unnest(range(len(profile))) AS slot, round(unnest(profile), 4) AS kwh FROM p")
def profile_slots(spark, sf_dir):
    own = profiles.daily_profiles(timed(spark, sf_dir))
    return rounded(own.select("account_identifier", "zip_code", "date", F.posexplode("profile").alias("slot", "kwh")))


@query(f"{T} SELECT account_identifier, zip_code, CAST(date AS VARCHAR) AS date, bool_and(is_weekend) AS is_weekend, min(weekday) AS weekday FROM t GROUP BY account_identifier, zip_code, date HAVING count(*) = 2")
def profile_complete(spark, sf_dir):
    return rounded(profiles.complete(profiles.daily_profiles(timed(spark, sf_dir)), 2).select("account_identifier", "zip_code", "date", "is_weekend", "weekday"))


@query(f"""{T}, k AS (SELECT DISTINCT CAST(account_identifier AS BIGINT) AS k FROM r), a AS (SELECT CAST(k AS VARCHAR) AS account_identifier FROM k ORDER BY {LOT}, k LIMIT 50), d AS (SELECT DISTINCT date FROM t WHERE weekday < 6)
    SELECT account_identifier, zip_code, CAST(date AS VARCHAR) AS date, count(*) AS n FROM t WHERE account_identifier IN (FROM a) AND date IN (FROM d) GROUP BY ALL HAVING count(*) = 1""")
def profile_sampled(spark, sf_dir):
    own = timed(spark, sf_dir)
    everyone = own.select("account_identifier").distinct()
    accounts = sampling.draw(everyone, 50, sampling.lot(F.col("account_identifier"), 42), "account_identifier")
    out = profiles.prepare(own, accounts, sampling.date_manifest(own).filter("not is_weekend"), 1)
    return rounded(out.select("account_identifier", "zip_code", "date", F.size("profile").cast("long").alias("n")))


_DAYS = f"{T}, p AS (SELECT account_identifier, date, list(kwh ORDER BY datetime, kwh) AS v FROM t GROUP BY ALL)"


def _days(spark, sf_dir):
    return profiles.daily_profiles(timed(spark, sf_dir).withColumn("zip_code", F.lit("all")))


@query(f"""{_DAYS} SELECT account_identifier, CAST(date AS VARCHAR) AS date, unnest(range(len(v))) AS slot,
    round(unnest(list_transform(v, lambda x: CASE WHEN list_max(v) = list_min(v) THEN 0.0 ELSE (x - list_min(v)) / (list_max(v) - list_min(v)) END)), 4) AS value FROM p""")
def profile_minmax(spark, sf_dir):
    return rounded(profiles.normalised(_days(spark, sf_dir)).select("account_identifier", "date", F.posexplode("profile").alias("slot", "value")))


@query(f"""{_DAYS}, q AS (SELECT *, list_avg(v) AS m, sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / len(v)) AS s FROM p)
    SELECT account_identifier, CAST(date AS VARCHAR) AS date, unnest(range(len(v))) AS slot, round(unnest(list_transform(v, lambda x: CASE WHEN s <= 1e-10 THEN 0.0 ELSE (x - m) / s END)), 4) AS value FROM q""")
def profile_zscore(spark, sf_dir):
    return rounded(profiles.normalised(_days(spark, sf_dir), "zscore").select("account_identifier", "date", F.posexplode("profile").alias("slot", "value")))


@query(f"{T} SELECT account_identifier, zip_code, CAST(datetime AS VARCHAR) AS datetime FROM t WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
def month_clip(spark, sf_dir):
    return rounded(intervals.of_month(timed(spark, sf_dir), 2024, 1).select("account_identifier", "zip_code", "datetime"))


_CM = f"""{T}, d AS (SELECT account_identifier, date, month FROM t GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT month AS sample_month, account_identifier, count(*) AS ok_days, max(day(last_day(date))) AS days_in_month FROM d GROUP BY ALL)"""


@query(f"{_CM} SELECT sample_month, account_identifier, ok_days, days_in_month, round(ok_days / days_in_month, 4) AS ratio FROM c WHERE ok_days / days_in_month >= 0.5")
def completeness_by_month(spark, sf_dir):
    return rounded(quality.complete_months(timed(spark, sf_dir), 2, 0.5))


@query(f"{_CM} SELECT account_identifier, CAST(datetime AS VARCHAR) AS datetime, round(kwh, 4) AS kwh FROM t WHERE (month, account_identifier) IN (SELECT sample_month, account_identifier FROM c WHERE ok_days / days_in_month >= 0.9)")
def completeness_90(spark, sf_dir):
    return rounded(quality.keep_complete_months(timed(spark, sf_dir), 2, 0.9).select("account_identifier", "datetime", "kwh"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, NULL AS extra FROM orders), b AS (SELECT l_orderkey AS k, NULL AS price, l_tax AS extra FROM lineitem)
    SELECT k, round(price, 4) AS price, round(extra, 4) AS extra FROM a UNION ALL SELECT k, price, round(extra, 4) FROM b""")
def union_diagonal(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_tax").alias("extra"))
    return rounded(sets.union_diagonal([a, b]))


@query("SELECT o_custkey AS k, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT c_custkey, CAST(c_nationkey AS DOUBLE) FROM customer")
def union_relaxed(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return sets.union_relaxed([a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))])


@query("SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT o_custkey, o_totalprice FROM orders UNION ALL SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) FROM nation")
def union_widened(spark, sf_dir):
    parts = (("customer", "c_custkey", "c_nationkey"), ("orders", "o_custkey", "o_totalprice"), ("nation", "n_nationkey", "n_regionkey"))
    return sets.union_relaxed([table(spark, sf_dir, t).select(F.col(k).alias("k"), F.col(v).alias("v")) for t, k, v in parts])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return sets.union_distinct([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))])


def _dedupe(order):
    return f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {order}, o_orderkey {order}) AS r FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM n WHERE r = 1"


@query(_dedupe("ASC"))
def dedupe_keep_first(spark, sf_dir):
    return rounded(sets.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"))


@query(_dedupe("DESC"))
def dedupe_keep_last(spark, sf_dir):
    return rounded(sets.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
    SELECT CAST(x AS VARCHAR) AS date FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS x FROM d) WHERE x NOT IN (SELECT date FROM d)""")
def missing_dates(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"))
    return rounded(sets.missing_dates(own))


@query("""SELECT o_orderkey, CAST(unnest(list_reverse(generate_series(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH, date_trunc('month', o_orderdate), INTERVAL 1 MONTH)))::DATE AS VARCHAR) AS month FROM orders""")
def month_list(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", F.explode(times.months_back(day, F.add_months(day, -2))).alias("month")))


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6), e AS (SELECT date, date_diff('day', DATE '1970-01-01', date) AS k FROM d)
    SELECT CAST(date AS VARCHAR) AS date, false AS is_weekend FROM e ORDER BY {LOT}, date LIMIT 10""")
def sample_dates_of_one_kind(spark, sf_dir):
    own = sampling.date_manifest(timed(spark, sf_dir)).filter("not is_weekend")
    return rounded(sampling.sample_dates(own, 10, 0.7, sampling.lot(F.unix_date("date"), 42)).select("date", "is_weekend"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS sample_month, CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) AS date FROM orders WHERE strftime(o_orderdate + INTERVAL 2 DAY, '%Y%m') = strftime(o_orderdate, '%Y%m')""")
def spill_clip(spark, sf_dir):
    """Orders as readings that come two days late: those of the next month are left out."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", times.year_month(F.col("o_orderdate")).alias("sample_month"), F.date_add("o_orderdate", 2).alias("date"))
    return rounded(intervals.of_sample_month(own))


#: Every customer has a day of 48, 46, 50 or an odd number of readings.
_SIZES = "CASE c_custkey % 7 WHEN 0 THEN 46 WHEN 1 THEN 50 WHEN 2 THEN 47 ELSE 48 END"


#: Customers of one partition, before each becomes some dozens of readings.
ACCOUNTS = 10_000


def _spread(accounts):
    """accounts in partitions of about ACCOUNTS: however many a file has, no task makes the readings of all."""
    return accounts.repartition(max(1, -(-accounts.count() // ACCOUNTS)), "account_identifier")


def _made_days(spark, sf_dir):
    slots = F.explode(F.expr(f"sequence(1, {_SIZES})"))
    accounts = _spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").cast("string").alias("account_identifier")))
    own = accounts.select("account_identifier", F.lit("60601").alias("zip_code"), F.expr("date'2024-03-01'").alias("date"), slots.alias("slot"), F.col("c_acctbal").alias("kwh"))
    return own.withColumn("datetime", times.end_stamp(F.col("date"), F.expr("slot div 2"), F.col("slot") % 2 * 30))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS account_identifier, '2024-03-01' AS date, {_SIZES} AS n_intervals, CASE {_SIZES} WHEN 48 THEN 'normal' WHEN 46 THEN 'spring_forward' WHEN 50 THEN 'fall_back' ELSE 'odd' END AS day_type,
    {_SIZES} = 47 AS is_odd_count, {_SIZES} IN (46, 50) AS is_dst_transition FROM customer""")
def interval_day_qc_kinds(spark, sf_dir):
    return rounded(quality.interval_day_qc(_made_days(spark, sf_dir)))


#: Every customer has two readings on each of the first 20 to 29 days of February 2024.
@query("""WITH d AS (SELECT c_custkey, unnest(range(20 + c_custkey % 10)) AS d FROM customer), r AS (SELECT c_custkey, d, unnest([0, 1]) AS half FROM d)
    SELECT CAST(c_custkey AS VARCHAR) AS account_identifier, CAST(TIMESTAMP '2024-02-01' + to_days(CAST(d AS INTEGER)) + to_minutes(30 * half) AS VARCHAR) AS datetime FROM r WHERE (20 + c_custkey % 10) / 29 >= 0.9""")
def completeness_of_full_months(spark, sf_dir):
    days = _spread(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("account_identifier")))
    days = days.select("account_identifier", F.explode(F.expr("sequence(0, cast(19 + c_custkey % 10 as int))")).alias("d"))
    own = days.select("account_identifier", F.expr("date_add(date'2024-02-01', d)").alias("date"), F.explode(F.array(F.lit(0), F.lit(30))).alias("minute"))
    own = own.withColumn("datetime", times.end_stamp(F.col("date"), F.lit(0), F.col("minute")))
    return rounded(quality.keep_complete_months(own, 2, 0.9).select("account_identifier", "datetime"))
