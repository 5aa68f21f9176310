"""Queries of reports and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.operators import quality, reports
from voltloom.plans.book import R, T, query, readings, rounded, table, timed

_STATS = "count(DISTINCT account_identifier) AS customers, count(*) AS n_rows, round(avg(kwh), 4) AS mean_value, round(sum(kwh), 4) AS total_value, round(stddev_samp(kwh), 4) AS std_value, round(median(kwh), 4) AS median_value, round(min(kwh), 4) AS min_value, round(max(kwh), 4) AS max_value"


@query(f"{R} SELECT count(*) AS n_rows, count(DISTINCT account_identifier) AS n_accounts, count(DISTINCT zip_code) AS n_zips, CAST(min(datetime) AS VARCHAR) AS first, CAST(max(datetime) AS VARCHAR) AS last FROM r")
def overview(spark, sf_dir):
    return rounded(reports.overview(readings(spark, sf_dir)))


@query(f"{T} SELECT is_weekend, hour, {_STATS} FROM t GROUP BY ALL")
def weekend_vs_weekday_hour(spark, sf_dir):
    return rounded(reports.statistics(timed(spark, sf_dir), ["is_weekend", "hour"]))


@query(f"{T} SELECT month, {_STATS} FROM t GROUP BY ALL")
def month_statistics(spark, sf_dir):
    return rounded(reports.statistics(timed(spark, sf_dir), ["month"]))


@query(f"{T} SELECT hour, round(quantile_cont(kwh, 0.01), 4) AS p1, round(quantile_cont(kwh, 0.1), 4) AS p10, round(quantile_cont(kwh, 0.25), 4) AS p25, round(quantile_cont(kwh, 0.75), 4) AS p75, round(quantile_cont(kwh, 0.9), 4) AS p90, round(quantile_cont(kwh, 0.99), 4) AS p99 FROM t GROUP BY 1")
def hour_quantiles(spark, sf_dir):
    return rounded(reports.quantiles(timed(spark, sf_dir), ["hour"], "kwh", (0.01, 0.1, 0.25, 0.75, 0.9, 0.99)))


@query(f"{T} SELECT coalesce(month, 'TOTAL') AS month, count(DISTINCT account_identifier) AS customers, count(*) AS n_rows, round(sum(kwh), 4) AS total_value FROM t GROUP BY ROLLUP (month)")
def monthly_rollup(spark, sf_dir):
    return rounded(reports.monthly_rollup(timed(spark, sf_dir)))


@query(f"{T} SELECT month, zip_code, CAST(hour AS VARCHAR) AS hour, is_weekend, count(*) AS n_rows, round(avg(kwh), 4) AS mean_value, round(sum(kwh), 4) AS total_value FROM t GROUP BY GROUPING SETS ((month), (zip_code), (hour), (is_weekend), ())")
def grouping_report(spark, sf_dir):
    return rounded(reports.levels(timed(spark, sf_dir)).withColumn("hour", F.col("hour").cast("string")))


def _cells(how, values, column):
    return ", ".join(f"round(coalesce({how}(kwh) FILTER (WHERE {column} = {v}), 0.0), 4) AS c{v}" for v in values)


@query(f"{T} SELECT hour AS row, {_cells('sum', range(1, 13), 'month(datetime)')} FROM t GROUP BY 1")
def heatmap_hour_month(spark, sf_dir):
    return rounded(reports.heatmap(timed(spark, sf_dir), F.col("hour"), F.month("datetime"), list(range(1, 13))))


@query(f"{T} SELECT dayofyear(datetime) AS row, {_cells('avg', range(24), 'hour')} FROM t GROUP BY 1")
def heatmap_doy_hour(spark, sf_dir):
    return rounded(reports.heatmap(timed(spark, sf_dir), F.dayofyear("datetime"), F.col("hour"), list(range(24)), how="mean"))


@query(f"{R} SELECT zip_code, count(DISTINCT account_identifier) AS customers FROM r GROUP BY 1 ORDER BY customers DESC, zip_code LIMIT 10")
def top_zips(spark, sf_dir):
    by = readings(spark, sf_dir).groupBy("zip_code").agg(F.countDistinct("account_identifier").alias("customers"))
    return reports.top(by, "customers", 10, "zip_code")


@query(f"""{T}, m AS (SELECT zip_code, hour, avg(kwh) AS m FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY m DESC, hour) AS a, row_number() OVER (PARTITION BY zip_code ORDER BY m, hour) AS b FROM m)
    SELECT zip_code, max(hour) FILTER (WHERE a = 1) AS peak_hour, max(hour) FILTER (WHERE b = 1) AS base_hour FROM n GROUP BY 1""")
def peak_base_hour(spark, sf_dir):
    return reports.peak_and_base(timed(spark, sf_dir), ["zip_code"])


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM lineitem GROUP BY 1")
def class_share(spark, sf_dir):
    return rounded(reports.percent_of_total(table(spark, sf_dir, "lineitem"), "l_returnflag"))


def _described(c):
    return f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS high FROM lineitem"


@query(" UNION ALL ".join(_described(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_numbers(spark, sf_dir):
    return rounded(reports.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlation_pairs(spark, sf_dir):
    return rounded(reports.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 4) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 4) AS p_retailprice FROM part")
def zscore_columns(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(reports.standardised(own, ["p_size", "p_retailprice"]))


@query(f"{T} SELECT account_identifier, CAST(date AS VARCHAR) AS date, count(*) AS n_intervals, CASE count(*) WHEN 48 THEN 'normal' WHEN 46 THEN 'spring_forward' WHEN 50 THEN 'fall_back' ELSE 'odd' END AS day_type, count(*) NOT IN (46, 48, 50) AS is_odd_count, count(*) IN (46, 50) AS is_dst_transition FROM t GROUP BY account_identifier, date")
def interval_day_qc(spark, sf_dir):
    return rounded(quality.interval_day_qc(timed(spark, sf_dir)))


@query(f"{T}, d AS (SELECT account_identifier, date, count(*) AS n_intervals FROM t GROUP BY ALL) SELECT n_intervals, count(*) AS n_days FROM d GROUP BY 1")
def day_size_histogram(spark, sf_dir):
    return quality.day_sizes(timed(spark, sf_dir))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH k AS (SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT CASE WHEN d > 1 THEN 'different_value' ELSE 'same_value' END AS kind, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM k GROUP BY 1""")
def duplicate_kind(spark, sf_dir):
    return quality.duplicate_kinds(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey)) AS n_keys, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS n_duplicates FROM lineitem")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def _holes(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.select("user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("event_type"))


_HOLES = "WITH h AS (SELECT user_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 4 = 0 THEN event_type END AS event_type FROM events)"


def _nulls(extra=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 4) AS pct_null FROM h" for c in ("user_id", "value", "event_type"))


@query(f"{_HOLES} {_nulls()}")
def null_profile(spark, sf_dir):
    return rounded(quality.null_profile(_holes(spark, sf_dir)))


@query(f"{_HOLES}, n AS ({_nulls()}) SELECT * FROM n WHERE pct_null > 50")
def incomplete_columns(spark, sf_dir):
    return rounded(quality.incomplete(_holes(spark, sf_dir)))


@query(f"""{_HOLES}, n AS ({_nulls()}), d AS (SELECT count(*) - count(DISTINCT user_id) AS v FROM h)
    SELECT 'pct_null' AS check_name, column_name AS subject, pct_null AS value, CASE WHEN pct_null > 50 THEN 'ISSUE' WHEN pct_null > 10 THEN 'WARNING' ELSE 'OK' END AS status FROM n
    UNION ALL SELECT 'column', 'datetime', 0.0, 'FAIL' UNION ALL SELECT 'column', 'hour', 0.0, 'WARNING'
    UNION ALL SELECT 'duplicates', 'user_id', CAST(v AS DOUBLE), CASE WHEN v > 0 THEN 'ISSUE' ELSE 'OK' END FROM d""")
def quality_checkpoint(spark, sf_dir):
    return rounded(quality.checkpoint(_holes(spark, sf_dir), ["user_id", "datetime"], ("hour",), ("user_id",)))


@query("SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM lineitem) AS rows_after, round(((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders)) / (SELECT count(*) FROM orders) * 100, 4) AS pct_change, 'WARNING' AS status")
def checkpoint_compare(spark, sf_dir):
    return rounded(quality.compare(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")))


@query(f"""{T} SELECT count(*) FILTER (WHERE kwh < 0) AS n_negative, count(*) FILTER (WHERE kwh > 50) AS n_large, round(min(kwh), 4) AS min_kwh, round(max(kwh), 4) AS max_kwh, date_diff('day', min(date), max(date)) + 1 AS span_days,
    count(DISTINCT (account_identifier, date)) AS n_account_days, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY account_identifier, date HAVING count(*) = 48)) AS n_complete_days,
    CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY account_identifier, date HAVING count(*) = 48)) = 0 THEN 'ISSUE' ELSE 'WARNING' END AS status FROM t""")
def interval_checks(spark, sf_dir):
    return rounded(quality.interval_checks(timed(spark, sf_dir)))


@query(f"""{R}, h AS (SELECT DISTINCT account_identifier, date_trunc('hour', datetime) AS h FROM r), g AS (SELECT *, date_diff('hour', lag(h) OVER (PARTITION BY account_identifier ORDER BY h), h) AS step FROM h)
    SELECT account_identifier, count(*) AS n_hours, count(*) FILTER (WHERE step > 1) AS n_gaps, max(step) AS longest_gap_hours FROM g GROUP BY 1""")
def hour_gaps(spark, sf_dir):
    return quality.hour_gaps(readings(spark, sf_dir))


@query(f"""{T}, j AS (SELECT t.*, c_name FROM t LEFT JOIN customer ON CAST(account_identifier AS BIGINT) = c_custkey AND c_acctbal > 0),
    v AS (SELECT avg(CASE WHEN c_name IS NOT NULL THEN 100.0 ELSE 0 END) AS m, avg(CASE WHEN c_name IS NULL THEN 100.0 ELSE 0 END) AS n, CAST(count(*) FILTER (WHERE kwh NOT BETWEEN 0 AND 100) AS DOUBLE) AS k FROM j)
    SELECT 'match_rate' AS check_name, round(m, 4) AS value, CASE WHEN m < 90 THEN 'ERROR' WHEN m < 95 THEN 'WARNING' ELSE 'OK' END AS status FROM v
    UNION ALL SELECT 'null_c_name', round(n, 4), CASE WHEN n > 5 THEN 'ERROR' ELSE 'OK' END FROM v
    UNION ALL SELECT 'outside_hour', 0.0, 'OK' UNION ALL SELECT 'outside_weekday', 0.0, 'OK' UNION ALL SELECT 'outside_kwh', k, CASE WHEN k > 0 THEN 'ERROR' ELSE 'OK' END FROM v""")
def enrichment_checks(spark, sf_dir):
    who = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("account_identifier"), "c_name")
    return rounded(quality.enrichment_checks(timed(spark, sf_dir).join(who, "account_identifier", "left"), "c_name", ["c_name"]))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS sample_month, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1),
    o AS (SELECT *, (sum(customers) OVER () - customers) / (count(*) OVER () - 1) AS others FROM m)
    SELECT sample_month, customers, round(others, 4) AS others, round(customers / others, 4) AS ratio, CASE WHEN customers / others < 0.3 THEN 'critical' WHEN customers / others < 0.5 THEN 'low' ELSE 'ok' END AS grade FROM o""")
def under_sampled_months(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("sample_month")).agg(F.countDistinct("o_custkey").alias("customers"))
    return rounded(quality.under_sampled(by))


@query("""WITH m AS (SELECT l_returnflag || l_linestatus AS sample_month, count(DISTINCT l_suppkey) + count(*) AS customers FROM lineitem GROUP BY 1),
    o AS (SELECT *, (sum(customers) OVER () - customers) / (count(*) OVER () - 1) AS others FROM m)
    SELECT sample_month, customers, round(others, 4) AS others, round(customers / others, 4) AS ratio, CASE WHEN customers / others >= 0.8 THEN 'comparable' WHEN customers / others >= 0.5 THEN 'usable' ELSE 'low' END AS grade FROM o""")
def topped_up_months(spark, sf_dir):
    """Kinds of lines stand for months: they differ in size as months after a top-up do."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("sample_month")).agg((F.countDistinct("l_suppkey") + F.count("*")).alias("customers"))
    return rounded(quality.topped_up(by))


@query(f"{T}, h AS (SELECT hour, count(*) AS n FROM t GROUP BY 1) SELECT hour, n, round((n - sum(n) OVER () / 24) / (sum(n) OVER () / 24) * 100, 4) AS pct_off, abs((n - sum(n) OVER () / 24) / (sum(n) OVER () / 24) * 100) < 5 AS balanced FROM h")
def hour_balance(spark, sf_dir):
    return rounded(quality.hour_balance(timed(spark, sf_dir)))


@query(f"""{T}, f AS (SELECT count(DISTINCT account_identifier) AS n_accounts, count(DISTINCT zip_code) AS n_zips, count(DISTINCT date) AS n_days, count(*) AS n_rows, count(*) - count(DISTINCT (account_identifier, datetime)) AS n_repeated,
    count(*) FILTER (WHERE kwh IS NULL) AS n_with_null, round(min(kwh), 4) AS min_kwh, round(max(kwh), 4) AS max_kwh FROM t)
    SELECT *, round(n_rows / n_accounts / 1488 * 100, 4) AS pct_coverage, CASE WHEN min_kwh < 0 OR n_with_null > 0 THEN 'ISSUE' WHEN max_kwh > 10 OR n_repeated > 0 OR n_days < 31 THEN 'WARNING' ELSE 'OK' END AS status FROM f""")
def production_profile(spark, sf_dir):
    return rounded(quality.production_profile(timed(spark, sf_dir)))


#: Orders as wide rows: the extra slots have values on two Sundays of November.
_BACK = "CASE WHEN month(o_orderdate) = 11 AND dayofmonth(o_orderdate) <= 2 AND o_orderpriority <> '5-LOW' THEN {0} END"
_BACK_SQL = f"WITH w AS (SELECT CAST(o_orderdate AS DATE) AS day, {_BACK.format('o_totalprice')} AS a, CASE WHEN month(o_orderdate) = 11 AND dayofmonth(o_orderdate) <= 2 THEN CAST(o_custkey AS DOUBLE) END AS b FROM orders)"


def _fall_back(spark, sf_dir):
    back = F.expr("month(o_orderdate) = 11 and dayofmonth(o_orderdate) <= 2")
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("INTERVAL_READING_DATE"), F.when(back & (F.col("o_orderpriority") != "5-LOW"), F.col("o_totalprice")).alias(quality.EXTRA_SLOTS[0]), F.when(back, F.col("o_custkey").cast("double")).alias(quality.EXTRA_SLOTS[1])
    )


@query(_BACK_SQL + " UNION ALL ".join(f" SELECT '{n}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, round((count(*) - count({c})) / count(*) * 100, 4) AS pct_null, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN day END) AS n_days, round(avg({c}), 4) AS mean_value, round(min({c}), 4) AS low, round(max({c}), 4) AS high FROM w" for n, c in zip(quality.EXTRA_SLOTS, "ab")))
def dst_columns(spark, sf_dir):
    return rounded(quality.dst_columns(_fall_back(spark, sf_dir)))


@query(f"{_BACK_SQL} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_rows FROM w WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1")
def dst_days(spark, sf_dir):
    return rounded(quality.dst_days(_fall_back(spark, sf_dir)))


@query(f"{T} SELECT hour, round(quantile_cont(kwh, 0.01), 4) AS p1, round(quantile_cont(kwh, 0.5), 4) AS p50, round(quantile_cont(kwh, 0.99), 4) AS p99 FROM t GROUP BY 1")
def hour_quantiles_by_ranges(spark, sf_dir):
    return rounded(reports.quantiles_by_ranges(timed(spark, sf_dir), ["hour"], "kwh", (0.01, 0.5, 0.99)))
