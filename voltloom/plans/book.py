"""The register of queries, and the tables that stand in for readings, prices and places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions import times
from voltloom.operators import intervals, tariffs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: user, event type, time and value stand for account, zip code, time and kWh."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account_identifier"), F.col("event_type").alias("zip_code"), F.col("ts").alias("datetime"), F.col("value").alias("kwh"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.add_time_columns(readings(spark, sf_dir)).withColumn("month", times.year_month(F.col("date")))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type as a price feed."""
    return table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("ts").alias("datetime_local"), F.col("value").alias("price_cents"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("datetime_local")
    return feed(spark, sf_dir).groupBy(F.year(t).alias("year"), F.month(t).alias("month")).agg(F.avg("price_cents").alias("flat_price_cents"))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariffs.spreads(tariffs.hourly_prices(feed(spark, sf_dir)), flat(spark, sf_dir), check=False)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, dates and times as text: what two engines can be compared on."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c).cast("string").alias(c) if k in ("date", "timestamp_ntz", "timestamp") else F.col(f"`{c}`") for c, k in kinds.items()])


#: Starts of SQL queries: readings, and readings with time columns.
R = "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS account_identifier, event_type AS zip_code, ts AS datetime, value AS kwh FROM events)"
T = R + ", t AS (SELECT *, CAST(datetime AS DATE) AS date, hour(datetime) AS hour, isodow(datetime) AS weekday, isodow(datetime) >= 5 AS is_weekend, strftime(datetime, '%Y%m') AS month FROM r)"
L = R + ", load AS (SELECT account_identifier, zip_code, date_trunc('hour', datetime) AS hour_local, sum(kwh) AS kwh_hour FROM r GROUP BY ALL)"
P = ", p AS (SELECT date_trunc('hour', ts) AS datetime_local, avg(value) AS price_cents, count(*) AS n_intervals FROM events WHERE event_type = 'view' GROUP BY 1), f AS (SELECT year(ts) AS year, month(ts) AS month, avg(value) AS flat_price_cents FROM events WHERE event_type = 'view' GROUP BY ALL), s AS (SELECT p.*, f.year, f.month, flat_price_cents FROM p LEFT JOIN f ON year(datetime_local) = f.year AND month(datetime_local) = f.month)"
B = L + P + ", b AS (SELECT account_identifier, zip_code, sum(kwh_hour) AS total_kwh, max(kwh_hour) AS peak_kwh_hour, sum(kwh_hour * price_cents) / 100 AS rtp_dollars, sum(kwh_hour * flat_price_cents) / 100 AS flat_dollars FROM load JOIN s ON hour_local = datetime_local GROUP BY ALL), bill AS (SELECT *, flat_dollars - rtp_dollars AS diff_dollars, CASE WHEN flat_dollars <> 0 THEN (flat_dollars - rtp_dollars) / flat_dollars * 100 END AS pct_savings FROM b)"
