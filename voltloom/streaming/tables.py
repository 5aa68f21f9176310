"""Structured Streaming forms of the aggregates that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    own = spark.readStream.schema(schema)
    return (own.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else own).parquet(folder)


def hourly_load(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """kwh by account and hour of the stamp; hours are closed once the watermark is past. Needs a timestamp column `datetime`."""
    own = stream.withWatermark("datetime", delay)
    by = own.groupBy(F.window("datetime", "1 hour"), "account_identifier", "zip_code").agg(F.sum("kwh").alias("kwh_hour"))
    return by.select("account_identifier", "zip_code", F.col("window.start").alias("hour_local"), "kwh_hour")


def hourly_prices(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    own = stream.withWatermark("datetime_local", delay)
    by = own.groupBy(F.window("datetime_local", "1 hour")).agg(F.avg("price_cents").alias("price_cents"), F.count("price_cents").alias("n_intervals"))
    return by.select(F.col("window.start").alias("datetime_local"), "price_cents", "n_intervals")


def first_readings(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Readings without repeats of (account, time) that arrive within the delay."""
    return stream.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(["account_identifier", "datetime"])


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that has arrived to Parquet, then stop; closed windows only."""
    query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
