"""Wide half-hourly readings to a long interval table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions import times

IDS = ["ZIP_CODE", "DELIVERY_SERVICE_CLASS", "DELIVERY_SERVICE_NAME", "ACCOUNT_IDENTIFIER", "INTERVAL_READING_DATE"]
#: 48 end-stamped half hours and two more of the day clocks go back.
INTERVALS = [f"INTERVAL_HR{h // 2:02d}{h % 2 * 30:02d}_ENERGY_QTY" for h in range(1, 51)]
LONG = ["zip_code", "delivery_service_class", "delivery_service_name", "account_identifier", "datetime", "kwh"]


def canonical(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Just these columns in this order; missing ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def wide_to_long(wide: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each reading that is there, with the columns `more`. Missing id columns or interval columns raise."""
    if missing := [c for c in IDS if c not in wide.columns]:
        raise ValueError(f"missing columns: {missing}")
    there = [c for c in INTERVALS if c in wide.columns]
    if not there:
        raise ValueError("no interval columns")
    day = times.parse_day(F.col("INTERVAL_READING_DATE"), wide.schema["INTERVAL_READING_DATE"].dataType.simpleString())
    clock = [int(c[11:13]) * 60 + int(c[13:15]) for c in there]  # minutes, from the column's name
    slim = wide.select(*IDS[:4], *more, day.alias("day"), F.posexplode(F.array(*[F.col(c).try_cast("double") for c in there])).alias("slot", "kwh")).filter("kwh is not null")
    minutes = F.element_at(F.array(*map(F.lit, clock)), F.col("slot") + 1)
    long = slim.withColumn("minutes", minutes)
    return long.select(
        F.col("ZIP_CODE").cast("string").alias("zip_code"), F.col("DELIVERY_SERVICE_CLASS").alias("delivery_service_class"), F.col("DELIVERY_SERVICE_NAME").alias("delivery_service_name"),
        F.col("ACCOUNT_IDENTIFIER").cast("string").alias("account_identifier"), times.end_stamp(F.col("day"), F.expr("minutes div 60").cast("int"), F.col("minutes") % 60).alias("datetime"), "kwh", *more,
    )


def long_to_wide(long: DataFrame) -> DataFrame:
    """Back to a column for each half hour: (zip_code, account_identifier, day, INTERVAL_...); readings of one slot are added."""
    day = times.billing_day(F.col("datetime"))
    minutes = F.timestamp_diff("MINUTE", day.cast("timestamp_ntz"), F.col("datetime"))
    label = F.format_string("INTERVAL_HR%02d%02d_ENERGY_QTY", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    return long.select("zip_code", "account_identifier", day.alias("day"), label.alias("slot"), "kwh").groupBy("zip_code", "account_identifier", "day").pivot("slot", INTERVALS[:48]).agg(F.sum("kwh"))


def add_time_columns(long: DataFrame, day_mode: str = "calendar", weekend_from: int = 5, spring: str = times.SPRING_FORWARD, fall: str = times.FALL_BACK) -> DataFrame:
    """date, hour, weekday (1 to 7), is_weekend and flags of the days clocks change.

    day_mode billing gives a reading stamped 00:00 to the day before. weekend_from 5 counts Friday as weekend,
    as interval tables of this kind have it; date manifests use 6.
    """
    if day_mode not in ("calendar", "billing"):
        raise ValueError(f"day_mode is calendar or billing, not {day_mode!r}")
    t = F.col("datetime")
    date = F.to_date(t) if day_mode == "calendar" else times.billing_day(t)
    out = long.withColumn("date", date)
    return out.withColumns(
        {
            "hour": F.hour(t),
            "weekday": times.iso_weekday(F.col("date")),
            "is_weekend": times.is_weekend(F.col("date"), weekend_from),
            "is_spring_forward_day": F.col("date") == F.lit(spring).cast("date"),
            "is_fall_back_day": F.col("date") == F.lit(fall).cast("date"),
            "is_dst_day": F.col("date").isin(F.lit(spring).cast("date"), F.lit(fall).cast("date")),
        }
    )


def of_sample_month(long: DataFrame) -> DataFrame:
    """Rows whose date lies in the month of the file that they came in; files hold a few readings of the next month."""
    return long.filter(times.year_month(F.col("date")) == F.col("sample_month"))


def of_month(long: DataFrame, year: int, month: int) -> DataFrame:
    """Rows whose date lies in the month."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return long.filter(F.col("date").between(first, F.last_day(first)))
