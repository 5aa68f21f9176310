"""Column builders over naive local time. No result depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPRING_FORWARD, FALL_BACK = "2023-03-12", "2023-11-05"


def iso_weekday(c: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c) + 1


def is_weekend(c: Column, weekend_from: int = 6) -> Column:
    """ISO weekday of weekend_from or more. 5 (Friday too) is what interval tables use, 6 is what date manifests use."""
    return iso_weekday(c) >= weekend_from


def hour_start(c: Column) -> Column:
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def billing_day(c: Column) -> Column:
    """The date; a reading stamped 00:00 belongs to the day before."""
    day = F.to_date(c)
    return F.when((F.hour(c) == 0) & (F.minute(c) == 0), F.date_sub(day, 1)).otherwise(day)


def end_stamp(day: Column, hour: Column, minute: Column) -> Column:
    """Naive time of an end-stamped reading: hour 24 is the next day's 00:00, 25 its 01:00."""
    zero = F.lit(0)
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.floor(hour / 24).cast("int"), hour % 24, minute, zero)


def parse_day(c: Column, kind: str) -> Column:
    """A date from a column of the given type: MM/dd/yyyy or ISO text (null where neither), date or timestamp."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.to_date(c)
    own = F.trim(c.cast("string"))
    us = F.when(own.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(own, "M/d/yyyy"))
    return F.coalesce(us, F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}"), own.try_cast("date")))


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")


def local_from_millis(c: Column, zone: str = "America/Chicago") -> tuple[Column, Column]:
    """(UTC, local) naive times of epoch milliseconds."""
    utc = F.lit("1970-01-01").cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c / 1000).cast("decimal(18,6)"))
    return utc, F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from a to b."""
    return F.timestamp_diff("HOUR", a, b)


def months_back(last: Column, first: Column) -> Column:
    """First days of all months from last down to first."""
    return F.reverse(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))


def days_in_month(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))
