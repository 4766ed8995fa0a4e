"""Times of day, week and calendar.  Timestamps are instants; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.params import ZONE


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def parse_message_time(s: Column) -> Column:
    """`Sat Sep 06 03:26:27 +0000 2014`; null where it can't be read. The weekday is skipped: parsing it isn't supported."""
    return F.try_to_timestamp(F.substring(s, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))


def format_message_time(ts: Column) -> Column:
    return F.date_format(ts, "E MMM dd HH:mm:ss Z yyyy")


def day_of_week(ts: Column, zone: str = ZONE) -> Column:
    """Mon to Sun."""
    return F.date_format(local(ts, zone), "E")


def second_of_day(ts: Column, zone: str = ZONE) -> Column:
    """By the wall clock, also on days when it changes."""
    t = local(ts, zone)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")


def time_of_day(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "HH:mm:ss")


def hour_of_day(ts: Column, zone: str = ZONE) -> Column:
    """`HH:00:00`."""
    return F.date_format(local(ts, zone), "HH:'00:00'")


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def utc_hour(ts: Column) -> Column:
    """`2017-06-05T09 UTC`."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH"), F.lit(" UTC"))


def zoned_hour(ts: Column, zone: str = ZONE, summer: str = "AEDT", winter: str = "AEST", summer_hours: int = 11) -> Column:
    """`09 AEST`: the local hour and the name of the zone's offset at that instant."""
    ahead = (local(ts, zone).cast("long") - ts.cast("long")) / 3600
    return F.concat(F.date_format(local(ts, zone), "HH "), F.when(ahead == summer_hours, summer).otherwise(winter))


def slot_start(ts: Column, minutes: int = 15) -> Column:
    return F.timestamp_seconds(F.floor(ts.cast("long") / (60 * minutes)) * 60 * minutes)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def days_of(spans: DataFrame, first: str, last: str, weekday: str | None = None) -> DataFrame:
    """(date, day_of_week): the days from `first` to `last` of each row of `spans`, or those of one weekday."""
    days = spans.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("date")).withColumn("day_of_week", F.date_format("date", "E"))
    return days.where(F.col("day_of_week") == weekday) if weekday else days


def calendar(spark: SparkSession, start: str, end: str, weekday: str | None = None) -> DataFrame:
    """(date, day_of_week) from `start` up to, not including, `end`."""
    return days_of(spark.range(1).select(F.lit(start).cast("date").alias("first"), F.date_sub(F.lit(end).cast("date"), 1).alias("last")), "first", "last", weekday)
