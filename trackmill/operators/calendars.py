"""Local calendars: every day between the first and the last event, as a zone's clocks count it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_midnight(day: Column, zone: str) -> Column:
    """The instant at which a local day begins; where midnight does not exist, that of the next hour."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_days(events: DataFrame, time: str, zone: str) -> DataFrame:
    """(day, begins, hours): all local days from the first to the last event, with the hours that they have: 23
    or 25 when clocks change. Instants are those of a session in UTC."""
    local = F.to_date(F.from_utc_timestamp(F.col(time), zone))
    ends = events.agg(F.min(local).alias("first"), F.max(local).alias("last"))
    days = ends.filter("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("day"))
    begins, until = local_midnight(F.col("day"), zone), local_midnight(F.date_add("day", 1), zone)
    hours = (F.unix_seconds(until) - F.unix_seconds(begins)) / 3600
    return days.select("day", begins.alias("begins"), hours.cast("long").alias("hours"))
