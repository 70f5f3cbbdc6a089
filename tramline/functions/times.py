"""Service times: whole seconds since noon minus 12 hours of a service day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HALF_DAY = 43_200


def parse_service_time(text: Column) -> Column:
    """Seconds of 'H+:MM:SS', over 24 hours allowed; null where it isn't one."""
    trimmed = F.trim(text)
    part = [F.regexp_extract(trimmed, r"^(\d{1,4}):([0-5]?\d):([0-5]?\d)$", i) for i in (1, 2, 3)]
    whole = part[0].try_cast("int") * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int")
    return F.when(trimmed.rlike(r"^\d{1,4}:[0-5]?\d:[0-5]?\d$"), whole)


def format_service_time(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.format_string("%02d:%02d:%02d", hours, minutes, F.pmod(seconds, F.lit(60)))


def clock_seconds(seconds: Column) -> Column:
    """Seconds of the day that a clock shows, modulo 24 hours."""
    return F.pmod(seconds, F.lit(DAY))


def day_offset(date: Column, zone: Column) -> Column:
    """Seconds from 00:00 UTC of a date to its service day's zero in a zone.

    Taken at noon, so that clock changes of the night don't move the day.
    """
    noon = F.to_utc_timestamp(date.cast("timestamp") + F.expr("INTERVAL 12 HOURS"), zone)
    return F.unix_timestamp(noon) - HALF_DAY - F.unix_timestamp(date.cast("timestamp"))


def instant(date: Column, seconds: Column, zone: Column) -> Column:
    """The instant of a service time; the session's time zone must be UTC."""
    return F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + day_offset(date, zone) + seconds)
