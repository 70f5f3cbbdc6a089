"""Schedules in the GTFS format: eight CSV tables in a folder or a zip file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import parse_service_time
from .feeds import Feed, feed_of

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
ONE_OF = ("calendar", "calendar_dates")
OPTIONAL = ("transfers",)

#: Typed columns of each table. "?" marks one whose column may be missing or blank.
SCHEMAS = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string",
    "calendar": "service_id string, " + ", ".join(f"{d} boolean" for d in DAYS) + ", start_date date, end_date date",
    "calendar_dates": "service_id string, date date, exception_type int",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string, wheelchair_boarding int",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "trip_id string, route_id string, service_id string, trip_headsign string, wheelchair_accessible int, bikes_allowed int",
    "stop_times": "row_id long, trip_id string, stop_id string, arrival int, departure int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int",
}


class ScheduleError(ValueError):
    """A schedule that can't be loaded."""


@dataclass(frozen=True)
class Schedule:
    """The typed tables of one schedule, and the rows that were left out of them."""

    agency: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    transfers: DataFrame
    rejected: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "rejected"}


def from_rows(spark: SparkSession, **rows: list[tuple]) -> Schedule:
    """A schedule from Python rows per table, in the order of SCHEMAS; absent tables are empty."""
    return Schedule(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def locate(uri: str, staging: str | None = None) -> str:
    """The path that Spark reads for a file, s3 or http(s) address.

    s3 becomes s3a. http(s) has to be fetched to the staging folder by other
    means beforehand, under the address's last part.
    """
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return parsed.path
    if parsed.scheme == "s3":
        return f"s3a://{parsed.netloc}{parsed.path}"
    if parsed.scheme in ("http", "https") and staging:
        return os.path.join(staging, os.path.basename(parsed.path))
    raise ScheduleError(f"no way to read {uri}")


def read_schedule(spark: SparkSession, source: str | Feed) -> Schedule:
    """Read a folder, a zip file or any other Feed and check it.

    agency, stops, routes, trips, stop_times and one of calendar and
    calendar_dates must be there and have rows. Trips, stop times and calendar
    dates that can't be parsed, or that refer to something unknown, are left
    out and listed in rejected; stop times of a rejected trip go with it.
    Routes of unknown agencies, transfers of unknown stops, unknown parents
    and repeated keys are errors.
    """
    feed = feed_of(source)
    raw = {name: _named(feed.table(spark, name)) for name in SCHEMAS}
    missing = [n for n in REQUIRED if raw[n] is None]
    if missing or all(raw[n] is None for n in ONE_OF):
        raise ScheduleError(f"missing tables: {', '.join(missing) or ' or '.join(ONE_OF)}")
    for name in REQUIRED:
        if raw[name].isEmpty():
            raise ScheduleError(f"{name} has no rows")
    parsed = {n: spark.createDataFrame([], SCHEMAS[n]) if df is None else _typed(df, n) for n, df in raw.items()}
    return validate(Schedule(**parsed))


def _named(df: DataFrame | None) -> DataFrame | None:
    return None if df is None else df.toDF(*[c.strip().lower().lstrip("\ufeff") for c in df.columns])


def _typed(df: DataFrame, name: str) -> DataFrame:
    def text(column: str) -> Column:
        return F.col(column) if column in df.columns else F.lit(None).cast("string")

    def code(column: str) -> Column:
        blank = F.coalesce(text(column), F.lit("")) == ""
        return F.when(blank, F.lit(0)).otherwise(text(column).try_cast("int"))

    def date(column: str) -> Column:
        return F.try_to_date(text(column), "yyyyMMdd")

    special = {
        "parent_station": F.nullif(text("parent_station"), F.lit("")),
        "wheelchair_boarding": code("wheelchair_boarding"),
        "wheelchair_accessible": code("wheelchair_accessible"),
        "bikes_allowed": code("bikes_allowed"),
        "start_date": date("start_date"),
        "end_date": date("end_date"),
        "date": date("date"),
        "arrival": parse_service_time(text("arrival_time")),
        "departure": parse_service_time(text("departure_time")),
        "row_id": F.monotonically_increasing_id(),
    } | {d: F.coalesce(text(d) == "1", F.lit(False)) for d in DAYS}
    columns = []
    for part in SCHEMAS[name].split(", "):
        column, kind = part.split()
        value = special[column] if column in special else text(column)
        columns.append((value if kind == "string" or column in special else value.try_cast(kind)).alias(column))
    return df.select(*columns)


def validate(schedule: Schedule) -> Schedule:
    """Apply the policy of read_schedule() to typed tables."""
    services = schedule.calendar.select("service_id").union(schedule.calendar_dates.select("service_id")).distinct()
    _unique(schedule.agency, ["agency_id"], "agency")
    _unique(schedule.calendar, ["service_id"], "calendar")
    _unique(schedule.stops, ["stop_id"], "stops")
    _unique(schedule.routes, ["route_id"], "routes")
    _unique(schedule.trips, ["trip_id"], "trips")
    _unique(schedule.calendar_dates.where("date is not null"), ["service_id", "date"], "calendar_dates")
    _known(schedule.routes, "agency_id", schedule.agency, "agency_id", "routes")
    parents = schedule.stops.where("parent_station is not null")
    _known(parents, "parent_station", schedule.stops, "stop_id", "stops")
    for side in ("from_stop_id", "to_stop_id"):
        _known(schedule.transfers, side, schedule.stops, "stop_id", "transfers")
    dates_ok = F.col("date").isNotNull() & F.col("exception_type").isin(1, 2)
    dates, bad_dates = _split(schedule.calendar_dates, dates_ok)
    routes = schedule.routes.select("route_id", F.lit(True).alias("has_route"))
    marked = schedule.trips.join(routes, "route_id", "left").join(
        services.withColumn("has_service", F.lit(True)), "service_id", "left"
    )
    codes_ok = F.col("wheelchair_accessible").isNotNull() & F.col("bikes_allowed").isNotNull()
    good = F.col("has_route").isNotNull() & F.col("has_service").isNotNull() & codes_ok
    trips, bad_trips = (x.select(schedule.trips.columns) for x in _split(marked, good))
    timed = schedule.stop_times.join(trips.select("trip_id", F.lit(True).alias("has_trip")), "trip_id", "left").join(
        schedule.stops.select("stop_id", F.lit(True).alias("has_stop")), "stop_id", "left"
    )
    in_order = F.col("arrival").isNotNull() & F.col("departure").isNotNull() & (F.col("arrival") <= F.col("departure"))
    good = F.col("has_trip").isNotNull() & F.col("has_stop").isNotNull() & in_order
    times, bad_times = (x.select(schedule.stop_times.columns) for x in _split(timed, good))
    return replace(
        schedule,
        calendar_dates=dates,
        trips=trips,
        stop_times=times,
        rejected={"calendar_dates": bad_dates, "trips": bad_trips, "stop_times": bad_times},
    )


def _split(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    sure = F.coalesce(good, F.lit(False))
    return df.where(sure), df.where(~sure)


def _unique(df: DataFrame, key: list[str], name: str) -> None:
    twice = df.groupBy(*key).count().where("count > 1").first()
    if twice:
        raise ScheduleError(f"{name}: key {tuple(twice[k] for k in key)} occurs {twice['count']} times")


def _known(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> None:
    lost = df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").first()
    if lost:
        raise ScheduleError(f"{name}: {key} {lost[key]} is unknown")


def row_positions(stop_times: DataFrame) -> DataFrame:
    """stop_times with pos, the place in its trip by departure, ties in file order."""
    order = Window.partitionBy("trip_id").orderBy("departure", "row_id")
    return stop_times.withColumn("pos", F.row_number().over(order) - 1)
