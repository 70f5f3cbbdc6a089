"""Which services and trips run on which dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ADDED, YES, travel_mode
from ..sources.gtfs import DAYS, Schedule


class UnsupportedFeature(ValueError):
    """A filter on something that the schedule says nothing about."""


def runs_on(date: Column, exception_type: Column) -> Column:
    """Whether a calendar row's service runs on a date, given that date's exception or null.

    An exception decides; else a service without a date range doesn't run,
    and others run on their weekdays from start to end, both included.
    """
    weekday = F.element_at(F.array(*DAYS), F.weekday(date) + 1)
    regular = date.between(F.col("start_date"), F.col("end_date")) & weekday
    return F.coalesce(exception_type == ADDED, regular, F.lit(False))


def active_services(schedule: Schedule, dates: DataFrame) -> DataFrame:
    """(date, service_id) of the services that run on the dates in column date."""
    days = dates.select("date").distinct()
    known = schedule.calendar.join(
        schedule.calendar_dates.select("service_id").distinct(), "service_id", "full_outer"
    )
    exceptions = schedule.calendar_dates.select("service_id", "date", "exception_type")
    each = known.select("*", F.explode(F.array(*date_literals(days))).alias("date"))
    judged = each.join(exceptions, ["service_id", "date"], "left")
    return judged.where(runs_on(F.col("date"), F.col("exception_type"))).select("date", "service_id")


def date_literals(days: DataFrame) -> list[Column]:
    """The asked dates as literals: parameters of a query, not data."""
    return [F.lit(r["date"]) for r in days.orderBy("date").collect()] or [F.lit(None).cast("date")]


def trip_filter(modes: Sequence[str] = (), wheelchair: bool = False, bikes: bool = False) -> Column:
    """Condition on trips joined with routes. No modes means all."""
    out = F.lit(True)
    if modes:
        out = out & travel_mode(F.col("route_type")).isin(*modes)
    if wheelchair:
        out = out & (F.col("wheelchair_accessible") == YES)
    if bikes:
        out = out & (F.col("bikes_allowed") == YES)
    return out


def chosen_trips(schedule: Schedule, modes: Sequence[str] = (), wheelchair: bool = False, bikes: bool = False) -> DataFrame:
    """(trip_id, route_id, service_id) of trips that pass the filters."""
    if wheelchair or bikes:
        flags = feature_flags(schedule).first()
        if (wheelchair and not flags["has_accessibility"]) or (bikes and not flags["has_bikes"]):
            raise UnsupportedFeature("the schedule has no such information")
    trips = schedule.trips.join(schedule.routes.select("route_id", "route_type"), "route_id")
    return trips.where(trip_filter(modes, wheelchair, bikes)).select("trip_id", "route_id", "service_id")


def active_trips(schedule: Schedule, dates: DataFrame, **filters: object) -> DataFrame:
    """(date, trip_id, route_id, service_id) of trips that run on the dates and pass the filters of chosen_trips()."""
    running = chosen_trips(schedule, **filters).join(active_services(schedule, dates), "service_id")
    return running.select("date", "trip_id", "route_id", "service_id")


def validity(schedule: Schedule) -> DataFrame:
    """One row: start_date and end_date over calendars and their exceptions."""
    spans = schedule.calendar.select("start_date", "end_date").unionByName(
        schedule.calendar_dates.select(F.col("date").alias("start_date"), F.col("date").alias("end_date"))
    )
    return spans.agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def feature_flags(schedule: Schedule) -> DataFrame:
    """One row: what the schedule has information about."""
    stops = schedule.stops.agg(F.bool_or(F.col("wheelchair_boarding") != 0).alias("stop_access"))
    trips = schedule.trips.agg(
        F.bool_or(F.col("wheelchair_accessible") != 0).alias("trip_access"),
        F.bool_or(F.col("bikes_allowed") != 0).alias("bikes"),
    )
    modes = schedule.routes.agg((F.count_distinct(travel_mode(F.col("route_type"))) > 0).alias("modes"))

    def said(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    # three tables of one row each
    return stops.join(trips).join(modes).select(
        (said("stop_access") | said("trip_access")).alias("has_accessibility"),
        said("bikes").alias("has_bikes"),
        said("modes").alias("has_travel_modes"),
    )


def service_key(schedule: Schedule, dates: DataFrame) -> DataFrame:
    """(date, services): the sorted ids of a date's services, comma-separated."""
    active = active_services(schedule, dates).groupBy("date")
    return active.agg(F.array_join(F.sort_array(F.collect_set("service_id")), ",").alias("services"))
