"""Station boards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, instant
from ..sources.gtfs import Schedule
from .services import active_services


def station_board(
    schedule: Schedule,
    wanted: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    kind: str = "departure",
    limit: int | None = None,
) -> DataFrame:
    """Stop times of the wanted stops within [start, end), by instant.

    wanted has asked_id and stop_id, as stops.scope() gives. start and end are
    in UTC. Service days from before the window are looked at as far as the
    schedule's latest stop time reaches. Returns asked_id, stop_id, trip_id,
    route_id, service_date, event_ts and, with a limit, rank per asked_id.
    """
    if end < start:
        raise ValueError("end lies before start")
    column = F.col(kind)
    last = schedule.stop_times.agg(F.max(column)).first()[0] or 0
    days = int(last // DAY) + 2
    first = start.date() - dt.timedelta(days=days)
    spark = schedule.stops.sparkSession
    dates = spark.range((end.date() - first).days + 2).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    here = schedule.stop_times.join(wanted.select("asked_id", "stop_id"), "stop_id")
    trips = schedule.trips.select("trip_id", "route_id", "service_id")
    zones = schedule.routes.join(schedule.agency, "agency_id").select("route_id", "agency_timezone")
    dated = (
        here.join(trips, "trip_id")
        .join(active_services(schedule, dates), "service_id")
        .join(zones, "route_id")
        .withColumn("event_ts", instant(F.col("date"), column, F.col("agency_timezone")))
        .where((F.col("event_ts") >= F.lit(start)) & (F.col("event_ts") < F.lit(end)))
        .select("asked_id", "stop_id", "trip_id", "route_id", F.col("date").alias("service_date"), "event_ts")
    )
    if limit is None:
        return dated
    order = Window.partitionBy("asked_id").orderBy("event_ts", "trip_id", "stop_id")
    return dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
