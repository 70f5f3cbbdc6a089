"""Answers with everything nested in them: a way, its legs, their trips, the trips' stop times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import YES, travel_mode
from ..functions.times import day_offset
from ..sources.gtfs import Schedule, row_positions
from .journeys import leg_details
from .raptor import RIDE, WALK

#: Decimal places of coordinates in answers, about a tenth of a metre.
PLACES = 6


def local_legs(ways: DataFrame, schedule: Schedule, date: Column, keys: list[str], default_zone: str = "UTC") -> DataFrame:
    """leg_details() with the clock times of both ends: departure_zone, departure_at, arrival_zone, arrival_at.

    A ride's zone is that of its agency, at both ends. A walk takes over at
    its departure the zone of the ride just before it, at its arrival that of
    the ride just after; an end without one takes the other end's, and a walk
    between none is in the default zone. Times are texts with the offset, such
    as 2024-01-10T08:00:00+01:00. date is the day whose 00:00 UTC the legs'
    seconds count from.
    """
    legs = leg_details(ways, schedule, keys).withColumn("query_day", date)
    zones = schedule.agency.select("agency_id", F.col("agency_timezone").alias("zone"))
    met = legs.join(zones, "agency_id", "left")
    lists = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", "kind", "zone"))).alias("around"))
    met = met.join(lists, keys)

    def beside(step: int) -> Column:
        other = F.get("around", F.col("nth") + step)
        return F.when((F.col("nth") + step >= 0) & (other["kind"] == RIDE), other["zone"])

    own = F.when(F.col("kind") == RIDE, F.col("zone"))
    met = met.withColumns(
        {
            "departure_zone": F.coalesce(own, beside(-1), beside(1), F.lit(default_zone)),
            "arrival_zone": F.coalesce(own, beside(1), beside(-1), F.lit(default_zone)),
        }
    )
    times = {f"{side}_at": clock_text(F.col("query_day"), F.col(t), F.col(f"{side}_zone")) for side, t in (("departure", "dep"), ("arrival", "arr"))}
    return met.withColumns(times).drop("around", "zone", "query_day")


def clock_text(date: Column, seconds: Column, zone: Column) -> Column:
    """The instant seconds after a date's 00:00 UTC, as a zone's clock shows it, with the offset; the session is in UTC."""
    instant = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + seconds)
    local = F.from_utc_timestamp(instant, zone)
    minutes = F.floor((F.unix_timestamp(local) - F.unix_timestamp(instant)) / 60)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def nested(ways: DataFrame, schedule: Schedule, date: Column, keys: list[str], detailed: bool = True, default_zone: str = "UTC") -> DataFrame:
    """One row per way: keys, departure, arrival, transfers and legs, an array of structs in order.

    A leg has type, from and to (coordinates), fromStop and toStop (id, name,
    coordinates), departureTime, arrivalTime, and for rides trip: headSign,
    route (id, name, shortName, mode), bikesAllowed, wheelchairAccessible and,
    if detailed, stopTimes (stop, arrivalTime, departureTime) of the whole
    trip on its service day, in the zone of its agency. Fields without a
    value are null; as JSON they are left out.
    """
    legs = local_legs(ways, schedule, date, keys, default_zone)
    trips = schedule.trips.select("trip_id", "wheelchair_accessible", "bikes_allowed")
    legs = legs.join(trips, "trip_id", "left")
    if detailed:
        legs = legs.join(_calls(legs, schedule), ["trip_id", "service_date"], "left")
    stop_times = [F.col("stop_times").alias("stopTimes")] if detailed else []
    route = F.struct(
        F.col("route_id").alias("id"),
        F.nullif(F.col("route_long_name"), F.lit("")).alias("name"),
        F.col("route_short_name").alias("shortName"),
        travel_mode(F.col("route_type")).alias("mode"),
    )
    trip = F.struct(
        F.col("trip_headsign").alias("headSign"),
        route.alias("route"),
        *stop_times,
        (F.col("bikes_allowed") == YES).alias("bikesAllowed"),
        (F.col("wheelchair_accessible") == YES).alias("wheelchairAccessible"),
    )
    leg = F.struct(
        "nth",
        F.struct(
            F.when(F.col("kind") == WALK, F.lit("WALK")).otherwise(F.lit("ROUTE")).alias("type"),
            _place("from").alias("from"),
            _place("to").alias("to"),
            _stop("from").alias("fromStop"),
            _stop("to").alias("toStop"),
            F.col("departure_at").alias("departureTime"),
            F.col("arrival_at").alias("arrivalTime"),
            F.when(F.col("kind") == RIDE, trip).alias("trip"),
        ).alias("leg"),
    )
    lists = legs.groupBy(*keys).agg(F.array_sort(F.collect_list(leg), lambda a, b: a["nth"] - b["nth"]).alias("x"))
    told = lists.withColumn("legs", F.transform("x", lambda x: x["leg"]))
    rides = F.size(F.filter("legs", lambda x: x["type"] == "ROUTE"))
    return told.select(
        *keys,
        F.get("legs", F.lit(0))["departureTime"].alias("departure"),
        F.element_at("legs", -1)["arrivalTime"].alias("arrival"),
        F.greatest(rides - 1, F.lit(0)).alias("transfers"),
        "legs",
    )


def _place(side: str) -> Column:
    known = F.col(f"{side}_lat").isNotNull()
    return F.when(known, F.struct(F.round(f"{side}_lat", PLACES).alias("latitude"), F.round(f"{side}_lon", PLACES).alias("longitude")))


def _stop(side: str) -> Column:
    known = F.col(f"{side}_stop").isNotNull()
    return F.when(known, F.struct(F.col(f"{side}_stop").alias("id"), F.col(f"{side}_name").alias("name"), _place(side).alias("coordinates")))


def _calls(legs: DataFrame, schedule: Schedule) -> DataFrame:
    """(trip_id, service_date, stop_times) of the trips ridden."""
    ridden = legs.where(F.col("kind") == RIDE).select("trip_id", "service_date", F.col("departure_zone").alias("zone")).distinct()
    stops = schedule.stops.select("stop_id", "stop_name", F.col("stop_lat").alias("at_lat"), F.col("stop_lon").alias("at_lon"))
    placed = row_positions(schedule.stop_times.join(ridden.select("trip_id").distinct(), "trip_id", "left_semi"))
    each = placed.join(ridden, "trip_id").join(stops, "stop_id")
    shift = day_offset(F.col("service_date"), F.col("zone"))
    named = each.withColumns({"at_stop": F.col("stop_id"), "at_name": F.col("stop_name")})
    call = F.struct(
        _stop("at").alias("stop"),
        clock_text(F.col("service_date"), F.col("arrival") + shift, F.col("zone")).alias("arrivalTime"),
        clock_text(F.col("service_date"), F.col("departure") + shift, F.col("zone")).alias("departureTime"),
    )
    lists = named.groupBy("trip_id", "service_date").agg(F.array_sort(F.collect_list(F.struct("pos", call.alias("call"))), lambda a, b: a["pos"] - b["pos"]).alias("x"))
    return lists.select("trip_id", "service_date", F.transform("x", lambda x: x["call"]).alias("stop_times"))
