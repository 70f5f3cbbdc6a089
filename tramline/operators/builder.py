"""A network without a schedule, from plain tables, and all that is wrong with them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.gtfs import ScheduleError
from ..storage import materialize
from .network import SAME_STOP_SECONDS, Network, Timetable, class_tables
from .raptor import mirrored

EVERY_DAY = "every day"


@dataclass(frozen=True)
class PlainTables:
    """stops(stop_id), routes(route_id), route_stops(route_id, pos, stop_id), trips(route_id, trip_id),
    stop_times(route_id, trip_id, pos, stop_id, arr, dep) and transfers(from_stop, to_stop, duration).

    pos counts from 0; times are seconds; a transfer from a stop to itself is
    the time that changing there takes. Other columns are ignored.
    """

    stops: DataFrame
    routes: DataFrame
    route_stops: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    transfers: DataFrame


def breaches(tables: PlainTables) -> DataFrame:
    """(breach, route_id, trip_id, pos, stop_id): a row for every breach of the rules, in one table; null where it doesn't apply.

    repeated_stop, repeated_route, repeated_route_stop, repeated_trip (of one
    route), repeated_time: a key that occurs more than once, told once.
    unknown_route, unknown_trip, unknown_stop: something referred to that isn't
    there. position_gap: a route's positions don't count up from 0 (the first
    wrong one). no_such_position, other_stop: a time at a position that the
    route doesn't have, or at another stop than the route's. missing_time: a
    trip without a time at one of its route's positions. no_time,
    departs_before_arrival, arrives_before_departure (of the position
    before), negative_transfer. Null keys count as unknown.
    """
    t = tables
    route_stops = t.route_stops.select("route_id", F.col("pos").cast("int").alias("pos"), "stop_id")
    times = t.stop_times.select("route_id", "trip_id", F.col("pos").cast("int").alias("pos"), "stop_id", "arr", "dep")
    places = route_stops.groupBy("route_id", "pos").agg(F.min("stop_id").alias("route_stop"))
    counted = Window.partitionBy("route_id").orderBy("pos")
    gaps = places.withColumn("nth", F.row_number().over(counted) - 1).where("pos is null or pos <> nth").groupBy("route_id").agg(F.min("pos").alias("pos"))
    trips = t.trips.select("route_id", "trip_id").distinct()
    timed = times.select("route_id", "trip_id", "pos").distinct().withColumn("timed", F.lit(True))
    due = trips.join(places, "route_id").join(timed, ["route_id", "trip_id", "pos"], "left")
    beside = times.join(places.withColumn("placed", F.lit(True)), ["route_id", "pos"], "left")
    known_route = t.routes.select("route_id").distinct().withColumn("known", F.lit(True))
    on_routes = beside.join(known_route, "route_id", "left").where("known")
    along = Window.partitionBy("route_id", "trip_id").orderBy("pos", "arr", "dep", "stop_id")
    ordered = times.withColumn("before", F.lag("dep").over(along))
    found = [
        _twice(t.stops, "repeated_stop", "stop_id"),
        _twice(t.routes, "repeated_route", "route_id"),
        _twice(route_stops, "repeated_route_stop", "route_id", "pos"),
        _twice(t.trips, "repeated_trip", "route_id", "trip_id"),
        _twice(times, "repeated_time", "route_id", "trip_id", "pos"),
        *[_unknown(df, t.routes, "unknown_route", "route_id", *more) for df, more in ((route_stops, ["pos"]), (t.trips, ["trip_id"]), (times, ["trip_id", "pos"]))],
        _unknown(times, t.trips, "unknown_trip", "trip_id", "route_id", "pos", also="route_id"),
        _unknown(route_stops, t.stops, "unknown_stop", "stop_id", "route_id", "pos"),
        *[_unknown(t.transfers.select(F.col(side).alias("stop_id")), t.stops, "unknown_stop", "stop_id") for side in ("from_stop", "to_stop")],
        _breach(gaps, "position_gap"),
        _breach(on_routes.where("placed is null"), "no_such_position"),
        _breach(on_routes.where("placed and not (stop_id <=> route_stop)"), "other_stop"),
        _breach(due.where("timed is null").withColumnRenamed("route_stop", "stop_id"), "missing_time"),
        _breach(times.where("arr is null or dep is null"), "no_time"),
        _breach(times.where("arr > dep"), "departs_before_arrival"),
        _breach(ordered.where("before > arr"), "arrives_before_departure"),
        _breach(t.transfers.where("duration < 0 or duration is null").select(F.col("from_stop").alias("stop_id")), "negative_transfer"),
    ]
    return reduce(DataFrame.unionByName, found)


COLUMNS = {"route_id": "string", "trip_id": "string", "pos": "int", "stop_id": "string"}


def _breach(rows: DataFrame, name: str) -> DataFrame:
    def column(c: str) -> Column:
        return (F.col(c) if c in rows.columns else F.lit(None)).cast(COLUMNS[c]).alias(c)

    return rows.select(F.lit(name).alias("breach"), *map(column, COLUMNS))


def _twice(df: DataFrame, name: str, *key: str) -> DataFrame:
    return _breach(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)


def _unknown(df: DataFrame, of: DataFrame, name: str, key: str, *more: str, also: str | None = None) -> DataFrame:
    """Rows of df whose key, with the column also, isn't in of."""
    keys = [key, also] if also else [key]
    return _breach(df.select(*dict.fromkeys([key, *more, *keys])).join(of.select(*keys).distinct(), keys, "left_anti"), name)


def build_plain(tables: PlainTables, same_stop: int = SAME_STOP_SECONDS) -> Network:
    """The network of plain tables; raises ScheduleError if there is any breach, and tells the first few.

    Routes are the patterns; their trips are in order of the first departure,
    then of the id.
    """
    wrong = breaches(tables).limit(5).collect()
    if wrong or same_stop < 0:
        raise ScheduleError("; ".join(f"{r['breach']}: {r['route_id']} {r['trip_id']} {r['pos']} {r['stop_id']}" for r in wrong) or "negative time at a stop")
    n_stops = tables.route_stops.groupBy("route_id").agg(F.count(F.lit(1)).cast("int").alias("n_stops"))
    name = F.col("route_id").alias("pattern_id")
    pattern_stops = tables.route_stops.join(n_stops, "route_id").select(name, "route_id", F.col("pos").cast("int").alias("pos"), "stop_id", "n_stops")
    times = tables.stop_times.select("route_id", "trip_id", F.col("pos").cast("int").alias("pos"), "stop_id", F.col("arr").cast("long").alias("arr"), F.col("dep").cast("long").alias("dep"))
    first = times.groupBy("route_id", "trip_id").agg(F.min("dep").alias("dep0"))
    order = Window.partitionBy("route_id").orderBy("dep0", "trip_id")
    trips = first.select("route_id", "trip_id", (F.row_number().over(order) - 1).alias("trip_ord"))
    placed = times.join(trips, ["route_id", "trip_id"]).join(n_stops, "route_id")
    trip_times = materialize(
        placed.select("trip_id", name, "trip_ord", F.lit(EVERY_DAY).alias("service_id"), "pos", "n_stops", "stop_id", "arr", "dep"), "plain-times"
    )
    paths = tables.transfers.groupBy("from_stop", "to_stop").agg(F.min("duration").cast("long").alias("duration"))
    own = paths.where("from_stop = to_stop").select(F.col("from_stop").alias("stop_id"), F.col("duration").alias("own"))
    net = tables.stops.select("stop_id").join(own, "stop_id", "left")
    net = materialize(net.select("stop_id", F.coalesce("own", F.lit(same_stop)).cast("long").alias("same_stop")), "plain-stops")
    footpaths = materialize(paths.where("from_stop <> to_stop"), "plain-paths")
    return Network(pattern_stops, trips.select(name, "trip_id", "trip_ord", F.lit(EVERY_DAY).alias("service_id")), trip_times, footpaths, net)


def plain_timetable(network: Network, date: dt.date, backward: bool = False) -> Timetable:
    """The timetable of a network whose trips all run on the date, in seconds from its 00:00 UTC."""
    times = materialize(
        network.trip_times.select(F.lit(EVERY_DAY).alias("day_class"), "pattern_id", "trip_id", "trip_ord", "pos", "n_stops", "stop_id", "arr", "dep"),
        "plain-class-times",
        "day_class",
    )
    if backward:
        times, network = mirrored(times, network)
    made = class_tables(times, network)
    calendar = network.net_stops.sparkSession.createDataFrame([(date, EVERY_DAY)], "service_date date, day_class string")
    return Timetable(made.times, made.places, made.departures, made.stops, calendar, (0,), -1 if backward else 1, date)
