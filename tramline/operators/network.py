"""From a schedule to the tables that routing works on."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import MINIMUM_TIME
from ..functions.times import DAY, day_offset
from ..sources.gtfs import Schedule, ScheduleError
from ..storage import counted, materialize
from .services import active_services, chosen_trips, date_literals, service_key

SAME_STOP_SECONDS = 120


@dataclass(frozen=True)
class Network:
    """pattern_stops(pattern_id, route_id, pos, stop_id, n_stops), pattern_trips(pattern_id,
    trip_id, trip_ord, service_id), trip_times(trip_id, pattern_id, trip_ord, service_id, pos,
    n_stops, stop_id, arr, dep), footpaths(from_stop, to_stop, duration), net_stops(stop_id, same_stop).
    """

    pattern_stops: DataFrame
    pattern_trips: DataFrame
    trip_times: DataFrame
    footpaths: DataFrame
    net_stops: DataFrame


@dataclass(frozen=True)
class Timetable:
    """What a search in one direction reads, written once for all its rounds and queries.

    Service days on which the same services run with the same zone offsets
    have one day_class and share its rows; all tables but stops are stored by
    it. Times are seconds from the service day's 00:00 UTC.

    times is as class_times() gives, of the trips that can be boarded. places(day_class, stop_id, pattern_id,
    pos, first_hour, last_hour) are where one can board. departures(day_class,
    pattern_id, pos, hour, leaves, later) has a row for each hour from a
    place's first to its last departure: leaves lists (at, trip) by time,
    where trip is the first one in order that leaves then or afterwards, and
    later is that of the hours after. stops(stop_id, same_stop, hops) lists
    the footpaths from every stop as (to_stop, duration, same_stop).

    calendar(service_date, day_class) has the days that queries may scan, and
    day_offsets those of a query, counted from its own date; sign is -1 if the
    times are mirrored. date is that of queries that carry none.
    """

    times: DataFrame
    places: DataFrame
    departures: DataFrame
    stops: DataFrame
    calendar: DataFrame
    day_offsets: tuple[int, ...]
    sign: int
    date: dt.date

    def on_days(self, rows: DataFrame, date: Column | str = "date") -> DataFrame:
        """rows for each of the service days scanned for their date: day_idx, service_date, day_class and shift are added.

        shift is what a time of the service day differs by on the axis of a
        query, whose zero is its own date's 00:00 UTC.
        """
        each = rows.withColumn("day_idx", F.explode(F.array(*map(F.lit, self.day_offsets))))
        each = each.withColumn("service_date", F.date_add(date, F.col("day_idx")))
        met = each.join(F.broadcast(self.calendar), "service_date")  # a row for each scanned day, which the driver has listed
        return met.withColumn("shift", (F.col("day_idx") * (self.sign * DAY)).cast("long"))


HOUR = 3600


@dataclass(frozen=True)
class ClassTables:
    """The tables of a Timetable that don't depend on the dates asked for."""

    times: DataFrame
    places: DataFrame
    departures: DataFrame
    stops: DataFrame


def class_tables(times: DataFrame, network: Network) -> ClassTables:
    """The tables of written class_times(), written by day_class."""
    trip = F.struct("trip_ord", "trip_id", "dep")
    place = ["day_class", "pattern_id", "pos"]
    boarded = times.where("pos < n_stops - 1").groupBy(*place, "stop_id", F.col("dep").alias("at")).agg(F.min(trip).alias("trip"))
    onward = Window.partitionBy(*place).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    each = boarded.withColumn("trip", F.min("trip").over(onward)).dropDuplicates([*place, "at"])
    hours = each.groupBy(*place, "stop_id", F.floor(F.col("at") / HOUR).alias("hour")).agg(
        F.sort_array(F.collect_list(F.struct("at", "trip"))).alias("leaves")
    )
    after = Window.partitionBy(*place).orderBy("hour")
    linked = hours.withColumns({"next_hour": F.lead("hour").over(after), "later": F.lead("leaves").over(after)[0]["trip"]})
    # an hour without departures is a row that has later ones only
    filled = linked.withColumn("of", F.explode(F.sequence("hour", F.coalesce(F.col("next_hour") - 1, "hour"))))
    leaves = F.when(F.col("of") == F.col("hour"), F.col("leaves")).alias("leaves")
    departures = materialize(filled.select("stop_id", *place, F.col("of").alias("hour"), leaves, "later"), "departures", "day_class")
    places = departures.groupBy("stop_id", *place).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    to = network.net_stops.select(F.col("stop_id").alias("to_stop"), "same_stop")
    hops = network.footpaths.join(to, "to_stop").groupBy(F.col("from_stop").alias("stop_id"))
    hops = hops.agg(F.collect_list(F.struct("to_stop", "duration", "same_stop")).alias("hops"))
    walks = materialize(network.net_stops.join(hops, "stop_id", "left"), "walks")
    return ClassTables(times, materialize(places, "places", "day_class"), departures, walks)


def boardable(times: DataFrame) -> DataFrame:
    """Rows of trip times whose trip is the first in order among those of its service that leave one of its places at one time.

    Other trips are never boarded: the first one runs on the same days and
    leaves each as early. What stays doesn't grow with trips that leave at the
    times of others.
    """
    first = times.where("pos < n_stops - 1").groupBy("service_id", "pattern_id", "pos", "dep").agg(F.min("trip_ord").alias("trip_ord"))
    return times.join(materialize(first.select("pattern_id", "trip_ord").distinct(), "boardable"), ["pattern_id", "trip_ord"], "left_semi")


def trip_patterns(schedule: Schedule) -> DataFrame:
    """(trip_id, route_id, service_id, stops, calls, n_stops, dep0, pattern_id): trips by their route's stop sequences.

    calls are the trip's times as (arr, dep), in the order of stops. Patterns
    of a route are numbered _sr1, _sr2, .. by their first trip. Trips are
    written once; the table of patterns beside them is small.
    """
    row = F.struct("departure", "row_id", "stop_id", "arrival")
    lists = schedule.stop_times.groupBy("trip_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.min("departure").alias("dep0"))
    trips = schedule.trips.select("trip_id", "route_id", "service_id").join(lists, "trip_id")
    calls = F.transform("rows", lambda r: F.struct(r["arrival"].cast("long").alias("arr"), r["departure"].cast("long").alias("dep")))
    trips = materialize(trips.select("trip_id", "route_id", "service_id", F.col("rows.stop_id").alias("stops"), calls.alias("calls"), "dep0"), "trips")
    earliest = trips.groupBy("route_id", "stops").agg(F.min("dep0").alias("dep0"))
    tied = trips.select("trip_id", "route_id", "stops", "dep0").join(materialize(earliest, "earliest"), ["route_id", "stops", "dep0"])
    first = tied.groupBy("route_id", "stops").agg(F.min(F.struct("dep0", "trip_id")).alias("first"))
    nth = F.dense_rank().over(Window.partitionBy("route_id").orderBy("first"))
    named = first.select("route_id", "stops", F.concat("route_id", F.lit("_sr"), nth).alias("pattern_id"))
    return trips.join(materialize(named, "patterns"), ["route_id", "stops"]).withColumn("n_stops", F.size("stops"))


def trip_orders(trips: DataFrame) -> DataFrame:
    """trips with trip_ord, their place in their pattern by dep0, then trip_id, from 0.

    Trips are numbered among those of their pattern and dep0, from what
    leaves before them, so that no pattern goes through one task.
    """
    before = Window.partitionBy("pattern_id").orderBy("dep0").rowsBetween(Window.unboundedPreceding, -1)
    counts = trips.groupBy("pattern_id", "dep0").agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.select("pattern_id", "dep0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("pattern_id", "dep0").orderBy("trip_id"))
    numbered = trips.withColumn("nth", nth).join(materialize(earlier, "earlier"), ["pattern_id", "dep0"])
    return numbered.withColumn("trip_ord", (F.col("earlier") + F.col("nth") - 1).cast("int")).drop("earlier", "nth")


def build_network(schedule: Schedule, *generated: DataFrame, same_stop: int = SAME_STOP_SECONDS) -> Network:
    """Patterns, ordered trips, times and footpaths of a schedule.

    generated are extra transfers (from_stop, to_stop, duration), the first
    one before later ones. Raises ScheduleError if a trip's times run back, if
    there are no times, or if a transfer or a time at one stop is negative.
    """
    placed = trip_orders(trip_patterns(schedule))
    rows = materialize(placed.select("trip_id", "route_id", "pattern_id", "trip_ord", "n_stops", "service_id", "stops", "calls"), "trip-times")
    trips = rows.select("pattern_id", "trip_id", "n_stops", "trip_ord", "service_id")
    each = rows.select("trip_id", "pattern_id", "trip_ord", "n_stops", "service_id", "stops", F.posexplode("calls").alias("pos", "call"))
    times = each.select(
        "trip_id", "pos", F.get("stops", F.col("pos")).alias("stop_id"), "call.arr", "call.dep", "pattern_id", "n_stops", "trip_ord", "service_id"
    )
    served, n_served = counted(times.select("stop_id").distinct(), "served")
    if not n_served:
        raise ScheduleError("no trip has stop times")
    back = backward_times(rows).first()
    if back:
        raise ScheduleError(f"trip {back['trip_id']} runs back in time at position {back['pos']}")
    one = rows.where("trip_ord = 0").select("pattern_id", "route_id", "n_stops", F.posexplode("stops").alias("pos", "stop_id"))
    stops = materialize(one, "pattern-stops")
    paths = materialize(transfer_table(schedule, served, *generated), "footpaths")
    bad = paths.where("duration < 0").first()
    if bad or same_stop < 0:
        raise ScheduleError(f"a transfer takes negative time: {bad or same_stop}")
    own = paths.where("from_stop = to_stop").select(F.col("from_stop").alias("stop_id"), F.col("duration").alias("own"))
    net = served.join(own, "stop_id", "left").select("stop_id", F.coalesce("own", F.lit(same_stop)).cast("long").alias("same_stop"))
    return Network(stops, trips, times, paths.where("from_stop <> to_stop"), materialize(net, "net-stops"))


def backward_times(trips: DataFrame) -> DataFrame:
    """(trip_id, pos) of trips' calls that arrive before the last departure, or leave before they arrive."""
    each = trips.select("trip_id", "calls", F.posexplode("calls").alias("pos", "call"))
    before = F.get("calls", F.col("pos") - 1)["dep"]
    return each.where((before > F.col("call.arr")) | (F.col("call.arr") > F.col("call.dep"))).select("trip_id", "pos")


def transfer_table(schedule: Schedule, served: DataFrame, *generated: DataFrame) -> DataFrame:
    """(from_stop, to_stop, duration) between served stops, by precedence.

    From weak to strong: generated transfers (a later table below an earlier
    one), transfers derived between stations and their platforms, transfers
    the schedule states. Only minimum-time transfers with a time count.
    A stop takes over the transfers of its parent and of its children, and a
    transfer to a station leads to its platforms too; where several rules
    give a pair, one's own statement beats a station's, and a parent's counts
    below a child's, ties to the shorter.
    """
    stated = schedule.transfers.where((F.col("transfer_type") == MINIMUM_TIME) & F.col("min_transfer_time").isNotNull())
    stated = stated.select(
        F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), F.col("min_transfer_time").alias("duration")
    )
    below = schedule.stops.where("parent_station is not null").select(F.col("parent_station").alias("station"), F.col("stop_id").alias("platform"))
    to_platform = stated.join(below, F.col("to_stop") == F.col("station")).select("from_stop", F.col("platform").alias("to_stop"), "duration")
    # what a stop offers to relatives: its own statements, else those to the platforms of their target
    offered = stated.withColumn("own", F.lit(1)).unionByName(to_platform.withColumn("own", F.lit(0)))
    best = F.max(F.struct("own", (-F.col("duration")).alias("minus"))).alias("b")
    offered = offered.groupBy("from_stop", "to_stop").agg(best)
    offered = offered.select(F.col("from_stop").alias("giver"), "to_stop", (-F.col("b.minus")).alias("duration"))
    from_parent = offered.join(below, F.col("giver") == F.col("station")).select(F.col("platform").alias("from_stop"), "to_stop", "duration")
    from_child = offered.join(below, F.col("giver") == F.col("platform")).select(F.col("station").alias("from_stop"), "to_stop", "duration")
    layers = [(g, -1 - i) for i, g in enumerate(generated)]
    layers += [(from_parent, 1), (from_child, 2), (to_platform, 3), (stated, 4)]
    every = None
    for df, rank in layers:
        part = df.select("from_stop", "to_stop", F.col("duration").cast("long").alias("duration"), F.lit(rank).alias("rank"))
        every = part if every is None else every.unionByName(part)
    chosen = every.groupBy("from_stop", "to_stop").agg(F.max(F.struct("rank", (-F.col("duration")).alias("minus"))).alias("b"))
    ends = [served.select(F.col("stop_id").alias(c)) for c in ("from_stop", "to_stop")]
    return (
        chosen.join(ends[0], "from_stop", "left_semi")
        .join(ends[1], "to_stop", "left_semi")
        .select("from_stop", "to_stop", (-F.col("b.minus")).alias("duration"))
    )


def day_classes(schedule: Schedule, dates: DataFrame, use_zones: bool = True) -> DataFrame:
    """(date, day_class): dates on which the same services run, with the same offsets of all zones, have one class."""
    zones = schedule.agency.select("agency_timezone").distinct()
    asked = dates.select("date").distinct()
    offset = day_offset(F.col("date"), F.col("agency_timezone")) if use_zones else F.lit(0)
    each = zones.withColumn("date", F.explode(F.array(*date_literals(asked)))).select("date", F.concat_ws(" ", "agency_timezone", offset).alias("zone"))
    offsets = each.groupBy("date").agg(F.array_join(F.sort_array(F.collect_set("zone")), ",").alias("offsets"))
    key = F.md5(F.concat_ws("|", F.coalesce("services", F.lit("")), F.coalesce("offsets", F.lit(""))).cast("binary"))
    met = asked.join(service_key(schedule, asked), "date", "left").join(offsets, "date", "left")
    return met.select("date", key.alias("day_class"))


def class_times(schedule: Schedule, network: Network, classes: DataFrame, use_zones: bool = True, backward: bool = False, **filters: object) -> DataFrame:
    """Times of the boardable() trips of each class of classes(day_class, date), in seconds from 00:00 UTC of a service day.

    date is any day of the class. Times are shifted by the service day's zero
    in the zone of the route's agency. filters are those of active_trips(). Of
    a backward search trips are boarded where they arrive.
    """
    times = network.trip_times
    if filters:
        times = times.join(chosen_trips(schedule, **filters).select("trip_id"), "trip_id", "left_semi")
    turned = mirrored_times(times) if backward else times
    times = materialize(boardable(turned), "boardable-times")
    times = mirrored_times(times) if backward else times
    zones = schedule.routes.join(schedule.agency, "agency_id").select("route_id", "agency_timezone")
    zones = network.pattern_stops.select("pattern_id", "route_id").distinct().join(zones, "route_id").select("pattern_id", "agency_timezone")
    running = active_services(schedule, classes).join(classes, "date")
    shift = (day_offset(F.col("date"), F.col("agency_timezone")) if use_zones else F.lit(0)).cast("long")
    moved = times.join(running, "service_id").join(zones, "pattern_id").withColumn("shift", shift)
    return moved.select(
        "day_class",
        "pattern_id",
        "trip_id",
        "trip_ord",
        "pos",
        "n_stops",
        "stop_id",
        (F.col("arr") + F.col("shift")).alias("arr"),
        (F.col("dep") + F.col("shift")).alias("dep"),
    )


def mirrored_times(times: DataFrame) -> DataFrame:
    """Trip times with time and direction turned round."""
    turned = {"arr": -F.col("dep"), "dep": -F.col("arr"), "pos": F.col("n_stops") - 1 - F.col("pos"), "trip_ord": -F.col("trip_ord")}
    return times.withColumns(turned)
