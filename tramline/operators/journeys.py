"""Finishing and describing ways that routing found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, rounded
from ..functions.times import DAY
from ..sources.gtfs import Schedule, row_positions
from ..storage import materialize
from .network import Timetable, mirrored_times
from .raptor import LEG, RIDE, WALK


def _named(leg: Column, **changes: Column) -> Column:
    """A leg with some of its fields changed."""
    names = [part.split(":")[0] for part in LEG.removeprefix("struct<").split(",")]
    return F.struct(*[changes[n].alias(n) if n in changes else leg[n].alias(n) for n in names]).cast(LEG)


def without_idle_start(ways: DataFrame) -> DataFrame:
    """An initial walk leaves so late that it arrives just when the ride departs."""
    first, second = F.get("legs", F.lit(0)), F.get("legs", F.lit(1))
    idle = F.when((first["kind"] == WALK) & (second["kind"] == RIDE), second["dep"] - first["arr"])

    def moved(leg: Column, nth: Column) -> Column:
        later = (nth == 0) & (F.col("idle") > 0)
        by = F.when(later, F.col("idle")).otherwise(0)
        return _named(leg, dep=leg["dep"] + by, arr=leg["arr"] + by)

    return ways.withColumn("idle", idle).withColumn("legs", F.transform("legs", moved)).drop("idle")


def without_detour_walks(ways: DataFrame, table: Timetable) -> DataFrame:
    """Ride on, or board earlier, instead of walking, where the same trip serves the stop.

    A ride and the final walk become one ride if its trip reaches the walk's
    end no later than the walk; an initial walk and ride become one ride if
    its trip leaves the walk's start no earlier than the walk. ways has the
    query's date; table is that of the search which found the ways.
    """
    keys = [c for c in ways.columns if c != "legs"]
    ridden = ways.select("date", F.explode("legs").alias("leg")).select("date", "leg.trip_id", "leg.service_date").distinct()
    ridden = ridden.join(F.broadcast(table.calendar), "service_date")
    times = table.times if table.sign == 1 else mirrored_times(table.times)
    calls = ridden.join(times.select("day_class", "trip_id", "stop_id", "arr", "dep"), ["day_class", "trip_id"])
    shift = (F.date_diff("service_date", "date") * DAY).cast("long")
    calls = calls.groupBy("date", "trip_id", "service_date", "stop_id").agg((F.min("arr") + shift).alias("arr"), (F.min("dep") + shift).alias("dep"))
    last, ride = F.element_at("legs", -1), F.get("legs", F.size("legs") - 2)
    called = calls.select(*[F.col(c).alias(f"x_{c}") for c in calls.columns])

    def met(ride: Column, stop: Column) -> Column:
        same = (F.col("x_trip_id") == ride["trip_id"]) & (F.col("x_service_date") == ride["service_date"]) & (F.col("x_stop_id") == stop)
        return same & (F.col("x_date") == F.col("date"))

    tail = ways.join(called, met(ride, last["to_stop"]), "left")
    joins = (last["kind"] == WALK) & (ride["kind"] == RIDE) & (F.col("x_arr") <= last["arr"]) & (F.col("x_arr") > ride["dep"])
    longer = _named(ride, to_stop=last["to_stop"], arr=F.col("x_arr"))
    kept = F.when(joins, F.concat(F.slice("legs", 1, F.size("legs") - 2), F.array(longer))).otherwise(F.col("legs"))
    tail = materialize(tail.select(*keys, kept.alias("legs")), "ways")
    first, then = F.get("legs", F.lit(0)), F.get("legs", F.lit(1))
    head = tail.join(called, met(then, first["from_stop"]), "left")
    joins = (first["kind"] == WALK) & (then["kind"] == RIDE) & (F.col("x_dep") >= first["dep"]) & (F.col("x_dep") < then["arr"])
    earlier = _named(then, from_stop=first["from_stop"], dep=F.col("x_dep"))
    kept = F.when(joins, F.concat(F.array(earlier), F.slice("legs", 3, F.size("legs") - 2))).otherwise(F.col("legs"))
    return materialize(head.select(*keys, kept.alias("legs")), "ways")


def described(ways: DataFrame) -> DataFrame:
    """Counts and ends of each way: departure, arrival, seconds, rides, walk transfers, same-stop transfers."""
    kinds = F.transform("legs", lambda x: x["kind"])
    rides = F.size(F.filter(kinds, lambda k: k == RIDE))
    pairs = F.zip_with(kinds, F.slice(kinds, 2, F.greatest(F.size("legs") - 1, F.lit(0))), lambda a, b: (a == RIDE) & (b == RIDE))
    return ways.withColumns(
        {
            "departure": F.try_element_at("legs", F.lit(1))["dep"],
            "arrival": F.try_element_at("legs", F.lit(-1))["arr"],
            "n_rides": rides,
            "n_walks": F.size(F.filter(kinds, lambda k: k == WALK)),
            "n_same_stop": F.size(F.filter(pairs, lambda p: F.coalesce(p, F.lit(False)))),
            "n_transfers": F.greatest(rides - 1, F.lit(0)),
        }
    ).withColumn("seconds", F.col("arrival") - F.col("departure"))


def broken_ways(ways: DataFrame) -> DataFrame:
    """Ways with a leg that doesn't start where and when the one before ended."""
    nexts = F.slice("legs", 2, F.greatest(F.size("legs") - 1, F.lit(0)))
    fits = F.zip_with("legs", nexts, lambda a, b: b.isNull() | ((a["to_stop"] == b["from_stop"]) & (a["arr"] <= b["dep"])))
    return ways.where(~F.forall(fits, lambda x: F.coalesce(x, F.lit(True))))


def leg_rows(ways: DataFrame, keys: list[str]) -> DataFrame:
    """One row per leg, numbered from 0 in column nth."""
    return ways.select(*keys, F.posexplode("legs").alias("nth", "leg")).select(*keys, "nth", "leg.*")


def connecting_hops(stop_times: DataFrame) -> DataFrame:
    """(trip_id, pos, stop_id, prev_stop, next_stop): one-stop neighbours on the trip, whose rows are sorted once."""
    along = Window.partitionBy("trip_id").orderBy("departure", "row_id")
    placed = row_positions(stop_times.select("trip_id", "stop_id", "departure", "row_id"))
    return placed.select("trip_id", "pos", "stop_id", F.lag("stop_id").over(along).alias("prev_stop"), F.lead("stop_id").over(along).alias("next_stop"))


def mile_leg_kept(duration: Column, minimum: int) -> Column:
    """Whether a walk to the first or from the last stop is shown as a leg of its own."""
    return F.coalesce((duration > minimum) & (duration > 0), F.lit(False))


def with_mile_legs(ways: DataFrame, minimum: int = 0) -> DataFrame:
    """Ways of routing.connections() whose walks to the first and from the last stop are legs.

    A leg from or to a place that is no stop has null there. Walks of up to
    minimum seconds stay out of the legs; departure and arrival count them all.
    """

    def leg(from_stop: Column, to_stop: Column, dep: Column, arr: Column) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(WALK).alias("kind"), null.alias("pattern_id"), null.alias("trip_id"), F.lit(None).cast("date").alias("service_date"),
            from_stop.alias("from_stop"), to_stop.alias("to_stop"), dep.alias("dep"), arr.alias("arr"),
        ).cast(LEG)

    none, empty = F.lit(None).cast("string"), F.array().cast(f"array<{LEG}>")
    first = leg(none, F.col("from_stop"), F.col("departure"), F.col("departure") + F.col("walk_in"))
    last = leg(F.col("to_stop"), none, F.col("arrival") - F.col("walk_out"), F.col("arrival"))
    before = F.when(mile_leg_kept(F.col("walk_in"), minimum), F.array(first)).otherwise(empty)
    after = F.when(mile_leg_kept(F.col("walk_out"), minimum), F.array(last)).otherwise(empty)
    return ways.withColumn("legs", F.concat(before, "legs", after))


def leg_details(ways: DataFrame, schedule: Schedule, keys: list[str]) -> DataFrame:
    """leg_rows() with names and places of both stops, the trip's headsign, its route, and metres.

    The route of a walk between stops is named after them. distance is that
    of the leg's ends, null where one is no stop.
    """
    legs = leg_rows(ways, keys)
    trips = schedule.trips.select("trip_id", "trip_headsign", "route_id").join(
        schedule.routes.select("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"), "route_id", "left"
    )
    named = legs.join(trips, "trip_id", "left")
    for side in ("from", "to"):
        place = schedule.stops.select(*[F.col(f"stop_{c}").alias(f"{side}_{'stop' if c == 'id' else c}") for c in ("id", "name", "lat", "lon")])
        named = named.join(place, f"{side}_stop", "left")
    walk = F.format_string("transfer_%s_%s", "from_stop", "to_stop")
    distance = rounded(haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))
    return named.withColumns({"route_id": F.when(F.col("kind") == WALK, walk).otherwise(F.col("route_id")), "distance": distance})

