"""Round-based routing of many queries at once.

Round k holds, for every query and stop, the best way of k rides. A round
looks up the first departures at the stops that the last round bettered,
follows the boarded trips, adds footpaths, and keeps the least per stop: equal
joins with tables that are written once, and a grouped minimum. Labels know
the legs of their own round; whole ways are put together at the end, for the
labels that are wanted.

A profile search answers for many moments of a query at once. A label then
carries its moment, the time from which its way may start; one of a later
moment that is no slower makes it needless, so a stop's labels are the front
of late starts and early arrivals, and what two departures share is followed
once. The answer for a moment is the best label of that or a later one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import counted
from .network import HOUR, Network, Timetable, mirrored_times

LEG = "struct<kind:string,pattern_id:string,trip_id:string,service_date:date,from_stop:string,to_stop:string,dep:bigint,arr:bigint>"
START, RIDE, WALK = "START", "RIDE", "WALK"
LABEL = ["query_id", "date", "moment", "round", "stop_id", "kind", "t", "cmp_t", "start", "n_legs", "legs"]


@dataclass(frozen=True)
class RouteConfig:
    """max_transfers None means until nothing improves. Seconds; None means no bound."""

    max_transfers: int | None = None
    min_transfer: int = 0
    max_walk: int | None = None
    max_travel: int | None = None
    walk_at_source: bool = True
    walk_at_target: bool = True


@dataclass(frozen=True)
class Search:
    """Labels that bettered a stop: LABEL columns.

    date is the query's. moment is the time that a profile search answers for,
    else 0. t is the arrival, cmp_t the time that labels are compared by,
    start the departure of the way's first leg, n_legs their number, and legs
    those of the label's own round. Of a round there is one label per query,
    moment and stop; the way goes on at the first leg's from_stop in the round
    before.
    """

    labels: DataFrame
    rounds: int
    profile: bool = False


def mirrored(times: DataFrame, network: Network) -> tuple[DataFrame, Network]:
    """The network with time and direction turned round, for latest departures."""
    paths = network.footpaths.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "duration")
    return mirrored_times(times), Network(network.pattern_stops, network.pattern_trips, network.trip_times, paths, network.net_stops)


def route(
    sources: DataFrame,
    table: Timetable,
    config: RouteConfig,
    targets: DataFrame | None = None,
    profile: bool = False,
    until: DataFrame | None = None,
) -> Search:
    """All labels that improved a stop, over rounds 0, 1, ..

    sources has query_id, stop_id, t (seconds on the axis of the times), for
    queries of other dates than the timetable's also date, and for a profile
    search moment; several rows of a query are alternative starts. targets has
    query_id, stop_id and walk (seconds from the stop to the end), and bounds
    the search: what arrives later than the best known end is dropped. Stops
    that aren't in the network are ignored. Of a profile search, until
    (query_id, until) bounds the moments to which starts may be put off: a way
    that would wait beyond it for its first ride is none, so it can't make
    others needless.

    Ties: less time, then a ride, then the later start, fewer legs, and ids.
    """
    for name, value in (("date", F.lit(table.date)), ("moment", F.lit(0))):
        if name not in sources.columns:
            sources = sources.withColumn(name, value)
    known = table.stops.select("stop_id")
    start = sources.join(known, "stop_id", "left_semi").groupBy("query_id", "date", F.col("moment").cast("long").alias("moment"), "stop_id")
    start = start.agg(F.min("t").cast("long").alias("t"))
    limit = None
    if config.max_travel is not None:
        limit = start.groupBy("query_id", "moment").agg((F.min("t") + config.max_travel).alias("limit"))
    ends = None if targets is None else targets.groupBy("query_id", "stop_id").agg(F.min("walk").alias("walk"))
    first = start.select(
        "query_id",
        "date",
        "moment",
        F.lit(0).alias("round"),
        "stop_id",
        F.lit(START).alias("kind"),
        "t",
        F.col("t").alias("cmp_t"),
        F.col("t").alias("start"),
        F.lit(0).alias("n_legs"),
        F.array().cast(f"array<{LEG}>").alias("legs"),
    )
    if config.walk_at_source:
        first = _first_per_stop(_walked(first, table, config, ends))
    frontier, n = counted(_undominated(first) if profile else first, "frontier")
    moments = start.select("query_id", "moment").distinct() if profile else None
    kept, rounds = frontier, 0
    while n and (config.max_transfers is None or rounds <= config.max_transfers):
        rounds += 1
        best = kept.groupBy("query_id", "moment", "stop_id").agg(F.min("cmp_t").alias("known"))
        bound = None if ends is None else _bounds(best, ends, moments)
        rides = _within(_rides(frontier, table, config, rounds, profile, until), best, limit, bound, profile)
        reached = _first_per_stop(_within(_walked(rides, table, config, ends), best, limit, bound, profile))
        frontier, n = counted(_undominated(reached) if profile else reached, "frontier")
        kept = kept.unionByName(frontier)
    return Search(kept, rounds, profile)


def _rides(
    frontier: DataFrame, table: Timetable, config: RouteConfig, round_: int, profile: bool, until: DataFrame | None
) -> DataFrame:
    waiting = frontier.join(table.stops.select("stop_id", "same_stop"), "stop_id")
    pause = F.greatest("same_stop", F.lit(config.min_transfer).cast("long"))
    ready = F.col("t") + F.when(F.col("kind") == RIDE, pause).otherwise(0)
    asked = table.on_days(waiting.select("query_id", "date", "moment", "stop_id", "start", "n_legs", ready.alias("ready")))
    asked = asked.withColumn("ready", F.col("ready") - F.col("shift")).join(table.places, ["day_class", "stop_id"])
    boards = first_trips(asked, table.departures)
    if until is not None and round_ == 1:
        put_off = F.col("moment") + F.col("dep") - F.col("ready")
        boards = boards.join(until, "query_id").where(put_off < F.col("until")).drop("until")
    place = ["query_id", "date", "stop_id", "pattern_id", "pos"]
    if len(table.day_offsets) > 1:  # of the days scanned, the first that has a trip
        on = F.struct((F.col("day_idx") * table.sign).alias("day"), "start", "n_legs", "day_class", "day_idx", "service_date", "shift", "trip_id", "dep")
        boards = boards.groupBy(*place, "moment").agg(F.min(on).alias("b")).select(*place, "moment", "b.*")
    if profile:  # of the moments that catch a trip, the last one
        last = F.max(F.struct("moment", "start", "n_legs", "day_class", "service_date", "shift", "dep")).alias("b")
        boards = boards.groupBy(*place, "day_idx", "trip_id").agg(last).select(*place, "trip_id", "b.*")
    along = table.times.select("day_class", "trip_id", F.col("pos").alias("to_pos"), F.col("stop_id").alias("to_stop"), "arr")
    met = boards.join(along, ["day_class", "trip_id"]).where(F.col("to_pos") > F.col("pos"))
    met = met.withColumns({"dep": F.col("dep") + F.col("shift"), "arr": F.col("arr") + F.col("shift")})
    leg = F.struct(
        F.lit(RIDE).alias("kind"), "pattern_id", "trip_id", "service_date", F.col("stop_id").alias("from_stop"), "to_stop", "dep", "arr"
    ).cast(LEG)
    # a way begins with its first ride unless it has begun before
    rides = met.select(
        "query_id",
        "date",
        "moment",
        F.lit(round_).alias("round"),
        F.col("to_stop").alias("stop_id"),
        F.lit(RIDE).alias("kind"),
        F.col("arr").alias("t"),
        F.col("arr").alias("cmp_t"),
        F.when(F.col("n_legs") == 0, F.col("dep")).otherwise(F.col("start")).alias("start"),
        (F.col("n_legs") + 1).alias("n_legs"),
        F.array(leg).alias("legs"),
    )
    return _first_per_stop(rides)


def first_trips(asked: DataFrame, departures: DataFrame) -> DataFrame:
    """As-of join: for each row of asked the first trip in order that leaves no earlier than ready.

    asked has day_class, pattern_id, pos, ready, and the place's first_hour
    and last_hour; it meets the one row of its hour (a place's first one if
    that is later). Adds trip_id and dep; rows after the last departure are
    dropped.
    """
    hour = F.greatest(F.floor(F.col("ready") / HOUR), "first_hour")
    placed = asked.withColumn("hour", hour).where(F.col("hour") <= F.col("last_hour")).drop("first_hour", "last_hour")
    met = placed.join(departures.drop("stop_id"), ["day_class", "pattern_id", "pos", "hour"])
    first = F.filter("leaves", lambda x: x["at"] >= F.col("ready"))
    found = met.withColumn("trip", F.coalesce(F.get(first, F.lit(0))["trip"], "later")).where("trip is not null")
    return found.drop("leaves", "later", "hour").select("*", "trip.trip_id", "trip.dep").drop("trip")


def _walked(labels: DataFrame, table: Timetable, config: RouteConfig, ends: DataFrame | None) -> DataFrame:
    """The labels, none of them a walk, and the walks from them."""
    placed = labels.join(table.stops.select("stop_id", "hops"), "stop_id")
    hops = F.coalesce("hops", F.array().cast("array<struct<to_stop:string,duration:bigint,same_stop:bigint>>"))
    if config.max_walk is not None:
        hops = F.filter(hops, lambda h: h["duration"] <= config.max_walk)
    stay = F.struct(F.lit(None).cast("string").alias("to_stop"), F.lit(0).cast("long").alias("duration"), F.lit(0).cast("long").alias("same_stop"))
    each = placed.withColumn("hop", F.explode(F.concat(F.array(stay), hops)))
    walks = F.col("hop.to_stop").isNotNull()
    arrives = F.col("t") + F.col("hop.duration")
    leg = F.struct(
        F.lit(WALK).alias("kind"),
        F.lit(None).alias("pattern_id"),
        F.lit(None).alias("trip_id"),
        F.lit(None).alias("service_date"),
        F.col("stop_id").alias("from_stop"),
        F.col("hop.to_stop").alias("to_stop"),
        F.col("t").alias("dep"),
        arrives.alias("arr"),
    ).cast(LEG)
    out = each.select(
        "query_id",
        "date",
        "moment",
        "round",
        F.coalesce("hop.to_stop", "stop_id").alias("stop_id"),
        F.when(walks, F.lit(WALK)).otherwise(F.col("kind")).alias("kind"),
        arrives.alias("t"),
        F.when(walks, arrives - F.col("hop.same_stop")).otherwise(F.col("cmp_t")).alias("cmp_t"),
        "start",
        (F.col("n_legs") + walks.cast("int")).alias("n_legs"),
        F.when(walks, F.array_append("legs", leg)).otherwise(F.col("legs")).alias("legs"),
    )
    if ends is None or config.walk_at_target:
        return out
    at_end = ends.select("query_id", "stop_id", F.lit(True).alias("ends"))
    marked = out.join(at_end, ["query_id", "stop_id"], "left")
    return marked.where((F.col("kind") != WALK) | F.col("ends").isNull()).select(*LABEL)


def _first_per_stop(labels: DataFrame) -> DataFrame:
    order = F.struct("cmp_t", "kind", (-F.col("start")).alias("late"), "n_legs", "legs", "round", "t", "date")
    best = labels.groupBy("query_id", "moment", "stop_id").agg(F.min(order).alias("b"))
    return best.select(
        "query_id", "b.date", "moment", "b.round", "stop_id", "b.kind", "b.t", "b.cmp_t", (-F.col("b.late")).alias("start"), "b.n_legs", "b.legs"
    )


def _later_moments(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("moment"))


def _undominated(labels: DataFrame) -> DataFrame:
    """Labels of one round that better those of all later moments at their stop."""
    later = F.min(F.struct("cmp_t", "kind")).over(_later_moments("query_id", "stop_id").rowsBetween(Window.unboundedPreceding, -1))
    met = labels.withColumn("later", later)
    return met.where(F.col("later").isNull() | (F.struct("cmp_t", "kind") < F.col("later"))).select(*LABEL)


def _bounds(best: DataFrame, ends: DataFrame, moments: DataFrame | None) -> DataFrame:
    """(query_id, moment, bound): the earliest known end, of a profile search over that moment and the later ones."""
    known = best.join(ends, ["query_id", "stop_id"]).groupBy("query_id", "moment").agg(F.min(F.col("known") + F.col("walk")).alias("bound"))
    if moments is None:
        return known
    sofar = F.min("bound").over(_later_moments("query_id").rowsBetween(Window.unboundedPreceding, 0))
    return moments.join(known, ["query_id", "moment"], "left").withColumn("bound", sofar)


def _within(labels: DataFrame, best: DataFrame, limit: DataFrame | None, bound: DataFrame | None, profile: bool) -> DataFrame:
    """Labels that better their stop, and keep to the time limit and the best known end."""
    if profile:  # what is known of a stop at any later moment counts too
        beside = labels.select(*LABEL, F.lit(None).cast("long").alias("mark")).unionByName(
            best.withColumnRenamed("known", "mark"), allowMissingColumns=True
        )
        known = F.min("mark").over(_later_moments("query_id", "stop_id").rangeBetween(Window.unboundedPreceding, 0))
        met = beside.withColumn("known", known).where("mark is null").drop("mark")
    else:
        met = labels.join(best, ["query_id", "moment", "stop_id"], "left")
    met = met.where(F.col("known").isNull() | (F.col("cmp_t") < F.col("known")))
    if limit is not None:
        met = met.join(limit, ["query_id", "moment"]).where(F.col("t") <= F.col("limit"))
    if bound is not None:
        met = met.join(bound, ["query_id", "moment"], "left").where(F.col("bound").isNull() | (F.col("cmp_t") <= F.col("bound")))
    return met.select(*LABEL)


def pareto(search: Search, targets: DataFrame) -> DataFrame:
    """Labels at the targets that arrive earlier than every one of fewer rides.

    Of a profile search, those that arrive earlier than every one of as many
    or fewer rides of a later moment too. Returns LABEL columns and end_t, the
    arrival with the target's walk.
    """
    ends = search.labels.where(F.col("kind") != START).join(targets.select("query_id", "stop_id", "walk"), ["query_id", "stop_id"])
    timed = ends.withColumn("end_t", F.col("t") + F.col("walk"))
    order = F.struct("end_t", (-F.col("start")).alias("late"), "n_legs", "stop_id", "kind", "t", "cmp_t", "start", "legs", "date")
    per_round = timed.groupBy("query_id", "moment", "round").agg(F.min(order).alias("b"))
    flat = per_round.select(
        "query_id", "b.date", "moment", "round", "b.stop_id", "b.kind", "b.t", "b.cmp_t", "b.start", "b.n_legs", "b.legs", "b.end_t"
    )
    fewer = Window.partitionBy("query_id", "moment").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    kept = _earlier_than(flat, F.min("end_t").over(fewer))
    if search.profile:
        later = _later_moments("query_id").rangeBetween(Window.unboundedPreceding, -1)
        leasts = [F.min(F.when(F.col("round") <= r, F.col("end_t"))).over(later) for r in range(search.rounds + 1)]
        kept = _earlier_than(kept, F.get(F.array(*leasts), F.col("round")))
    return kept


def _earlier_than(ends: DataFrame, least: Column) -> DataFrame:
    met = ends.withColumn("least", least)
    return met.where(F.col("least").isNull() | (F.col("end_t") < F.col("least"))).drop("least")


def isolines(search: Search) -> DataFrame:
    """The best label of every reached stop per query and moment; starts are left out."""
    order = F.struct("cmp_t", "round", *[c for c in LABEL if c not in ("query_id", "moment", "stop_id", "cmp_t", "round")])
    best = search.labels.groupBy("query_id", "moment", "stop_id").agg(F.min(order).alias("b"), F.max(F.col("kind") == START).alias("is_start"))
    return best.where(~F.col("is_start")).select("query_id", "moment", "stop_id", *[f"b.{c}" for c in LABEL if c not in ("query_id", "moment", "stop_id")])


def whole_ways(best: DataFrame, search: Search) -> DataFrame:
    """The chosen labels with all legs of their ways: round by round the label at the first leg's start is put before."""
    earlier = search.labels.select(
        "query_id", "moment", F.col("round").alias("before_round"), F.col("stop_id").alias("first_stop"), F.col("legs").alias("before")
    )
    ways = best.withColumns({"before_round": F.col("round") - 1, "first_stop": F.get("legs", F.lit(0))["from_stop"]})
    for _ in range(search.rounds):
        legs = F.concat(F.coalesce("before", F.array().cast(f"array<{LEG}>")), "legs")
        ways = ways.join(earlier, ["query_id", "moment", "before_round", "first_stop"], "left").withColumn("legs", legs).drop("before")
        ways = ways.withColumns({"before_round": F.col("before_round") - 1, "first_stop": F.get("legs", F.lit(0))["from_stop"]})
    return ways.drop("before_round", "first_stop")


def unmirrored(labels: DataFrame) -> DataFrame:
    """Labels of a mirrored search with times and directions as they are."""

    def turned(leg: Column) -> Column:
        return F.struct(
            leg["kind"].alias("kind"),
            leg["pattern_id"].alias("pattern_id"),
            leg["trip_id"].alias("trip_id"),
            leg["service_date"].alias("service_date"),
            leg["to_stop"].alias("from_stop"),
            leg["from_stop"].alias("to_stop"),
            (-leg["arr"]).alias("dep"),
            (-leg["dep"]).alias("arr"),
        )

    return labels.withColumns({"t": -F.col("t"), "cmp_t": -F.col("cmp_t"), "legs": F.reverse(F.transform("legs", turned))})
