"""One query per transit operator on the bridged schedule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import basic_type, travel_mode
from ..functions.geo import rounded
from ..functions.times import clock_seconds, day_offset, format_service_time, parse_service_time
from ..operators import boards, journeys, network, raptor, routing, services, stops
from ..operators.raptor import RouteConfig
from ..sources.gtfs import Schedule, row_positions
from ..sources.sinks import as_json, timing_summary
from ..storage import is_there, materialize
from .bridge import DATE, schedule_of

Query = Callable[[SparkSession, str], DataFrame]

RADIUS = 500.0
MORNING = dt.datetime(2024, 1, 10, 7)
EVENING = dt.datetime(2024, 1, 10, 9)
#: query number: (source stop, target stop, departure in hours UTC)
ASKED = {1: ("s1", "s9", 6), 2: ("s3", "s8", 8), 3: ("s6", "s2", 10), 4: ("s7", "s10", 12)}
#: Pairs of the benchmark sample.
SAMPLE = 1000
PROFILE_WINDOW = 3600
#: Dates of the sample of mixed dates.
DATES = [dt.date(2024, 1, 2) + dt.timedelta(days=5 * i) for i in range(20)]
#: Seconds of access to a stop from a coordinate, and a stop to go to.
ACCESS, GOAL = 15, "s9"
LOCATIONS = [("near", 47.0101, 8.0021), ("between", 47.0149, 8.0049), ("far", 48.5, 9.5)]


def dates(spark: SparkSession, first: dt.date, n: int) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))


def locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCATIONS, "location_id string, lat double, lon double")


def asked_stops(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "asked_id string")


def _january(spark: SparkSession) -> DataFrame:
    return dates(spark, dt.date(2024, 1, 1), 31)


def active_service_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.active_services(schedule_of(spark, sf_dir), _january(spark))


def _trips(spark: SparkSession, sf_dir: str, **filters: object) -> DataFrame:
    return services.active_trips(schedule_of(spark, sf_dir), dates(spark, DATE, 1), **filters)


def active_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir)


def mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir, modes=("TRAM", "RAIL"))


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir, wheelchair=True)


def bike_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir, bikes=True)


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.validity(schedule_of(spark, sf_dir))


def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.feature_flags(schedule_of(spark, sf_dir))


def service_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_key(schedule_of(spark, sf_dir), _january(spark))


def route_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("route_type")
    return schedule_of(spark, sf_dir).routes.select("route_id", basic_type(code).alias("basic_type"), travel_mode(code).alias("mode"))


def service_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting, reading back and the clock face of every departure."""
    text = format_service_time(F.col("departure"))
    return schedule_of(spark, sf_dir).stop_times.select(
        "row_id", text.alias("text"), parse_service_time(text).alias("seconds"), clock_seconds(F.col("departure")).alias("clock")
    )


def zone_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service-day zero of each agency on days around clock changes."""
    days = dates(spark, dt.date(2024, 3, 30), 3).unionByName(dates(spark, dt.date(2024, 10, 26), 3))
    agency = schedule_of(spark, sf_dir).agency
    return agency.join(days).select("agency_id", "date", day_offset(F.col("date"), F.col("agency_timezone")).alias("offset"))


def _board(spark: SparkSession, sf_dir: str, kind: str, scope: str, limit: int | None = 10) -> DataFrame:
    schedule = schedule_of(spark, sf_dir)
    wanted = stops.scope(asked_stops(spark, "s5", "s7"), schedule.stops, scope, RADIUS)
    return boards.station_board(schedule, wanted, MORNING, EVENING, kind, limit)


def board_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, "departure", "strict")


def board_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, "arrival", "strict", None)


def board_scope_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, "departure", "children")


def board_scope_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, "departure", "related")


def board_scope_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, "departure", "nearby")


def _search(spark: SparkSession, sf_dir: str, text: str, how: str) -> DataFrame:
    return stops.search(schedule_of(spark, sf_dir).stops, text, how).select("stop_id", "stop_name")


def stop_search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "00001", "contains")


def stop_search_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "SUPP", "starts")


def stop_search_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "5", "ends")


def stop_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "supplier#000000005", "exact")


def search_alphabetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "5", "contains").orderBy(*stops.alphabetical()).limit(10)


def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "0", "contains").orderBy(*stops.by_relevance("0")).limit(10)


def nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops.nearest(locations(spark), schedule_of(spark, sf_dir).stops, RADIUS)
    return found.withColumn("distance", rounded(F.col("distance")))


def nearest_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops.nearest_roots(locations(spark), schedule_of(spark, sf_dir).stops, RADIUS)
    return found.withColumn("distance", rounded(F.col("distance")))


def access_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops.access_stops(locations(spark), schedule_of(spark, sf_dir).stops, RADIUS)
    return found.withColumn("distance", rounded(F.col("distance")))


def walk_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.walk_transfers(schedule_of(spark, sf_dir).stops, RADIUS)


def stop_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.ancestors(schedule_of(spark, sf_dir).stops)


def stop_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.inherited_access(schedule_of(spark, sf_dir).stops)


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = network.trip_patterns(schedule_of(spark, sf_dir))
    return built.groupBy("pattern_id", "route_id", F.array_join("stops", ",").alias("stop_ids")).agg(F.count("*").alias("n_trips"))


def trip_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.build_network(schedule_of(spark, sf_dir)).pattern_trips.select("pattern_id", "trip_id", "trip_ord")


def trip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_positions(schedule_of(spark, sf_dir).stop_times).select("trip_id", "stop_id", "pos")


def connecting_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.connecting_hops(schedule_of(spark, sf_dir).stop_times)


def transfers_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = schedule_of(spark, sf_dir)
    served = materialize(schedule.stop_times.select("stop_id").distinct(), "served")
    walked = schedule.stops.join(served, "stop_id", "left_semi")  # walks of other stops are left out of the table
    return network.transfer_table(schedule, served, stops.walk_transfers(walked, RADIUS))


def stop_times_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(schedule_of(spark, sf_dir).stop_times)


def stops_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(schedule_of(spark, sf_dir).stops.select("stop_id", "stop_name", "parent_station"))


_PLANNERS: dict[tuple[str, str], routing.Planner] = {}


def planner_of(spark: SparkSession, sf_dir: str) -> routing.Planner:
    """One network per session and folder, written by the first query that needs it and read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANNERS or not is_there(_PLANNERS[key].network.net_stops):
        schedule = schedule_of(spark, sf_dir)
        _PLANNERS[key] = routing.Planner(schedule, network.build_network(schedule), DATE)
    return _PLANNERS[key]


def asked(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(query_id, t), sources and targets."""
    rows = [(f"q{i}", a, b, h * 3600) for i, (a, b, h) in ASKED.items()]
    every = spark.createDataFrame(rows, "query_id string, a string, b string, t long")
    zero = F.lit(0).cast("long").alias("walk")
    return every.select("query_id", "t"), every.select("query_id", F.col("a").alias("stop_id"), zero), every.select("query_id", F.col("b").alias("stop_id"), zero)


def _isolines(spark: SparkSession, sf_dir: str, rides: int) -> DataFrame:
    queries, sources, _ = asked(spark)
    found = routing.reachable(planner_of(spark, sf_dir), queries, sources, RouteConfig(max_transfers=rides - 1))
    return found.select("query_id", "stop_id", "round", F.col("arrival").alias("t"))


def earliest_arrival_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _isolines(spark, sf_dir, 1)


def isolines_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _isolines(spark, sf_dir, 3)


def latest_departure_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, targets = asked(spark)
    later = queries.select("query_id", (F.col("t") + 36_000).alias("t"))
    found = routing.reachable(planner_of(spark, sf_dir), later, targets, RouteConfig(max_transfers=1), backward=True)
    return found.select("query_id", "stop_id", "round", F.element_at("legs", 1)["dep"].alias("t"))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, targets = asked(spark)
    return routing.connections(planner_of(spark, sf_dir), queries, sources, targets, RouteConfig(max_transfers=2))


def pareto_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, targets = asked(spark)
    starts = sources.join(queries, "query_id").select("query_id", "stop_id", "t")
    found = raptor.route(starts, planner_of(spark, sf_dir).timetable(), RouteConfig(max_transfers=2), targets)
    return raptor.pareto(found, targets).select("query_id", "round", F.col("end_t").alias("t"))


def journey_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.leg_rows(_ways(spark, sf_dir), ["query_id", "round"])


def journey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ways(spark, sf_dir).drop("legs")


def timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's table for the four fixed questions."""
    every = [(str(i), a, b, h * 3600) for i, (a, b, h) in ASKED.items()]
    return _timed(spark, sf_dir, spark.createDataFrame(every, "query_id string, a string, b string, t long"))


def route_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's table for SAMPLE pairs of served stops over the day, in one search."""
    return _timed(spark, sf_dir, _sampled(spark, sf_dir))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, a, b, t): SAMPLE pairs of served stops and times of the day."""
    served = planner_of(spark, sf_dir).network.net_stops.select("stop_id")
    n = served.count()
    nth = served.select("stop_id", (F.row_number().over(Window.orderBy("stop_id")) - 1).alias("nth"))
    i = F.col("id")
    x, y = i * 7919 % n, (i * 7919 + 1 + i * 104_729 % (n - 1)) % n
    pairs = spark.range(SAMPLE).select(i.cast("string").alias("query_id"), x.alias("x"), y.alias("y"), (i * 15_485_863 % 86_400).alias("t"))
    named = pairs.join(nth.select(F.col("stop_id").alias("a"), F.col("nth").alias("x")), "x").join(nth.select(F.col("stop_id").alias("b"), F.col("nth").alias("y")), "y")
    return named.select("query_id", "a", "b", "t")


def _timed(spark: SparkSession, sf_dir: str, every: DataFrame) -> DataFrame:
    plan = planner_of(spark, sf_dir)
    zero = F.lit(0).cast("long").alias("walk")
    sources, targets = (every.select("query_id", F.col(c).alias("stop_id"), zero) for c in "ab")
    ways = routing.connections(plan, every.select("query_id", "t"), sources, targets, RouteConfig(max_transfers=2))
    return timing_summary(every, ways, plan.schedule.stops, DATE).withColumn("id", F.col("id").cast("long"))


def window_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, targets = asked(spark)
    plan = planner_of(spark, sf_dir)
    return routing.within_window(plan, queries, sources, targets, RouteConfig(max_transfers=1), 600).drop("legs")


def range_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, targets = asked(spark)
    plan = planner_of(spark, sf_dir)
    return routing.latest_equal_start(plan, queries, sources, targets, RouteConfig(max_transfers=1), 1800).drop("legs")


def shortest_isolines(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, _ = asked(spark)
    plan = planner_of(spark, sf_dir)
    return routing.shortest_over_window(plan, queries, sources, RouteConfig(max_transfers=1), 900).drop("legs")


def shortest_isolines_arrive(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, targets = asked(spark)
    later = queries.select("query_id", (F.col("t") + 36_000).alias("t"))
    plan = planner_of(spark, sf_dir)
    return routing.shortest_over_arrivals(plan, later, targets, RouteConfig(max_transfers=1), 900).drop("legs")


def profile_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways of an hour that no other one dominates, in one profile search."""
    queries, sources, targets = asked(spark)
    found = routing.profile_connections(planner_of(spark, sf_dir), queries, sources, targets, RouteConfig(max_transfers=1), PROFILE_WINDOW)
    return found.select("query_id", "round", "departure", "arrival")


def dated_planner(spark: SparkSession, sf_dir: str) -> routing.Planner:
    """The network of planner_of() for questions on DATES, each scanning the day before and after."""
    plan = planner_of(spark, sf_dir)
    return replace(plan, days=3, dates=tuple(DATES), _made={})


def dated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, date, a, b, t): SAMPLE pairs of served stops, dealt over DATES."""
    every = _sampled(spark, sf_dir)
    day = F.get(F.array(*map(F.lit, DATES)), (F.col("query_id").cast("int") % len(DATES)))
    return every.withColumn("date", day)


def pareto_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by number of rides for questions on many dates, over three service days each, in one search."""
    every, plan = dated_sample(spark, sf_dir), dated_planner(spark, sf_dir)
    targets = every.select("query_id", F.col("b").alias("stop_id"), F.lit(0).cast("long").alias("walk"))
    found = raptor.route(every.select("query_id", "date", F.col("a").alias("stop_id"), "t"), plan.timetable(), RouteConfig(max_transfers=1), targets)
    return raptor.pareto(found, targets).select("query_id", "date", "round", F.col("end_t").alias("t"))


def day_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day of the quarter the first one of its class, with which it shares a timetable."""
    classes = network.day_classes(schedule_of(spark, sf_dir), dates(spark, dt.date(2024, 1, 1), 91))
    first = classes.groupBy("day_class").agg(F.min("date").alias("first_date"))
    return classes.join(first, "day_class").select("date", "first_date")


def isolines_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best way from coordinates to every stop: walks to near stops, or to the nearest, come first."""
    plan = planner_of(spark, sf_dir)
    sources = plan.point_ends(locations(spark).withColumnRenamed("location_id", "query_id"), RADIUS, ACCESS, None)
    queries = locations(spark).select(F.col("location_id").alias("query_id"), F.lit(8 * 3600).cast("long").alias("t"))
    found = routing.reachable(plan, queries, sources, RouteConfig(max_transfers=1, walk_at_source=False))
    return found.select("query_id", "stop_id", "round", F.col("arrival").alias("t"))


def mile_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs from a coordinate to a stop, with the walk to the first stop as a leg; the stop itself is no start."""
    plan, asked_at = planner_of(spark, sf_dir), 8 * 3600
    sources = plan.point_ends(locations(spark).withColumnRenamed("location_id", "query_id"), RADIUS, ACCESS, None)
    sources = sources.where(F.col("stop_id") != GOAL)
    queries = locations(spark).select(F.col("location_id").alias("query_id"), F.lit(asked_at).cast("long").alias("t"))
    targets = queries.select("query_id", F.lit(GOAL).alias("stop_id"), F.lit(0).cast("long").alias("walk"))
    ways = routing.connections(plan, queries, sources, targets, RouteConfig(max_transfers=1, walk_at_source=False))
    return journeys.leg_rows(journeys.with_mile_legs(ways, 60), ["query_id", "round"]).select(
        "query_id", "round", "nth", "kind", "trip_id", "from_stop", "to_stop", "dep", "arr"
    )


def queries() -> dict[str, Query]:
    own = [
        active_service_dates, active_trips, mode_filter, access_filter, bike_filter, validity, feature_flags, service_keys,
        route_modes, service_times, zone_offsets, board_departures, board_arrivals, board_scope_children, board_scope_related,
        board_scope_nearby, stop_search_contains, stop_search_starts, stop_search_ends, stop_search_exact, search_alphabetical,
        search_relevance, nearest_stop, nearest_stops, access_stops, walk_transfers, stop_ancestors, stop_access, patterns,
        trip_order, trip_positions, connecting_hops, transfers_precedence, stop_times_json, stops_json, earliest_arrival_k1, isolines_k3,
        latest_departure_k2, pareto_k3, journey_legs, journey_counts, timing_table, route_sample, window_connections, range_k2, shortest_isolines,
        shortest_isolines_arrive, profile_connections, pareto_by_date, day_classes, isolines_from_points, mile_legs,
    ]
    return {f.__name__: f for f in own}
