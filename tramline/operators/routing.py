"""Connection and isoline queries on a schedule."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.gtfs import Schedule
from ..storage import materialize
from . import raptor
from .journeys import described, without_detour_walks, without_idle_start
from .network import ClassTables, Network, Timetable, class_tables, class_times, day_classes
from .raptor import RouteConfig
from .stops import access_stops, ancestors


class InvalidRequest(ValueError):
    """A query that can't be answered as asked."""


@dataclass(frozen=True)
class Planner:
    """A network on the service days around reference dates.

    date is that of queries without a column date; dates are those that
    queries may carry besides. days counts scanned service days: 1 is a
    query's date itself, more start with the day before. Times are seconds
    from the query's own date's 00:00 UTC. What a search reads is written at
    the first search in its direction and used by all later ones; days of one
    class share it, and so do planners that share a store.
    """

    schedule: Schedule
    network: Network
    date: dt.date
    days: int = 1
    filters: dict | None = None
    use_zones: bool = True
    dates: tuple[dt.date, ...] = ()
    store: dict = field(default_factory=dict, compare=False, repr=False)
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def timetable(self, backward: bool = False) -> Timetable:
        """The timetable, mirrored for backward searches."""
        if backward not in self._made:
            offsets = range(1) if self.days == 1 else range(-(self.days - 2), 1) if backward else range(-1, self.days - 1)
            spark = self.schedule.stops.sparkSession
            scanned = sorted({d + dt.timedelta(days=i) for d in (self.date, *self.dates) for i in offsets})
            asked = spark.createDataFrame([(d,) for d in scanned], "date date")
            # a row for each scanned day, which are parameters of the searches
            classes = {r["date"]: r["day_class"] for r in day_classes(self.schedule, asked, self.use_zones).collect()}
            tables = self._tables(classes, backward)
            calendar = spark.createDataFrame(sorted(classes.items()), "service_date date, day_class string")
            sign = -1 if backward else 1
            self._made[backward] = Timetable(
                tables.times, tables.places, tables.departures, tables.stops, calendar, tuple(offsets), sign, self.date
            )
        return self._made[backward]

    def _tables(self, classes: dict[dt.date, str], backward: bool) -> ClassTables:
        """The stored tables of the classes, in this direction."""
        first = {c: d for d, c in sorted(classes.items(), reverse=True)}
        chosen = tuple(sorted((k, str(v)) for k, v in (self.filters or {}).items()))
        key = (tuple(sorted(first)), chosen, self.use_zones, backward)
        if key not in self.store:
            rows = self.schedule.stops.sparkSession.createDataFrame(sorted(first.items()), "day_class string, date date")
            found = class_times(self.schedule, self.network, rows, self.use_zones, backward, **(self.filters or {}))
            times, network = materialize(found, "class-times", "day_class"), self.network
            if backward:
                times, network = raptor.mirrored(times, network)
            self.store[key] = class_tables(times, network)
        return self.store[key]

    def station_ends(self, asked: DataFrame) -> DataFrame:
        """(query_id, stop_id, walk 0): a stop and its direct children."""
        below = ancestors(self.schedule.stops).where("depth <= 1").select(F.col("ancestor").alias("asked"), "stop_id")
        return asked.join(below, "asked").select("query_id", "stop_id", F.lit(0).cast("long").alias("walk"))

    def point_ends(self, asked: DataFrame, radius: float, access: int, max_walk: int | None) -> DataFrame:
        """(query_id, stop_id, walk): stops near a point, or the nearest, with access seconds."""
        served = self.schedule.stops.join(self.network.net_stops, "stop_id", "left_semi")
        near = access_stops(asked.withColumnRenamed("query_id", "location_id"), served, radius, max_walk)
        return near.select(F.col("location_id").alias("query_id"), "stop_id", (F.col("walk") + access).alias("walk"))


def connections(
    planner: Planner, queries: DataFrame, sources: DataFrame, targets: DataFrame, config: RouteConfig, backward: bool = False
) -> DataFrame:
    """Pareto-optimal ways per query: fewer rides or less time.

    queries has query_id and t: the departure, or with backward the latest
    arrival. sources and targets have query_id, stop_id and walk seconds.
    Returns query_id, round, legs and described() columns; departure and
    arrival include the walks to the first and from the last stop.
    """
    if _both(sources, targets):
        raise InvalidRequest("a stop is source and target of one query")
    return _found(planner, _starts(queries, sources, targets, backward), sources, targets, config, backward)


def _found(
    planner: Planner,
    starts: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    config: RouteConfig,
    backward: bool,
    profile: bool = False,
    until: DataFrame | None = None,
) -> DataFrame:
    """The finished ways of a search from starts, as of connections()."""
    far = sources if backward else targets
    found = raptor.route(starts, planner.timetable(backward), config, far, profile, until)
    best = raptor.whole_ways(raptor.pareto(found, far), found)
    if backward:
        best = raptor.unmirrored(best)
    plain = materialize(best.select("query_id", "date", "round", "legs"), "ways")
    ways = without_idle_start(without_detour_walks(plain, planner.timetable(backward)))
    return _with_walks(described(ways.drop("date")), sources, targets)


def _starts(queries: DataFrame, sources: DataFrame, targets: DataFrame | None, backward: bool) -> DataFrame:
    """(query_id, stop_id, t), with date or moment if queries have them, on the axis of the search."""
    sign = -1 if backward else 1
    near = targets if backward else sources
    more = [c for c in ("date", "moment") if c in queries.columns]
    met = near.join(queries.select("query_id", "t", *more), "query_id")
    out = met.withColumn("t", F.col("t") * sign + F.col("walk"))
    return out.withColumn("moment", F.col("moment") * sign) if "moment" in more else out


def _both(sources: DataFrame, targets: DataFrame) -> bool:
    return not sources.join(targets.select("query_id", "stop_id"), ["query_id", "stop_id"], "left_semi").isEmpty()


def _with_walks(ways: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    ends = {
        "from_stop": (sources, F.element_at("legs", 1)["from_stop"], "walk_in"),
        "to_stop": (targets, F.element_at("legs", -1)["to_stop"], "walk_out"),
    }
    for column, (df, value, walk) in ends.items():
        walks = df.groupBy("query_id", F.col("stop_id").alias(column)).agg(F.min("walk").alias(walk))
        ways = ways.withColumn(column, value).join(walks, ["query_id", column], "left")
    start = F.col("departure") - F.coalesce("walk_in", F.lit(0))
    end = F.col("arrival") + F.coalesce("walk_out", F.lit(0))
    return ways.withColumns({"departure": start, "arrival": end}).withColumn("seconds", F.col("arrival") - F.col("departure"))


def within_window(
    planner: Planner,
    queries: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    config: RouteConfig,
    window: int = 0,
    backward: bool = False,
    max_travel: int | None = None,
) -> DataFrame:
    """connections() for every departure in [t, t + window), or arrival in (t - window, t].

    Between two departures from a query's sources nothing changes, so every
    departure in the window is a query row of one search, whatever the length
    of the window. A window of 0 is the query's own time. Travel time is
    bounded on the whole way, after the search. Equal ways count once. A way
    may be dominated by one of another departure; profile_connections() leaves
    such ways out and shares the work of all departures.
    """
    if window <= 0:
        found = connections(planner, queries, sources, targets, config, backward)
    else:
        rows = _rows(planner, queries, targets if backward else sources, window, backward)
        ways = _asked(connections(planner, _named(rows), _spread(sources, rows), _spread(targets, rows), config, backward), rows)
        found = _once_each(_inside(ways, queries, window, backward))
    return found if max_travel is None else found.where(F.col("seconds") <= max_travel)


def _rows(planner: Planner, queries: DataFrame, near: DataFrame, window: int, backward: bool) -> DataFrame:
    """(row_id, asked, date, t): each moment of a query's window as a query of its own, written."""
    moments = arrivals_in(planner, queries, near, window) if backward else departures_in(planner, queries, near, window)
    return materialize(moments.select(F.concat_ws("@", "query_id", "t").alias("row_id"), F.col("query_id").alias("asked"), "date", "t"), "moments")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("query_id"), "date", "t")


def _asked(found: DataFrame, rows: DataFrame) -> DataFrame:
    """What was found for rows, under the query they stand for."""
    names = rows.select(F.col("row_id").alias("query_id"), "asked")
    return found.join(names, "query_id").drop("query_id").withColumnRenamed("asked", "query_id")


def _spread(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """The ends of each query for all its rows."""
    met = ends.withColumnRenamed("query_id", "asked").join(rows.select("row_id", "asked"), "asked")
    return met.select(F.col("row_id").alias("query_id"), "stop_id", "walk")


def _inside(ways: DataFrame, queries: DataFrame, window: int, backward: bool) -> DataFrame:
    dated = ways.join(_first_times(queries), "query_id")
    edge = F.col("arrival") > F.col("t0") - window if backward else F.col("departure") < F.col("t0") + window
    return dated.where(edge).drop("t0")


def _once_each(ways: DataFrame) -> DataFrame:
    return ways.groupBy(*[c for c in ways.columns if c != "round"]).agg(F.min("round").alias("round"))


def profile_connections(
    planner: Planner,
    queries: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    config: RouteConfig,
    window: int,
    backward: bool = False,
    max_travel: int | None = None,
) -> DataFrame:
    """The ways of a window that no other one dominates, by a profile search.

    A way departs in [t, t + window), with backward arrives in (t - window, t].
    It stays unless another one of as many or fewer rides departs no earlier
    and arrives no later, and does one of the three better. Equal ways of
    other legs count once, the one of the fewest rides and first legs. Queries
    may have a column date. Returns the columns of connections().
    """
    if _both(sources, targets):
        raise InvalidRequest("a stop is source and target of one query")
    moments = _moments(planner, queries, targets if backward else sources, window, backward)
    starts = _starts(moments, sources, targets, backward)
    ways = _found(planner, starts, sources, targets, config, backward, True, _until(queries, window, backward))
    ways = _inside(ways, queries, window, backward)
    if max_travel is not None:
        ways = ways.where(F.col("seconds") <= max_travel)
    return undominated(ways)


def undominated(ways: DataFrame) -> DataFrame:
    """Ways (query_id, round, departure, arrival, legs) that no other one of their query dominates.

    Sorted by falling departure, then arrival, rounds and legs, a way is
    dominated if one before it, of as many rides or fewer, arrives as early.
    """
    rounds = [r["round"] for r in ways.select("round").distinct().collect()]  # as many as the search had rounds
    before = Window.partitionBy("query_id").orderBy(F.desc("departure"), "arrival", "round", "legs").rowsBetween(Window.unboundedPreceding, -1)
    least = [F.min(F.when(F.col("round") <= r, F.col("arrival"))).over(before) for r in range(max(rounds, default=0) + 1)]
    met = ways.withColumn("least", F.get(F.array(*least), F.col("round")))
    return met.where(F.col("least").isNull() | (F.col("arrival") < F.col("least"))).drop("least")


def _moments(planner: Planner, queries: DataFrame, near: DataFrame, window: int, backward: bool) -> DataFrame:
    """(query_id, date, t, moment): the times of a query's window that a profile search is for, written."""
    found = arrivals_in(planner, queries, near, window) if backward else departures_in(planner, queries, near, window)
    return materialize(found.withColumn("moment", F.col("t")), "moments")


def _until(queries: DataFrame, window: int, backward: bool) -> DataFrame:
    """(query_id, until): the end of each query's window on the axis of the search."""
    return queries.select("query_id", ((-F.col("t") if backward else F.col("t")) + window).alias("until"))


def _first_times(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("t").alias("t0"))


def reachable(
    planner: Planner, queries: DataFrame, sources: DataFrame, config: RouteConfig, backward: bool = False
) -> DataFrame:
    """The best way from (with backward: to) the sources to every stop, per query."""
    found = raptor.route(_starts(queries, sources, sources, backward), planner.timetable(backward), config)
    best = raptor.whole_ways(raptor.isolines(found), found)
    ways = raptor.unmirrored(best) if backward else best
    return described(without_idle_start(ways.select("query_id", "round", "stop_id", "legs")))


def departures_in(planner: Planner, queries: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(query_id, date, t): each query's own time and every departure of its source stops in [t, t + window).

    Rides that leave a source, or a stop within a walk of one, at such a time
    are the only ones that change the answer.
    """
    table = planner.timetable()
    first = sources.select("query_id", "stop_id", "walk")
    paths = planner.network.footpaths.select(F.col("from_stop").alias("stop_id"), "to_stop", "duration")
    walked = first.join(paths, "stop_id").select("query_id", F.col("to_stop").alias("stop_id"), (F.col("walk") + F.col("duration")).alias("walk"))
    asked = _dated(planner, queries)
    places = table.on_days(first.unionByName(walked).join(asked, "query_id"))
    leaves = places.join(_leaving(table), ["day_class", "stop_id"])
    at = leaves.withColumn("start", F.col("dep") + F.col("shift") - F.col("walk"))
    inside = at.where((F.col("start") >= F.col("t")) & (F.col("start") < F.col("t") + window))
    return asked.unionByName(inside.select("query_id", "date", F.col("start").alias("t"))).distinct()


def _leaving(table: Timetable) -> DataFrame:
    """(day_class, stop_id, dep): the times at which trips leave stops."""
    return table.times.where("pos < n_stops - 1").select("day_class", "stop_id", "dep").distinct()


def _dated(planner: Planner, queries: DataFrame) -> DataFrame:
    """(query_id, date, t) with the planner's date where queries have none."""
    date = F.col("date") if "date" in queries.columns else F.lit(planner.date).alias("date")
    return queries.select("query_id", date, F.col("t").cast("long").alias("t"))


def latest_equal_start(planner: Planner, queries: DataFrame, sources: DataFrame, targets: DataFrame, config: RouteConfig, window: int) -> DataFrame:
    """connections() of queries whose start may be put off by up to window seconds.

    Of all departures in the window, in one profile search, per query and
    number of rides the earliest arrival counts, then the latest departure,
    and a way stays if no way of fewer rides arrives as early.
    """
    moments = _moments(planner, queries, sources, window, False)
    found = _found(planner, _starts(moments, sources, targets, False), sources, targets, config, False, profile=True)
    order = Window.partitionBy("query_id", "round").orderBy("arrival", F.desc("departure"), "legs")
    best = found.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    before = F.min("arrival").over(Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("before", before).where(F.col("before").isNull() | (F.col("arrival") < F.col("before")))
    return kept.drop("nth", "before")


def shortest_over_window(planner: Planner, queries: DataFrame, sources: DataFrame, config: RouteConfig, window: int) -> DataFrame:
    """Per query and stop the way of least seconds over all departures in the window.

    Seconds count from the departure, walk to the first stop included; ties go
    to the earlier departure.
    """
    rows = _rows(planner, queries, sources, window, False)
    named = _asked(reachable(planner, _named(rows), _spread(sources, rows), config), rows).join(_first_times(queries), "query_id")
    walks = sources.groupBy("query_id", F.col("stop_id").alias("from_stop")).agg(F.min("walk").alias("walk_in"))
    begun = named.withColumn("from_stop", F.element_at("legs", 1)["from_stop"]).join(walks, ["query_id", "from_stop"])
    begun = begun.withColumn("departure", F.col("departure") - F.col("walk_in")).where(F.col("departure") < F.col("t0") + window)
    return _quickest(begun, F.col("departure"))


def arrivals_in(planner: Planner, queries: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """(query_id, date, t): each query's own time and every arrival at its target stops in (t - window, t].

    The mirror of departures_in().
    """
    table = planner.timetable(backward=True)
    last = targets.select("query_id", "stop_id", "walk")
    paths = planner.network.footpaths.select(F.col("to_stop").alias("stop_id"), "from_stop", "duration")
    walked = last.join(paths, "stop_id").select("query_id", F.col("from_stop").alias("stop_id"), (F.col("walk") + F.col("duration")).alias("walk"))
    asked = _dated(planner, queries)
    places = table.on_days(last.unionByName(walked).join(asked, "query_id"))
    comes = places.join(_leaving(table), ["day_class", "stop_id"])
    at = comes.withColumn("end", F.col("walk") - F.col("dep") - F.col("shift"))  # a mirrored departure is an arrival
    inside = at.where((F.col("end") <= F.col("t")) & (F.col("end") > F.col("t") - window))
    return asked.unionByName(inside.select("query_id", "date", F.col("end").alias("t"))).distinct()


def shortest_over_arrivals(planner: Planner, queries: DataFrame, targets: DataFrame, config: RouteConfig, window: int) -> DataFrame:
    """Per query and stop the way of least seconds to the targets over all arrivals in (t - window, t].

    Arrivals and seconds include the walk from the last stop; ties go to the later arrival.
    """
    rows = _rows(planner, queries, targets, window, True)
    named = _asked(reachable(planner, _named(rows), _spread(targets, rows), config, backward=True), rows).join(_first_times(queries), "query_id")
    walks = targets.groupBy("query_id", F.col("stop_id").alias("to_stop")).agg(F.min("walk").alias("walk_out"))
    ended = named.withColumn("to_stop", F.element_at("legs", -1)["to_stop"]).join(walks, ["query_id", "to_stop"])
    ended = ended.withColumn("arrival", F.col("arrival") + F.col("walk_out")).where(F.col("arrival") > F.col("t0") - window)
    return _quickest(ended, -F.col("arrival"))


def _quickest(ways: DataFrame, tie: Column) -> DataFrame:
    seconds = F.col("arrival") - F.col("departure")
    order = F.struct(seconds.alias("seconds"), tie.alias("tie"), "round", "departure", "arrival", "legs")
    best = ways.groupBy("query_id", "stop_id").agg(F.min(order).alias("b"))
    return best.select("query_id", "stop_id", "b.seconds", "b.departure", "b.arrival", "b.round", "b.legs")
