"""The service's questions as functions that return DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.codes import MODES
from .operators import boards, requests, routing, services, stops
from .operators.network import Network, build_network
from .operators.raptor import RouteConfig
from .operators.routing import InvalidRequest, Planner
from .sources.gtfs import Schedule
from .storage import materialize


class NotFound(LookupError):
    """Something asked for by id that isn't in the schedule."""


class NotActive(LookupError):
    """A trip that doesn't run on the day asked for."""


Place = str | tuple[float, float]


@dataclass(frozen=True)
class ServiceConfig:
    """days is how many service days a search scans; distances in metres, times in seconds."""

    days: int = 3
    same_stop: int = 120
    walk_radius: float = 500.0
    walk_speed: float = 1.4
    walk_minimum: int = 120
    access: int = 15
    between_stops: int = 180

    def __post_init__(self) -> None:
        if self.days < 1 or self.walk_radius <= 0 or self.walk_speed <= 0:
            raise InvalidRequest("days, walk_radius and walk_speed must be positive")
        if min(self.same_stop, self.walk_minimum, self.access) < 0 or self.between_stops < -1:
            raise InvalidRequest("times must not be negative")


@dataclass(frozen=True)
class QueryConfig:
    """Bounds and filters of one query; None means no bound, no modes means all.

    With profile, of a window only the ways that no other one dominates are answered.
    """

    window: int = 0
    max_walk: int | None = None
    max_transfers: int | None = None
    max_travel: int | None = None
    min_transfer: int = 0
    wheelchair: bool = False
    bikes: bool = False
    modes: Sequence[str] = ()
    profile: bool = False

    def __post_init__(self) -> None:
        bounds = [x for x in (self.max_walk, self.max_transfers, self.max_travel) if x is not None]
        if min([self.window, self.min_transfer, *bounds]) < 0:
            raise InvalidRequest("bounds must not be negative")
        if set(self.modes) - set(MODES.values()):
            raise InvalidRequest(f"unknown travel modes: {sorted(set(self.modes) - set(MODES.values()))}")

    def filters(self) -> dict:
        every = set(self.modes) == set(MODES.values())
        return {"modes": () if every else tuple(self.modes), "wheelchair": self.wheelchair, "bikes": self.bikes}


@dataclass
class TransitService:
    """Looking up and routing on one schedule. between_stops -1 makes no walks between stops."""

    schedule: Schedule
    config: ServiceConfig = field(default_factory=ServiceConfig)
    network: Network = None
    _span: list = field(default_factory=list, repr=False)
    _planners: dict = field(default_factory=dict, repr=False)
    _store: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.network is None:
            made, c = [], self.config
            if c.between_stops >= 0:
                made = [stops.walk_transfers(self.schedule.stops, c.walk_radius, c.walk_speed, c.between_stops, c.access)]
            self.network = build_network(self.schedule, *made, same_stop=c.same_stop)

    def describe(self) -> DataFrame:
        """Validity and what the schedule has information about."""
        return services.validity(self.schedule).join(services.feature_flags(self.schedule))

    def autocomplete(self, text: str, how: str = "contains", relevance: bool = False, limit: int = 10) -> DataFrame:
        order = stops.by_relevance(text) if relevance else stops.alphabetical()
        return stops.search(self.schedule.stops, text, how).orderBy(*order).limit(limit)

    def nearest(self, lat: float, lon: float, radius: float = 1000.0, limit: int = 10) -> DataFrame:
        return stops.nearest_roots(self._point(lat, lon, "here"), self.schedule.stops, radius, limit)

    def stop(self, stop_id: str) -> DataFrame:
        return self._one(self.schedule.stops, "stop_id", stop_id)

    def route(self, route_id: str) -> DataFrame:
        return self._one(self.schedule.routes, "route_id", route_id)

    def trip(self, trip_id: str, date: dt.date) -> DataFrame:
        found = self._one(self.schedule.trips, "trip_id", trip_id)
        days = found.sparkSession.createDataFrame([(date,)], "date date")
        if services.active_trips(self.schedule, days).where(F.col("trip_id") == trip_id).isEmpty():
            raise NotActive(f"trip {trip_id} doesn't run on {date}")
        return found

    def board(
        self, stop_id: str, start: dt.datetime, end: dt.datetime | None = None, kind: str = "departure",
        scope: str = "children", limit: int = 10,
    ) -> DataFrame:
        """Times at a stop from start, six hours by default."""
        self.stop(stop_id)
        self._check_date(start.date())
        asked = self.schedule.stops.sparkSession.createDataFrame([(stop_id,)], "asked_id string")
        wanted = stops.scope(asked, self.schedule.stops, scope, self.config.walk_radius)
        return boards.station_board(self.schedule, wanted, start, end or start + dt.timedelta(hours=6), kind, limit)

    def connections(
        self, source: Place, target: Place, when: dt.datetime, query: QueryConfig | None = None, arrive: bool = False
    ) -> DataFrame:
        """Ways between stops or (lat, lon) points, leaving at or arriving by an instant in UTC.

        A stop stands for itself and its direct children. A stop that nothing
        serves counts as its coordinates. Sorted by departure, or by falling
        arrival.
        """
        query = query or QueryConfig()
        if source == target:
            raise InvalidRequest("source and target are the same")
        plan, asked = self._plan(when, query)
        sources, from_stop = self._ends(plan, source, query)
        targets, to_stop = self._ends(plan, target, query)
        bounds = RouteConfig(query.max_transfers, query.min_transfer, query.max_walk, None, from_stop, to_stop)
        if arrive:
            bounds = RouteConfig(query.max_transfers, query.min_transfer, query.max_walk, None, to_stop, from_stop)
        search = routing.profile_connections if query.profile and query.window else routing.within_window
        found = search(plan, asked, sources, targets, bounds, query.window, arrive, query.max_travel)
        return found.orderBy(F.desc("arrival") if arrive else F.asc("departure"))

    def isolines(self, source: Place, when: dt.datetime, query: QueryConfig | None = None, arrive: bool = False) -> DataFrame:
        """The best way to every reachable stop (arrive: from every stop); with a window the quickest ones."""
        query = query or QueryConfig()
        plan, asked = self._plan(when, query)
        sources, from_stop = self._ends(plan, source, query)
        bounds = RouteConfig(query.max_transfers, query.min_transfer, query.max_walk, query.max_travel, from_stop, True)
        if query.window and arrive:
            return routing.shortest_over_arrivals(plan, asked, sources, bounds, query.window)
        if query.window:
            return routing.shortest_over_window(plan, asked, sources, bounds, query.window)
        found = routing.reachable(plan, asked, sources, bounds, arrive)
        named = found.join(self.schedule.stops.select("stop_id", "stop_name"), "stop_id")
        return named.orderBy(F.desc("departure") if arrive else F.asc("arrival"), "stop_name", "stop_id")

    def answer(self, asked: DataFrame, query: QueryConfig | None = None, arrive: bool = False) -> tuple[DataFrame, DataFrame]:
        """Ways for a batch of requests of any dates, and the requests that are refused, with reasons.

        asked is as requests.judged() takes it, with at the instant to leave at
        or to arrive by. A bad request doesn't fail the batch. Besides the
        reasons there, a request is refused as same_stop if its places have a
        stop in common. Ways are those of connections(), with query_id and
        date, the day whose 00:00 UTC their seconds count from. Requests of all
        dates go into one search for each kind of ends (stop or point).
        """
        query = query or QueryConfig()
        self._check_span()
        info = services.feature_flags(self.schedule).first()
        judged = requests.judged(asked, self.schedule.stops, *self._span, {"wheelchair": info["has_accessibility"], "bikes": info["has_bikes"]})
        good, refused = requests.split(judged)
        good = materialize(good.withColumn("date", F.to_date("at")), "requests")
        dates = sorted(r["date"] for r in good.select("date").distinct().collect())  # days of the schedule's validity at most
        plan = self._planner(dates[0] if dates else self._span[0], query, *dates)
        ends = {side: materialize(self._batch_ends(plan, good, side, query), "ends") for side in requests.SIDES}
        shared = ends["from"].join(ends["to"].select("query_id", "stop_id"), ["query_id", "stop_id"]).select("query_id").distinct()
        same = good.join(shared, "query_id", "left_semi").drop("date").withColumn("reasons", F.array(F.lit("same_stop")))
        zero = F.unix_timestamp(F.col("date").cast("timestamp"))
        times = good.join(shared, "query_id", "left_anti").select("query_id", "date", (F.unix_timestamp("at") - zero).alias("t"))
        kinds = [ends[s].groupBy("query_id").agg(F.first("is_stop").alias(f"{s}_is_stop")) for s in requests.SIDES]
        times = materialize(times.join(kinds[0], "query_id").join(kinds[1], "query_id"), "requests")
        found = []
        for a, b in ((True, True), (True, False), (False, True), (False, False)):
            some = times.where((F.col("from_is_stop") == a) & (F.col("to_is_stop") == b))
            near, far = (a, b) if not arrive else (b, a)
            bounds = RouteConfig(query.max_transfers, query.min_transfer, query.max_walk, None, near, far)
            sides = [ends[s].join(some.select("query_id"), "query_id", "left_semi").select("query_id", "stop_id", "walk") for s in requests.SIDES]
            if not some.isEmpty():
                found.append(routing.within_window(plan, some, *sides, bounds, query.window, arrive, query.max_travel))
        none = routing.connections(plan, times.limit(0), *[e.limit(0).select("query_id", "stop_id", "walk") for e in ends.values()], RouteConfig(0))
        ways = reduce(DataFrame.unionByName, found or [none])
        return ways.join(times.select("query_id", "date"), "query_id"), refused.unionByName(same)

    def _batch_ends(self, plan: Planner, good: DataFrame, side: str, query: QueryConfig) -> DataFrame:
        """(query_id, stop_id, walk, is_stop) of one side of all requests; stops that nothing serves count as their coordinates."""
        stop = F.col(f"{side}_stop")
        named = good.where(stop.isNotNull()).select("query_id", stop.alias("asked"))
        served = plan.station_ends(named).join(self.network.net_stops.select("stop_id"), "stop_id", "left_semi")
        served = materialize(served.select("query_id", "stop_id", "walk", F.lit(True).alias("is_stop")), "ends")
        places = self.schedule.stops.select(F.col("stop_id").alias("asked"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
        lost = named.join(served, "query_id", "left_anti").join(places, "asked").select("query_id", "lat", "lon")
        points = good.where(stop.isNull()).select("query_id", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
        near = plan.point_ends(points.unionByName(lost), self.config.walk_radius, self.config.access, query.max_walk)
        return served.unionByName(near.withColumn("is_stop", F.lit(False)))

    def _plan(self, when: dt.datetime, query: QueryConfig) -> tuple[Planner, DataFrame]:
        date = when.date()
        self._check_date(date)
        seconds = int((when - dt.datetime.combine(date, dt.time(), when.tzinfo)).total_seconds())
        asked = self.schedule.stops.sparkSession.createDataFrame([("q", seconds)], "query_id string, t long")
        return self._planner(date, query), asked

    def _planner(self, date: dt.date, query: QueryConfig, *dates: dt.date) -> Planner:
        """One planner for the same dates and filters; all share what is written for days of one class."""
        filters = query.filters()
        key = (date, dates, *sorted((k, str(v)) for k, v in filters.items()))
        if key not in self._planners:
            self._planners[key] = Planner(self.schedule, self.network, date, self.config.days, filters, dates=dates, store=self._store)
        return self._planners[key]

    def _check_date(self, date: dt.date) -> None:
        """Dates from the schedule's first to its last are valid, both included."""
        self._check_span()
        first, last = self._span
        if first is None or not first <= date <= last:
            raise InvalidRequest(f"{date} lies outside the schedule's validity, {first} to {last}")

    def _check_span(self) -> None:
        if not self._span:
            row = services.validity(self.schedule).first()
            self._span += [row["start_date"], row["end_date"]]

    def _ends(self, plan: Planner, place: Place, query: QueryConfig) -> tuple[DataFrame, bool]:
        """(query_id, stop_id, walk) and whether the place is a stop of the network."""
        if isinstance(place, str):
            row = self.stop(place).first()
            asked = self.schedule.stops.sparkSession.createDataFrame([("q", place)], "query_id string, asked string")
            ends = plan.station_ends(asked).join(self.network.net_stops.select("stop_id"), "stop_id", "left_semi")
            if not ends.isEmpty():
                return ends, True
            place = (row["stop_lat"], row["stop_lon"])
        lat, lon = place
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise InvalidRequest(f"no such place: {lat}, {lon}")
        point = self._point(lat, lon, "q").withColumnRenamed("location_id", "query_id")
        return plan.point_ends(point, self.config.walk_radius, self.config.access, query.max_walk), False

    def _point(self, lat: float, lon: float, name: str) -> DataFrame:
        return self.schedule.stops.sparkSession.createDataFrame([(name, lat, lon)], "location_id string, lat double, lon double")

    @staticmethod
    def _one(df: DataFrame, key: str, value: str) -> DataFrame:
        found = df.where(F.col(key) == value)
        if found.isEmpty():
            raise NotFound(f"{key} {value}")
        return found
