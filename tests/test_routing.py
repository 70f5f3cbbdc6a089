import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.operators.journeys import broken_ways
from tramline.operators.network import ScheduleError, build_network
from tramline.operators.raptor import RouteConfig, route
from tramline.operators.routing import (
    InvalidRequest, connections, departures_in, latest_equal_start, profile_connections, reachable, shortest_over_arrivals, shortest_over_window,
    within_window,
)

from .networks import HOUR, MINUTE, PATHS, PAUSE, TOWN, clock, ends, moments, planner, random_town, slow_labels, stop_rows


@pytest.fixture(scope="module")
def town(spark):
    return planner(spark, stop_rows(), PATHS)


@pytest.fixture(scope="module")
def wild(spark):
    """(planner, rows, paths) of a random town."""
    rows, paths = random_town(4)
    return planner(spark, rows, paths), rows, paths


def questions(rows, n=24):
    """{query: (stop, t)} spread over stops and minutes."""
    stops = sorted({r[2] for r in rows})
    return {f"q{i}": (stops[i * 5 % len(stops)], 6 * HOUR + i * 1117 % (3 * HOUR)) for i in range(n)}


def pair(rows):
    """Two stops of different lines."""
    first = {}
    for _, line, stop, _, _ in rows:
        first.setdefault(line.split("-")[0], stop)
    return sorted(set(first.values()))[:2]


def as_table(labels):
    return sorted((r["query_id"], r["round"], r["stop_id"], r["kind"], r["t"]) for r in labels.collect())


@pytest.mark.parametrize(
    "config",
    [RouteConfig(max_transfers=3), RouteConfig(max_transfers=2, min_transfer=200, max_walk=6 * MINUTE), RouteConfig()],
)
def test_labels_equal_a_plain_search(spark, wild, config):
    plan, rows, paths = wild
    asked = questions(rows)
    starts = spark.createDataFrame([(q, s, t) for q, (s, t) in asked.items()], "query_id string, stop_id string, t long")
    rides = 12 if config.max_transfers is None else config.max_transfers + 1
    wanted = sorted(
        (q, k, stop, kind, t)
        for q, (s, at) in asked.items()
        for (k, stop), (kind, t) in slow_labels(rows, paths, {s: at}, rides, PAUSE, config.min_transfer, config.max_walk).items()
    )
    assert as_table(route(starts, plan.timetable(), config).labels) == wanted


def test_backward_is_the_mirror(spark, wild):
    plan, rows, paths = wild
    asked = {q: (s, t + HOUR) for q, (s, t) in questions(rows, 12).items()}
    turned = [(trip, line, stop, -dep, -arr) for trip, line, stop, arr, dep in reversed(rows)]
    starts = spark.createDataFrame([(q, s, -t) for q, (s, t) in asked.items()], "query_id string, stop_id string, t long")
    wanted = sorted((q, k, stop, kind, t) for q, (s, at) in asked.items() for (k, stop), (kind, t) in slow_labels(turned, paths, {s: -at}, 3).items())
    assert as_table(route(starts, plan.timetable(backward=True), RouteConfig(max_transfers=2)).labels) == wanted


def test_ways_are_whole_and_pareto(spark, wild):
    """Each way's legs join up, and its rounds and ends are those of the plain search."""
    plan, rows, paths = wild
    asked = questions(rows, 16)
    stops = sorted({r[2] for r in rows})
    goal = {q: stops[(stops.index(s) + 3) % len(stops)] for q, (s, _) in asked.items()}
    found = connections(
        plan, moments(spark, {q: t for q, (_, t) in asked.items()}), ends(spark, [(q, s) for q, (s, _) in asked.items()]),
        ends(spark, goal.items()), RouteConfig(max_transfers=3),
    )
    ways = found.collect()
    assert broken_ways(found).count() == 0
    got, wanted = {}, {}
    for r in ways:
        assert r["from_stop"] == asked[r["query_id"]][0] and r["to_stop"] == goal[r["query_id"]] and r["n_rides"] <= 4
        got.setdefault(r["query_id"], []).append((r["round"], r["arrival"]))
    for q, (s, t) in asked.items():
        least = 10**9
        for (k, stop), (kind, at) in sorted(slow_labels(rows, paths, {s: t}, 4).items()):
            if stop == goal[q] and kind != "START" and at < least:
                wanted.setdefault(q, []).append((k, at))
                least = at
    assert {q: sorted(v) for q, v in got.items()} == wanted


def plain_ways(source, goal, at, rides=4, longest=None):
    """(rides, arrival) of the plain search in the town, each arriving earlier than those of fewer rides."""
    least, out = 10**9, []
    for (k, stop), (kind, t) in sorted(slow_labels(stop_rows(), PATHS, {source: at}, rides, longest=longest).items()):
        if stop == goal and kind != "START" and t < least:
            out.append((k, clock(t)))
            least = t
    return out


@pytest.mark.parametrize("pair", [("gate", "farm"), ("beach", "fort")])
def test_bounds(spark, town, pair):
    asked, source, goal = moments(spark, {"q": 8 * HOUR}), ends(spark, [("q", pair[0])]), ends(spark, [("q", pair[1])])

    def shapes(config):
        return sorted((r["n_rides"], clock(r["arrival"])) for r in connections(town, asked, source, goal, config).collect())

    free = shapes(RouteConfig())
    assert free == plain_ways(*pair, 8 * HOUR) and len(free) == 2
    assert shapes(RouteConfig(max_walk=2 * MINUTE)) == plain_ways(*pair, 8 * HOUR, longest=2 * MINUTE)
    assert shapes(RouteConfig(max_transfers=1)) == [x for x in free if x[0] <= 2]
    assert shapes(RouteConfig(max_transfers=0)) == [x for x in free if x[0] <= 1]
    assert shapes(RouteConfig(max_travel=10 * MINUTE)) == []


def test_no_walk_at_the_ends(spark, town):
    asked = moments(spark, {"q": 8 * HOUR})
    near = connections(town, asked, ends(spark, [("q", "park")]), ends(spark, [("q", "hill")]), RouteConfig()).collect()
    assert [(r["n_rides"], r["seconds"]) for r in near if r["round"] == 0] == [(0, 7 * MINUTE)]
    for config in (RouteConfig(walk_at_source=False), RouteConfig(walk_at_target=False)):
        far = connections(town, asked, ends(spark, [("q", "park")]), ends(spark, [("q", "hill")]), config).collect()
        assert far and all(r["n_rides"] > 0 for r in far)
    with pytest.raises(InvalidRequest):
        connections(town, asked, ends(spark, [("q", "park")]), ends(spark, [("q", "park")]), RouteConfig())


def test_walks_at_the_ends_of_a_way(spark):
    line = {"a": (["w", "x", "y", "z"], 0, 5, 60)}
    far = planner(spark, stop_rows(line), {("y", "z"): 9, ("w", "x"): 2})
    asked = moments(spark, {"q1": 7 * HOUR + 60, "q2": 7 * HOUR - 10 * MINUTE})
    rows = connections(far, asked, ends(spark, [("q1", "w"), ("q2", "w")]), ends(spark, [("q1", "z"), ("q2", "z")]), RouteConfig()).collect()
    # the trip of 07:00 is left a minute ago: 2 minutes to x are done before it departs there at 07:06
    late = [r for r in rows if r["query_id"] == "q1"][0]
    assert (late["n_walks"], clock(late["departure"]), clock(late["arrival"])) == (1, "07:04", "07:17")
    # where the trip itself calls at w and z no walk is made
    early = [r for r in rows if r["query_id"] == "q2"][0]
    assert (early["n_walks"], clock(early["departure"]), clock(early["arrival"])) == (0, "07:00", "07:17")


def test_days_and_zones(spark):
    line = {"night": (["w", "x"], 0, 10, 60)}
    ask = moments(spark, {"late": 23 * HOUR + 30 * MINUTE, "early": 30 * MINUTE}), ends(spark, [("late", "w"), ("early", "w")]), ends(spark, [("late", "x"), ("early", "x")])

    def departures(**how):
        plan = planner(spark, stop_rows(line, (5, 26)), {}, **how)
        return {r["query_id"]: clock(r["departure"]) for r in connections(plan, *ask, RouteConfig()).collect()}

    assert departures() == {"late": "24:00", "early": "05:00"}
    assert departures(days=3) == {"late": "24:00", "early": "01:00"}  # the day before runs until 25:00
    # clocks go forward in Paris on 2025-03-30 at 01:00 UTC: 05:00 there is 03:00 UTC
    assert departures(zone="Europe/Paris", date=dt.date(2025, 3, 30))["early"] == "03:00"


def test_window_equals_a_search_every_minute(spark, wild):
    plan, rows, _ = wild
    (source, goal), at, window = pair(rows), 7 * HOUR, 45 * MINUTE
    config = RouteConfig(max_transfers=2)
    found = within_window(plan, moments(spark, {"q": at}), ends(spark, [("q", source)]), ends(spark, [("q", goal)]), config, window)
    each = {str(t): t for t in range(at, at + window, MINUTE)}
    every = connections(plan, moments(spark, each), ends(spark, [(q, source) for q in each]), ends(spark, [(q, goal) for q in each]), config)
    wanted = {(r["departure"], r["arrival"], str(r["legs"])) for r in every.collect() if r["departure"] < at + window}
    got = [(r["departure"], r["arrival"], str(r["legs"])) for r in found.collect()]
    assert len(got) > 2 and sorted(got) == sorted(wanted)
    quick = within_window(plan, moments(spark, {"q": at}), ends(spark, [("q", source)]), ends(spark, [("q", goal)]), config, window, max_travel=20 * MINUTE)
    assert all(r["seconds"] <= 20 * MINUTE for r in quick.collect())


def test_window_by_arrival_equals_a_search_every_minute(spark, wild):
    plan, rows, _ = wild
    (source, goal), at, window = pair(rows), 9 * HOUR, 45 * MINUTE
    config = RouteConfig(max_transfers=2)
    found = within_window(plan, moments(spark, {"q": at}), ends(spark, [("q", source)]), ends(spark, [("q", goal)]), config, window, backward=True)
    each = {str(t): t for t in range(at - window + MINUTE, at + 1, MINUTE)}
    every = connections(plan, moments(spark, each), ends(spark, [(q, source) for q in each]), ends(spark, [(q, goal) for q in each]), config, backward=True)

    def key(r):  # a last walk may start at any time after the ride
        return r["departure"], str([x for x in r["legs"] if x["kind"] == "RIDE"])

    wanted = {key(r) for r in every.collect() if r["arrival"] > at - window}
    assert len(wanted) > 2 and {key(r) for r in found.collect()} == wanted


def front(ways):
    """(rides, departure, arrival) that no other one dominates."""
    return sorted(
        w for w in set(ways)
        if not any(x != w and x[0] <= w[0] and x[1] >= w[1] and x[2] <= w[2] for x in ways)
    )


def test_profile_is_the_front_of_a_search_every_minute(spark, wild):
    plan, rows, paths = wild
    asked = {"a": (pair(rows), 7 * HOUR), "b": (("stop01", "stop05"), 6 * HOUR + 20 * MINUTE), "c": (("stop09", "stop02"), 8 * HOUR)}
    window, config = 60 * MINUTE, RouteConfig(max_transfers=2)
    found = profile_connections(
        plan, moments(spark, {q: t for q, (_, t) in asked.items()}), ends(spark, [(q, a) for q, ((a, _), _) in asked.items()]),
        ends(spark, [(q, b) for q, ((_, b), _) in asked.items()]), config, window,
    )
    assert broken_ways(found).count() == 0
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["round"], r["departure"], r["arrival"]))
    for q, ((a, b), at) in asked.items():
        every = []
        for t in range(at, at + window, MINUTE):
            for (k, stop), (kind, end) in slow_labels(rows, paths, {a: t}, 3).items():
                if stop == b and kind != "START":
                    every.append((k, t, end))
        # of the last minute the plain search's ways may wait beyond the window
        wanted = front(every)
        last = [w for w in wanted if w[1] == at + window - MINUTE]
        inside = [w for w in got.get(q, []) if w[1] < at + window - MINUTE and not any(x[0] <= w[0] and x[2] <= w[2] for x in last)]
        assert sorted(inside) == [w for w in wanted if w not in last]
    assert sum(map(len, got.values())) > 6


def test_profile_by_arrival_is_the_mirror(spark, wild):
    plan, rows, paths = wild
    (a, b), by, window = pair(rows), 9 * HOUR, 60 * MINUTE
    found = profile_connections(plan, moments(spark, {"q": by}), ends(spark, [("q", a)]), ends(spark, [("q", b)]), RouteConfig(max_transfers=2), window, backward=True)
    turned = [(trip, line, stop, -dep, -arr) for trip, line, stop, arr, dep in reversed(rows)]
    every = []
    for t in range(by, by - window, -MINUTE):
        for (k, stop), (kind, end) in slow_labels(turned, paths, {b: -t}, 3).items():
            if stop == a and kind != "START":
                every.append((k, -end, t))
    # at the first minute the plain search's ways may end before the window
    got, wanted, edge = [(r["round"], r["departure"], r["arrival"]) for r in found.collect()], front(every), by - window + MINUTE
    last = [w for w in wanted if w[2] == edge]
    inside = [w for w in got if w[2] > edge and not any(x[0] <= w[0] and x[1] >= w[1] for x in last)]
    assert len(inside) > 2 and sorted(inside) == [w for w in wanted if w not in last]


def test_profile_labels_fall_with_the_window(spark, wild):
    """Labels per departure get fewer as the window grows, where a search per departure has as many for each."""
    plan, rows, _ = wild
    per_departure = []
    for window in (10 * MINUTE, 60 * MINUTE, 150 * MINUTE):
        query, source = moments(spark, {"q": 6 * HOUR}), ends(spark, [("q", "stop03")])
        at = departures_in(plan, query, source, window)
        starts = source.join(at, "query_id").select("query_id", "date", "stop_id", "t", F.col("t").alias("moment"))
        found = route(starts, plan.timetable(), RouteConfig(max_transfers=2), profile=True)
        per_departure.append(found.labels.where("round > 0").count() / at.count())
    assert per_departure[0] > per_departure[1] > 0.9 * per_departure[2]


def test_mixed_dates_in_one_search(spark):
    """A batch over dates equals a planner for each date; equal days share a timetable."""
    rows = stop_rows({"day": (["w", "x", "y"], 0, 10, 60), "night": (["y", "z"], 5, 8, 60)}, (5, 26))
    days = [dt.date(2025, 3, 5), dt.date(2025, 3, 6), dt.date(2025, 3, 29), dt.date(2025, 3, 30), dt.date(2025, 7, 1)]
    plan = planner(spark, rows, {}, days=3, zone="Europe/Paris")
    batch = type(plan)(plan.schedule, plan.network, days[0], 3, dates=tuple(days))
    every = [(f"{d}-{h}", d, h * HOUR + 30 * MINUTE) for d in days for h in (0, 3, 12, 23)]
    asked = spark.createDataFrame(every, "query_id string, date date, t long")
    source, goal = ends(spark, [(q, "w") for q, _, _ in every]), ends(spark, [(q, "z") for q, _, _ in every])
    config = RouteConfig(max_transfers=2)

    def told(found):
        return sorted((r["query_id"], r["round"], r["departure"], r["arrival"], str(r["legs"])) for r in found.collect())

    wanted = []
    for day in days:
        own = asked.where(F.col("date") == F.lit(day)).drop("date")
        wanted += told(connections(type(plan)(plan.schedule, plan.network, day, 3), own, source.join(own.select("query_id"), "query_id"), goal.join(own.select("query_id"), "query_id"), config))
    assert told(connections(batch, asked, source, goal, config)) == sorted(wanted) and len(wanted) > 15
    assert batch.timetable().times.select("day_class").distinct().count() == 2  # winter and summer time
    winter, again, summer = (type(plan)(plan.schedule, plan.network, dt.date(2025, *d), 3, store=batch.store) for d in ((1, 20), (2, 10), (3, 31)))
    times = winter.timetable().times
    assert times.count() == summer.timetable().times.count() == batch.timetable().times.count() / 2
    written = len(batch.store)
    assert again.timetable().times is times and len(batch.store) == written


def test_start_put_off(spark, town):
    asked, source, goal = moments(spark, {"q": 8 * HOUR}), ends(spark, [("q", "gate")]), ends(spark, [("q", "dock")])
    at_once = connections(town, asked, source, goal, RouteConfig(max_transfers=0)).collect()
    later = latest_equal_start(town, asked, source, goal, RouteConfig(max_transfers=0), 10 * MINUTE).collect()
    assert [clock(r["arrival"]) for r in at_once] == [clock(r["arrival"]) for r in later] and later[0]["departure"] >= at_once[0]["departure"]


def test_shortest_over_windows_equal_every_minute(spark, wild):
    plan, _, _ = wild
    config, window, walk = RouteConfig(max_transfers=1), 30 * MINUTE, 90
    at, by = 7 * HOUR, 9 * HOUR
    forth = {r["stop_id"]: (r["seconds"], r["departure"]) for r in shortest_over_window(plan, moments(spark, {"q": at}), ends(spark, [("q", "stop03", walk)]), config, window).collect()}
    back = {r["stop_id"]: (r["seconds"], r["arrival"]) for r in shortest_over_arrivals(plan, moments(spark, {"q": by}), ends(spark, [("q", "stop03", walk)]), config, window).collect()}
    each = {str(t): t for t in range(at, at + window, 30)}
    best = {}
    for r in reachable(plan, moments(spark, each), ends(spark, [(q, "stop03", walk) for q in each]), config).collect():
        start = r["departure"] - walk
        if at <= start < at + window:
            best[r["stop_id"]] = min(best.get(r["stop_id"], (10**9, 0)), (r["arrival"] - start, start))
    assert len(forth) > 3 and forth == best
    each = {str(t): t for t in range(by - window + 30, by + 1, 30)}
    best = {}
    for r in reachable(plan, moments(spark, each), ends(spark, [(q, "stop03", walk) for q in each]), config, backward=True).collect():
        end = r["arrival"] + walk
        if by - window < end <= by:
            best[r["stop_id"]] = min(best.get(r["stop_id"], (10**9, 0)), (end - r["departure"], -end))
    assert len(back) > 3 and back == {s: (seconds, -end) for s, (seconds, end) in best.items()}


def test_no_query_and_no_stop(spark, town):
    none = spark.createDataFrame([], "query_id string, t long")
    assert reachable(town, none, ends(spark, [("q", "gate")]), RouteConfig()).count() == 0
    assert reachable(town, moments(spark, {"q": 0}), ends(spark, [("q", "nowhere")]), RouteConfig()).count() == 0


def test_many_rides_without_a_bound(spark):
    """A chain of one-hop lines needs as many rides; nothing cuts the search off."""
    chain = {f"l{i:02d}": ([f"s{i:02d}", f"s{i + 1:02d}"], i % 10, 1, 10) for i in range(28)}
    rows = [r for r in stop_rows(chain, (6, 13)) if "-out-" in r[0]]
    plan = planner(spark, rows, {})
    starts = spark.createDataFrame([("q", "s00", 6 * HOUR)], "query_id string, stop_id string, t long")
    assert route(starts, plan.timetable(), RouteConfig()).labels.agg(F.max("round")).first()[0] == 28


def test_bad_networks(spark):
    rows = stop_rows({"ring": TOWN["ring"]}, (6, 7))
    with pytest.raises(ScheduleError):
        planner(spark, [(a, b, c, arr - (7200 if c == "park" else 0), dep) for a, b, c, arr, dep in rows], {})
    good = planner(spark, rows, {})
    with pytest.raises(ScheduleError):
        build_network(good.schedule, spark.createDataFrame([("park", "dock", -5)], "from_stop string, to_stop string, duration int"))
    empty = type(good.schedule)(**{**good.schedule.tables(), "stop_times": good.schedule.stop_times.limit(0)})
    with pytest.raises(ScheduleError):
        build_network(empty)


@pytest.mark.parametrize("backward", [False, True])
def test_trips_at_the_times_of_others_do_not_grow_the_timetable(spark, backward):
    """Of trips of a service that leave a place at one time only the first is ever boarded, so the rest isn't stored for searches."""
    rows = stop_rows(hours=(6, 9))
    copies = [(f"{trip}-{x}", *rest) for x in "yz" for trip, *rest in rows]
    once, often = (planner(spark, r, PATHS) for r in (rows, rows + copies))
    assert often.network.trip_times.count() == 3 * len(rows)
    tables = [p.timetable(backward) for p in (once, often)]
    for name in ("times", "places", "departures"):
        assert len({getattr(t, name).count() for t in tables}) == 1
    asked, end = moments(spark, {"q": 7 * HOUR}), ends(spark, [("q", "gate")])
    found = [
        sorted((r["stop_id"], r["round"], r["departure"], r["arrival"]) for r in reachable(p, asked, end, RouteConfig(max_transfers=2), backward).collect())
        for p in (once, often)
    ]
    assert found[0] == found[1] and len(found[0]) > 5
