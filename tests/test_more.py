import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.operators import answers, builder, requests, stops
from tramline.operators.network import build_network
from tramline.operators.raptor import RouteConfig, route
from tramline.operators.routing import Planner, connections
from tramline.sources.feeds import ArchiveFeed, FolderFeed, TablesFeed, feed_of
from tramline.sources.gtfs import ScheduleError, from_rows, read_schedule

from .networks import DATE, HOUR, MINUTE, PAUSE, ends, moments, random_town, slow_labels, stop_rows
from .test_sources import FEED

ASKED = "query_id string, from_stop string, from_lat double, from_lon double, to_stop string, to_lat double, to_lon double, at timestamp, max_walk int, bikes boolean"
NOON = dt.datetime(2025, 3, 5, 12)


def test_requests_are_split_with_reasons(spark):
    good = ("a", None, None, "b", None, None, NOON, 5, False)
    cases = {
        "ok": (good, []),
        "points": ((None, 1.0, 2.0, None, 1.0, 2.5, NOON, None, None), []),
        "nothing": ((None, 1.0, None, "b", None, None, NOON, 5, False), ["from_missing"]),
        "both": (("a", 1.0, None, "b", None, None, NOON, 5, False), ["from_ambiguous"]),
        "far": ((None, 91.0, 0.0, None, float("nan"), 0.0, NOON, 5, False), ["from_coordinate", "to_coordinate"]),
        "lost": (("x", None, None, "y", None, None, NOON, 5, False), ["from_unknown", "to_unknown"]),
        "same": (("a", None, None, "a", None, None, NOON, 5, False), ["same_place"]),
        "here": ((None, 1.0, 2.0, None, 1.0, 2.0, NOON, 5, False), ["same_place"]),
        "early": (("a", None, None, "b", None, None, dt.datetime(2024, 12, 31, 23, 59), 5, False), ["outside_validity"]),
        "last": (("a", None, None, "b", None, None, dt.datetime(2025, 12, 31, 23, 59), 5, False), []),
        "never": (("a", None, None, "b", None, None, None, -1, True), ["negative_max_walk", "no_time", "unsupported_bikes"]),
        None: (good, ["no_id"]),
    }
    rows = [(name, *row) for name, (row, _) in cases.items()] + [("twice", *good), ("twice", *good)]
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "stop_id string")
    table = spark.createDataFrame(rows, ASKED)
    judged = requests.judged(table, known, dt.date(2025, 1, 1), dt.date(2025, 12, 31), {"bikes": False})
    found = [(r["query_id"], r["reasons"]) for r in judged.collect()]
    assert sorted(found, key=str) == sorted([(n, why) for n, (_, why) in cases.items()] + [("twice", ["repeated_id"])] * 2, key=str)
    answered, refused = requests.split(judged)
    assert {r["query_id"] for r in answered.collect()} == {"ok", "points", "last"} and answered.columns == table.columns
    assert refused.count() == len(rows) - 3
    assert requests.judged(table.limit(0), known, dt.date(2025, 1, 1), dt.date(2025, 12, 31)).collect() == []


def test_starts_of_a_batch(spark):
    net = spark.createDataFrame([("a", 0), ("b", 0)], "stop_id string, same_stop int")
    rows = [("ok", "a", 100), ("ok", "x", 50), ("ok", "b", 70), ("lost", "x", 1), ("apart", "a", 0), ("apart", "b", 86401), ("day", "a", 0), ("day", "b", 86400)]
    starts = spark.createDataFrame([*rows, ("null", "a", None)], "query_id string, stop_id string, t long")
    kept, refused = requests.checked_starts(starts, net)
    assert {(r["query_id"], r["stop_id"], r["t"], r["reference"]) for r in kept.collect()} == {
        ("ok", "a", 100, 50), ("ok", "b", 70, 50), ("day", "a", 0, 0), ("day", "b", 86400, 0),
    }
    assert {r["query_id"]: r["reasons"] for r in refused.collect()} == {"lost": ["no_stops"], "apart": ["times_apart"], "null": ["no_time"]}
    late, _ = requests.checked_starts(starts, net, backward=True)
    assert {r["reference"] for r in late.where("query_id = 'ok'").collect()} == {100}


def plain(spark, rows, paths, **changes):
    """Plain tables of rows as stop_rows() gives."""
    seqs, at = {}, {}
    for trip, line, stop, arr, dep in rows:
        at.setdefault((line, trip), []).append((stop, arr, dep))
    for (line, _), calls in at.items():
        seqs[line] = [c[0] for c in calls]
    made = {
        "stops": ([(s,) for s in sorted({r[2] for r in rows})], "stop_id string"),
        "routes": ([(r,) for r in seqs], "route_id string"),
        "route_stops": ([(r, i, s) for r, seq in seqs.items() for i, s in enumerate(seq)], "route_id string, pos int, stop_id string"),
        "trips": ([k for k in at], "route_id string, trip_id string"),
        "stop_times": ([(*k, i, *c) for k, calls in at.items() for i, c in enumerate(calls)], "route_id string, trip_id string, pos int, stop_id string, arr int, dep int"),
        "transfers": ([(a, b, m * MINUTE) for (x, y), m in paths.items() for a, b in ((x, y), (y, x))], "from_stop string, to_stop string, duration int"),
    }
    return builder.PlainTables(**{k: spark.createDataFrame(changes.get(k, lambda rows: rows)(v[0]), v[1]) for k, v in made.items()})


def test_plain_network_routes_like_a_plain_search(spark):
    rows, paths = random_town(9)
    used = {r[2] for r in rows}
    paths = {k: v for k, v in paths.items() if k[0] in used and k[1] in used}
    network = builder.build_plain(plain(spark, rows, paths), PAUSE)
    starts = {f"q{i}": (sorted(used)[i], 6 * HOUR + i * 700) for i in range(8)}
    asked = spark.createDataFrame([(q, s, t) for q, (s, t) in starts.items()], "query_id string, stop_id string, t long")
    found = route(asked, builder.plain_timetable(network, DATE), RouteConfig(max_transfers=2)).labels
    wanted = {(q, k, s, kind, t) for q, (a, at) in starts.items() for (k, s), (kind, t) in slow_labels(rows, paths, {a: at}, 3).items()}
    assert {(r["query_id"], r["round"], r["stop_id"], r["kind"], r["t"]) for r in found.collect()} == wanted


LINES = {"l": (["u", "v", "w"], 0, 5, 60)}


@pytest.mark.parametrize(
    "breach, changes",
    [
        ("repeated_stop", {"stops": lambda r: r + r[:1]}),
        ("repeated_route", {"routes": lambda r: r + r[:1]}),
        ("repeated_trip", {"trips": lambda r: r + r[:1]}),
        ("repeated_time", {"stop_times": lambda r: r + r[:1]}),
        ("repeated_route_stop", {"route_stops": lambda r: r + r[:1]}),
        ("unknown_stop", {"stops": lambda r: r[1:]}),
        ("unknown_stop", {"transfers": lambda r: [("u", "nowhere", 5)]}),
        ("unknown_route", {"trips": lambda r: [*r, ("none", "t")]}),
        ("unknown_trip", {"stop_times": lambda r: [*r, (r[0][0], "t", 0, r[0][3], 1, 1)]}),
        ("position_gap", {"route_stops": lambda r: [(a, p + (p == 2), s) for a, p, s in r]}),
        ("no_such_position", {"stop_times": lambda r: [*r, (*r[0][:2], 9, "u", 10**6, 10**6)]}),
        ("other_stop", {"stop_times": lambda r: [(*r[0][:3], "w", *r[0][4:]), *r[1:]]}),
        ("missing_time", {"stop_times": lambda r: r[1:]}),
        ("no_time", {"stop_times": lambda r: [(*r[0][:4], None, 0), *r[1:]]}),
        ("departs_before_arrival", {"stop_times": lambda r: [(*r[0][:5], r[0][4] - 1), *r[1:]]}),
        ("arrives_before_departure", {"stop_times": lambda r: [(*x[:4], x[4] - 9999 * (x[2] == 1), x[5]) for x in r]}),
        ("negative_transfer", {"transfers": lambda r: [("u", "v", -1)]}),
    ],
)
def test_each_breach_is_told(spark, breach, changes):
    tables = plain(spark, stop_rows(LINES, (6, 8)), {}, **changes)
    assert breach in {r["breach"] for r in builder.breaches(tables).collect()}


def test_breaches_stop_the_build(spark):
    good = plain(spark, stop_rows(LINES, (6, 8)), {})
    assert builder.breaches(good).collect() == []
    with pytest.raises(ScheduleError):
        builder.build_plain(plain(spark, stop_rows(LINES, (6, 8)), {}, stops=lambda r: r[1:]))
    with pytest.raises(ScheduleError):
        builder.build_plain(good, -1)


def test_folder_archive_and_tables_are_one(spark, tmp_path):
    folder, archive = tmp_path / "feed", tmp_path / "feed.zip"
    folder.mkdir()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for name, text in FEED.items():
            (folder / f"{name}.txt").write_text(text, encoding="utf-8")
            packed.writestr(f"{name}.txt", text)
        packed.writestr("inner/stops.txt", "no")
    assert isinstance(feed_of(str(folder)), FolderFeed) and isinstance(feed_of(str(archive)), ArchiveFeed)
    own = TablesFeed(lambda s, name: FolderFeed(str(folder)).table(s, name))
    read = [read_schedule(spark, x) for x in (str(folder), str(archive), f"file://{archive}", own)]

    def rows(schedule):
        return {n: sorted(map(str, df.drop("row_id").collect())) for n, df in (schedule.tables() | schedule.rejected).items()}

    assert all(rows(x) == rows(read[0]) for x in read[1:])
    assert ArchiveFeed(str(archive)).table(spark, "frequencies") is None
    both = spark.read.format("schedule_archive").option("table", "calendar_dates,calendar_dates").load(str(archive))
    assert both.rdd.getNumPartitions() == 2 and both.count() == 6


def test_long_entries_are_streamed_in_order(spark, tmp_path):
    archive, n = tmp_path / "long.zip", 60_000
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("stops.txt", 'stop_id,stop_name\r\n' + "".join(f'{i}," a ""b"", {i} "\r\n' for i in range(n)) + "short\r\n\r\n")
    found = ArchiveFeed(str(archive)).table(spark, "stops").withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert [r["stop_id"] for r in found] == [*map(str, range(n)), "short"]
    assert found[7]["stop_name"] == 'a "b", 7' and found[-1]["stop_name"] is None


@pytest.fixture(scope="module")
def border(spark):
    """A train in Paris time, a walk, and a bus in London time."""
    rows = [("train", "t", "p", "pont", 8, 8), ("train", "t", "p", "port", 9, 9), ("coach", "c", "l", "dock", 10, 10), ("coach", "c", "l", "dome", 11, 11)]
    schedule = from_rows(
        spark,
        agency=[("p", "P", "", "Europe/Paris"), ("l", "L", "", "Europe/London")],
        calendar=[("daily", *[True] * 7, dt.date(2025, 1, 1), dt.date(2025, 12, 31))],
        stops=[(s, s.title(), 50.1234567 + i, 1.0, None, 0) for i, s in enumerate(["pont", "port", "dock", "dome"])],
        routes=[("t", "p", "T", "Train line", 2), ("c", "l", "C", "", 3)],
        trips=[("train", "t", "daily", "North", 1, 0), ("coach", "c", "daily", None, 2, 1)],
        stop_times=[(i, r[0], r[3], r[4] * HOUR, r[5] * HOUR) for i, r in enumerate(rows)],
        transfers=[("port", "dock", 2, 300)],
    )
    plan = Planner(schedule, build_network(schedule), DATE)
    ways = connections(plan, moments(spark, {"q": 6 * HOUR}), ends(spark, [("q", "pont")]), ends(spark, [("q", "dome")]), RouteConfig())
    return schedule, ways


def test_clock_times_of_legs(border):
    schedule, ways = border
    legs = answers.local_legs(ways, schedule, F.lit(DATE), ["query_id", "round"]).orderBy("nth").collect()
    assert [(x["departure_at"], x["arrival_at"]) for x in legs] == [
        ("2025-03-05T08:00:00+01:00", "2025-03-05T09:00:00+01:00"),
        ("2025-03-05T09:00:00+01:00", "2025-03-05T08:05:00+00:00"),
        ("2025-03-05T10:00:00+00:00", "2025-03-05T11:00:00+00:00"),
    ]
    alone = ways.withColumn("legs", F.slice("legs", 2, 1))
    walk = answers.local_legs(alone, schedule, F.lit(DATE), ["query_id", "round"], "Asia/Tokyo").first()
    assert (walk["departure_zone"], walk["arrival_zone"], walk["departure_at"]) == ("Asia/Tokyo", "Asia/Tokyo", "2025-03-05T17:00:00+09:00")
    first = ways.withColumn("legs", F.slice("legs", 2, 2))
    walk = answers.local_legs(first, schedule, F.lit(DATE), ["query_id", "round"]).orderBy("nth").first()
    assert (walk["departure_zone"], walk["arrival_zone"]) == ("Europe/London", "Europe/London")


def test_nested_answers(border):
    schedule, ways = border
    for detailed in (True, False):
        row = answers.nested(ways, schedule, F.lit(DATE), ["query_id", "round"], detailed).select(F.to_json(F.struct("*")).alias("j")).first()
        told = json.loads(row["j"])
        assert (told["departure"], told["arrival"], told["transfers"]) == ("2025-03-05T08:00:00+01:00", "2025-03-05T11:00:00+00:00", 1)
        assert [x["type"] for x in told["legs"]] == ["ROUTE", "WALK", "ROUTE"] and "trip" not in told["legs"][1]
        train, coach = told["legs"][0]["trip"], told["legs"][2]["trip"]
        assert train["route"] == {"id": "t", "name": "Train line", "shortName": "T", "mode": "RAIL"} and train["headSign"] == "North"
        assert train["wheelchairAccessible"] and not train["bikesAllowed"] and "headSign" not in coach and "name" not in coach["route"]
        assert told["legs"][0]["from"] == {"latitude": 50.123457, "longitude": 1.0} and told["legs"][1]["toStop"]["name"] == "Dock"
        assert ("stopTimes" in train) == detailed
        if detailed:
            assert [(c["stop"]["id"], c["departureTime"]) for c in train["stopTimes"]] == [("pont", "2025-03-05T08:00:00+01:00"), ("port", "2025-03-05T09:00:00+01:00")]


def test_order_of_coordinates_with_ties(spark):
    rng = random.Random(2)
    spots = [(rng.choice([0.0, 0.009996, 0.01, -0.000004, 5.0]) + rng.randrange(4) * 0.000006, rng.randrange(9) * 0.000007 - 0.00003) for _ in range(150)]
    spots += [(None, 1.0), (float("nan"), 1.0), spots[0]]
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "i int, lat double, lon double").withColumn("lat_extra", F.lit(1))

    def chain(values):
        out, band = {}, -1
        for before, x in zip([None, *sorted(values)], sorted(values), strict=False):
            band += before is None or x - before > 1e-5
            out[x] = band
        return out

    usable = {p for p in spots if p[0] is not None and p[0] == p[0]}
    lats = chain({a for a, _ in usable})
    lons = {band: chain({b for a, b in usable if lats[a] == band}) for band in set(lats.values())}
    found = {r["i"]: (r["lat_band"], r["lon_band"]) for r in stops.banded_order(places).collect()}
    assert found == {i: (lats[p[0]], lons[lats[p[0]]][p[1]]) if p in usable else (None, None) for i, p in enumerate(spots)}
    assert len(lats) > len(set(lats.values())) > 2


def test_planar_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    spots = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(120)] + [(0.0, 0.0), (3.0, 4.0), (None, 1.0), (float("inf"), 0.0), (float("nan"), 0.0)]
    made = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, x double, y double")
    left, right = (made.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y")]) for s in ("left", "right"))
    wanted = {
        (i, j) for i, (a, b) in enumerate(spots[:122]) for j, (c, d) in enumerate(spots[:122]) if ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 5
    }
    found = stops.planar_pairs(left, right, 5.0).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == wanted and len(found) == len(wanted) and (120, 121) in wanted
    with pytest.raises(ValueError):
        stops.planar_pairs(left, right, 0)

