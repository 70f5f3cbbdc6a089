import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.functions.times import day_offset, format_service_time, parse_service_time
from tramline.operators import boards, services, stops
from tramline.sources.gtfs import ScheduleError, from_rows, locate, read_schedule
from tramline.sources.sinks import as_json, timing_summary, write_csv
from tramline.sources.snapshots import read_snapshot, write_snapshot

FEED = {
    "agency": "\ufeffagency_id,agency_name,agency_url,agency_timezone\na,Agency,http://a,Europe/Zurich\n",
    "calendar": "Service_ID,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    "wd,1,1,1,1,1,0,0,20240101,20241231\n",
    "calendar_dates": "service_id,date,exception_type\nwd,20240501,2\nonly,20240504,1\nwd,20240502,9\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,parent_station,extra\n"
    "p,Main,47.5,7.5,,x\n s1 , Main A ,47.5,7.5,p,\ns2,Hill,47.51,7.5,,\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr,a,1,One,700\n",
    "trips": "route_id,service_id,trip_id,wheelchair_accessible\nr,wd,t1,1\nr,only,t2,\nr,nobody,t3,0\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    "t1,8:00:00,8:00:00,s1,2\nt1,24:10:00,24:11:00,s2,1\nt2,09:00:00,,s1,1\nt3,09:00:00,09:00:00,s1,1\nt2,10:00,10:00:00,s2,1\nt2,10:00:00,10:00:00,s2,1\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\ns1,s2,2,300\ns2,s1,3,\n",
}


def feed(folder, **changes):
    folder.mkdir(exist_ok=True)
    for name, text in (FEED | changes).items():
        if text is not None:
            (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(folder)


def test_folder_and_zip(spark, tmp_path):
    folder = feed(tmp_path / "feed")
    archive = tmp_path / "feed.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for name, text in FEED.items():
            packed.writestr(f"{name}.txt", text)
        packed.writestr("../agency.txt", "no")
    for path in (folder, str(archive)):
        schedule = read_schedule(spark, path)
        assert schedule.agency.first()["agency_timezone"] == "Europe/Zurich"
        assert {r["stop_id"]: r["parent_station"] for r in schedule.stops.collect()} == {"p": None, "s1": "p", "s2": None}
        assert {r["trip_id"] for r in schedule.trips.collect()} == {"t1", "t2"}
        assert schedule.stop_times.count() == 3
        assert {n: df.count() for n, df in schedule.rejected.items()} == {"calendar_dates": 1, "trips": 1, "stop_times": 3}
    assert not (tmp_path / "agency.txt").exists()


@pytest.mark.parametrize(
    "changes",
    [
        {"stops": None},
        {"calendar": None, "calendar_dates": None},
        {"trips": "route_id,service_id,trip_id\n"},
        {"routes": FEED["routes"].replace("r,a", "r,b")},
        {"stops": FEED["stops"].replace(",p,\n", ",q,\n")},
        {"transfers": FEED["transfers"].replace("s1,s2", "s1,s9")},
        {"agency": FEED["agency"] + "a,Twice,,UTC\n"},
    ],
)
def test_bad_feeds(spark, tmp_path, changes):
    with pytest.raises(ScheduleError):
        read_schedule(spark, feed(tmp_path / "bad", **changes))


def test_places():
    assert locate("file:///x/y.zip") == "/x/y.zip"
    assert locate("s3://bucket/feed") == "s3a://bucket/feed"
    assert locate("https://host/a/feed.zip", "/stage") == "/stage/feed.zip"
    with pytest.raises(ScheduleError):
        locate("ftp://host/feed.zip")


def test_snapshots_and_sinks(spark, tmp_path):
    schedule = read_schedule(spark, feed(tmp_path / "feed"))
    for version in (1, 2):
        write_snapshot(schedule, str(tmp_path / "snapshots"), version)
    assert read_snapshot(spark, str(tmp_path / "snapshots")).stops.count() == 3
    write_csv(schedule.routes, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    assert as_json(schedule.stops.where("stop_id = 'p'").select("stop_id", "parent_station")).first()[0] == '{"stop_id":"p"}'
    asked = spark.createDataFrame([("a", "s1", "s2", 60), ("b", "s2", "s1", 60)], "query_id string, a string, b string, t long")
    ways = [("a", 61, 90, 29, 0), ("a", 70, 80, 10, 1)]
    ways = spark.createDataFrame(ways, "query_id string, departure long, arrival long, seconds long, n_transfers int")
    runs = {r["id"]: r for r in timing_summary(asked, ways, schedule.stops, dt.date(2024, 5, 1)).collect()}
    assert (runs["a"]["connections"], runs["a"]["earliest_arrival_time"], runs["a"]["min_duration"], runs["a"]["max_transfers"]) == (2, "2024-05-01T00:01:20", 10, 1)
    assert (runs["b"]["connections"], runs["b"]["earliest_departure_time"], runs["b"]["max_duration"]) == (0, "N/A", -1)
    assert abs(runs["a"]["beeline_distance"] - 1112) <= 1  # a hundredth of a degree of latitude


def test_times(spark):
    texts = ["00:00:00", "7:5:09", "25:00:01", "", None, "10:00", "x:00:00", "10:60:00"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_service_time(F.col("t"))).collect()]
    assert found == [0, 25509, 90001, None, None, None, None, None]
    assert spark.range(1).select(format_service_time(F.lit(90001))).first()[0] == "25:00:01"
    days = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 10, 27),)], "d date")
    assert [r[0] for r in days.select(day_offset(F.col("d"), F.lit("Europe/Zurich"))).collect()] == [-7200 - 0, -3600]


def test_services(spark, tmp_path):
    schedule = read_schedule(spark, feed(tmp_path / "feed"))
    days = spark.createDataFrame([(dt.date(2024, 5, d),) for d in (1, 3, 4, 6)], "date date")
    found = {(r["date"].day, r["service_id"]) for r in services.active_services(schedule, days).collect()}
    assert found == {(3, "wd"), (4, "only"), (6, "wd")}
    with pytest.raises(services.UnsupportedFeature):
        services.active_trips(schedule, days, bikes=True)


def test_board_looks_at_the_day_before(spark, tmp_path):
    schedule = read_schedule(spark, feed(tmp_path / "feed"))
    wanted = spark.createDataFrame([("s2", "s2")], "asked_id string, stop_id string")
    start = dt.datetime(2024, 5, 6, 22)  # midnight in Zurich
    found = boards.station_board(schedule, wanted, start, start + dt.timedelta(hours=1)).collect()
    assert [(r["trip_id"], r["service_date"], r["event_ts"]) for r in found] == [("t1", dt.date(2024, 5, 6), dt.datetime(2024, 5, 6, 22, 11))]
    assert boards.station_board(schedule, wanted, start, start).count() == 0
    with pytest.raises(ValueError):
        boards.station_board(schedule, wanted, start, start - dt.timedelta(hours=1))


def test_distances(spark):
    # on the equator a degree is 6371000 * pi / 180 = 111194.9 m along both axes
    rows = [("base", 0.0, 10.0), ("north", 0.003, 10.0), ("east", 0.0, 10.004), ("away", 0.0, 10.02)]
    schedule = from_rows(spark, stops=[(i, i, a, b, None, 0) for i, a, b in rows])
    found = {(r["from_stop"], r["to_stop"]): (r["distance"], r["duration"]) for r in stops.walk_transfers(schedule.stops).collect()}
    assert {k: v[0] for k, v in found.items() if k[0] == "base"} == {("base", "north"): 334, ("base", "east"): 445}
    assert {k[0] for k in found} == {"base", "north", "east"} and found["north", "base"] == found["base", "north"]
    assert found["base", "north"][1] == 340  # 333.58 m * 1.3 / 1.4 m/s = 309.8, and 30 s
    assert stops.walk_transfers(schedule.stops, 400.0).count() == 2
    there = spark.createDataFrame([("far", -20.0, 40.0), ("pole", 90.0, 0.0), ("west", 0.0, -179.9)], "location_id string, lat double, lon double")
    assert {r["location_id"]: r["stop_id"] for r in stops.nearest(there, schedule.stops).collect()} == {"far": "away", "pole": "north", "west": "away"}
    with pytest.raises(ValueError):
        stops.nearby(there, schedule.stops, 0)


def test_near_points_equal_all_pairs(spark):
    """Cells against all pairs by the cosine rule, near the date line and far north too."""
    rng = random.Random(3)
    spots = [(rng.uniform(*lat), rng.choice([rng.uniform(179.98, 180), rng.uniform(-180, -179.98)])) for lat in [(-0.02, 0.02)] * 40 + [(69.98, 70.02)] * 40]
    schedule = from_rows(spark, stops=[(f"{i:03d}", "", a, b, None, 0) for i, (a, b) in enumerate(spots)])

    def metres(p, q):
        (a, b), (c, d) = [[math.radians(x) for x in z] for z in (p, q)]
        return 6_371_000 * math.acos(min(1.0, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))

    wanted = {(f"{i:03d}", f"{j:03d}") for i, p in enumerate(spots) for j, q in enumerate(spots) if i != j and metres(p, q) <= 700}
    found = {(r["from_stop"], r["to_stop"]) for r in stops.walk_transfers(schedule.stops, 700.0).collect()}
    assert len(wanted) > 50 and found == wanted


def test_deep_chains_of_parents(spark):
    chain = [(f"c{i:02d}", "", 1.0, 1.0, f"c{i - 1:02d}" if i else None, int(i == 0)) for i in range(30)]
    schedule = from_rows(spark, stops=chain)
    assert stops.ancestors(schedule.stops).where("stop_id = 'c29'").agg(F.max("depth")).first()[0] == 29
    assert stops.inherited_access(schedule.stops).where("stop_id = 'c29'").first()["wheelchair_boarding"] == 1


def test_stop_relations_and_search(spark):
    tree = [("hall", None, 2), ("deck", "hall", 0), ("gate", "deck", 0), ("x", "y", 0), ("y", "x", 0)]
    named = ["Old Harbour", "d", "g", "x", "y"]
    more = [("m1", "Market", 1.0, 1.0, None, 0), ("m2", "Market Lane", 1.0, 1.0, None, 0), ("m3", "New Market", 1.0, 1.0, None, 0)]
    schedule = from_rows(spark, stops=[(i, n, 1.0, 1.0, p, w) for (i, p, w), n in zip(tree, named, strict=True)] + more)
    asked = spark.createDataFrame([("deck",)], "asked_id string")
    scopes = {k: {r["stop_id"] for r in stops.scope(asked, schedule.stops, k).collect()} for k in ("strict", "children", "related")}
    assert scopes == {"strict": {"deck"}, "children": {"deck", "gate"}, "related": {"hall", "deck", "gate"}}
    access = {r["stop_id"]: r["wheelchair_boarding"] for r in stops.inherited_access(schedule.stops).collect()}
    assert access["gate"] == 2 and access["x"] == 0
    names = [r["stop_name"] for r in stops.search(schedule.stops, "marKET").orderBy(*stops.by_relevance("marKET")).collect()]
    assert names == ["Market", "Market Lane", "New Market"]
    assert [r["stop_name"] for r in stops.search(schedule.stops, "market").orderBy(*stops.alphabetical()).collect()] == names
    assert stops.search(schedule.stops, "").count() == 0
