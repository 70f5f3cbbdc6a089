import datetime as dt

import pytest

from tramline.api import InvalidRequest, NotActive, NotFound, QueryConfig, ServiceConfig, TransitService
from tramline.operators import journeys
from tramline.sources.gtfs import from_rows
from tramline.sources.snapshots import write_snapshot
from tramline.streaming.refresh import CurrentSchedule, follow_snapshots

DAY = dt.datetime(2025, 3, 5)
MINUTE, HOUR = 60, 3600


@pytest.fixture(scope="module")
def service(spark):
    """A ferry line from the Pier to the Isle, and a bus on from the Isle's second quay to the Cape.

    Ferries leave at 7, 8 and 9 and take 30 minutes, at 9 only 20; buses leave
    ten minutes to the full hour and take 15.
    """
    stops = [
        ("pier", "Pier", 10.0, 20.0, None), ("isle", "Isle", 10.1, 20.0, None), ("quay1", "Isle Quay 1", 10.1005, 20.0, "isle"),
        ("quay2", "Isle Quay 2", 10.0995, 20.0, "isle"), ("cape", "Cape", 10.3, 20.0, None),
    ]
    times = []
    for hour, takes in ((7, 30), (8, 30), (9, 20)):
        start = hour * HOUR
        times += [(f"ferry{hour}", "pier", start, start), (f"ferry{hour}", "quay1", start + takes * MINUTE, start + takes * MINUTE)]
        start += 50 * MINUTE
        times += [(f"bus{hour}", "quay2", start, start), (f"bus{hour}", "cape", start + 15 * MINUTE, start + 15 * MINUTE)]
    schedule = from_rows(
        spark,
        agency=[("sea", "Sea", "", "UTC")],
        calendar=[("daily", *[True] * 7, dt.date(2025, 1, 1), dt.date(2025, 12, 31))],
        stops=[(*s, 0) for s in stops],
        routes=[("ferry", "sea", "F", "", 4), ("bus", "sea", "B", "", 3)],
        trips=[(f"{kind}{h}", kind, "daily", None, 0, 0) for kind in ("ferry", "bus") for h in (7, 8, 9)],
        stop_times=[(i, *t) for i, t in enumerate(times)],
        transfers=[("quay1", "quay2", 2, 5 * MINUTE), ("quay2", "quay1", 2, 5 * MINUTE)],
    )
    return TransitService(schedule, ServiceConfig(days=1, between_stops=-1))


def clocks(found, column="departure"):
    return [f"{r[column] // HOUR:02d}:{r[column] % HOUR // MINUTE:02d}" for r in found.collect()]


def test_connections(service):
    assert clocks(service.connections("pier", "cape", DAY)) == ["07:00"]
    every = service.connections("pier", "cape", DAY, QueryConfig(window=10 * HOUR))
    assert clocks(every) == ["07:00", "08:00", "09:00"] and clocks(every, "arrival") == ["08:05", "09:05", "10:05"]
    late = service.connections("pier", "cape", DAY + dt.timedelta(hours=9, minutes=30), arrive=True)
    assert clocks(late) == ["08:00"]
    # a station stands for its quays
    assert clocks(service.connections("pier", "isle", DAY), "arrival") == ["07:30"]


def test_legs_are_named(service):
    legs = journeys.leg_details(service.connections("pier", "cape", DAY), service.schedule, ["query_id", "round"]).orderBy("nth").collect()
    assert [(x["kind"], x["route_id"], x["from_name"], x["to_name"]) for x in legs] == [
        ("RIDE", "ferry", "Pier", "Isle Quay 1"), ("WALK", "transfer_quay1_quay2", "Isle Quay 1", "Isle Quay 2"), ("RIDE", "bus", "Isle Quay 2", "Cape"),
    ]
    assert [x["distance"] for x in legs][:2] == [11_175, 111] and legs[0]["route_short_name"] == "F"


def test_points_and_filters(service):
    # 0.001 degrees south of the pier: 111.2 m, 103 s on foot and 15 s of access
    walked = service.connections((9.999, 20.0), "cape", DAY).first()
    assert walked["walk_in"] == 118 and walked["departure"] == 7 * HOUR - 118
    legs = journeys.with_mile_legs(service.connections((9.999, 20.0), "cape", DAY), 60).first()["legs"]
    assert (legs[0]["kind"], legs[0]["from_stop"], legs[0]["to_stop"], legs[0]["arr"] - legs[0]["dep"]) == ("WALK", None, "pier", 118)
    short = journeys.with_mile_legs(service.connections((9.999, 20.0), "cape", DAY), 200).first()["legs"]
    assert short[0]["kind"] == "RIDE"
    with pytest.raises(InvalidRequest):
        service.connections("pier", "pier", DAY)
    with pytest.raises(InvalidRequest):
        service.connections("pier", "cape", dt.datetime(2026, 1, 1))
    with pytest.raises(InvalidRequest):
        service.board("pier", dt.datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        service.connections("pier", "cape", DAY, QueryConfig(wheelchair=True)).count()
    assert service.connections("pier", "cape", DAY, QueryConfig(modes=("BUS",))).count() == 0


def test_isolines(service):
    assert {r["stop_id"] for r in service.isolines("pier", DAY).collect()} == {"quay1", "quay2", "cape"}
    quickest = {r["stop_id"]: r["seconds"] for r in service.isolines("pier", DAY, QueryConfig(window=10 * HOUR)).collect()}
    assert quickest == {"quay1": 20 * MINUTE, "quay2": 25 * MINUTE, "cape": 65 * MINUTE}


def test_isolines_to_a_stop_over_a_window(service):
    by = DAY + dt.timedelta(hours=9, minutes=40)
    assert service.isolines("quay1", by, arrive=True).where("stop_id = 'pier'").first()["seconds"] == 20 * MINUTE
    by = DAY + dt.timedelta(hours=9, minutes=10)
    assert service.isolines("quay1", by, QueryConfig(window=2 * HOUR), arrive=True).where("stop_id = 'pier'").first()["seconds"] == 30 * MINUTE


def test_lookups(service):
    assert service.stop("pier").count() == 1
    with pytest.raises(NotFound):
        service.route("R9")
    with pytest.raises(NotActive):
        service.trip("ferry7", dt.date(2026, 1, 1))
    assert service.trip("ferry7", DAY.date()).count() == 1
    assert [r["stop_name"] for r in service.autocomplete("isl").collect()] == ["Isle"]
    assert service.nearest(10.1, 20.0).first()["stop_id"] == "isle"
    assert service.board("isle", DAY + dt.timedelta(hours=6)).count() == 6
    assert service.describe().first()["start_date"] == dt.date(2025, 1, 1)


def test_planners_and_what_they_wrote_are_kept(service):
    query = QueryConfig(window=10 * HOUR, profile=True)
    first = service.connections("pier", "cape", DAY, query)
    assert clocks(first) == ["07:00", "08:00", "09:00"]
    planners, written = list(service._planners.values()), dict(service._store)
    assert clocks(service.connections("pier", "cape", DAY, query)) == clocks(first)
    # the next day is of the same class
    assert clocks(service.connections("pier", "cape", DAY + dt.timedelta(days=1), query)) == clocks(first)
    assert [p for p in service._planners.values() if p in planners] == planners and len(service._planners) == len(planners) + 1
    assert service._store.keys() == written.keys() and all(service._store[k] is v for k, v in written.items())


def test_a_batch_is_answered_and_refused(spark, service):
    at, none = DAY + dt.timedelta(hours=7, minutes=30), (None, None, None)
    rows = [
        ("stops", "pier", None, None, "cape", None, None, DAY),
        ("next day", "pier", None, None, "cape", None, None, at + dt.timedelta(days=1)),
        ("point", None, 9.999, 20.0, "cape", None, None, DAY),
        ("points", None, 9.999, 20.0, None, 10.301, 20.0, DAY),
        ("station", "isle", None, None, "cape", None, None, at),
        ("inside", "isle", None, None, "quay1", None, None, at),
        ("lost", "nowhere", None, None, "cape", None, None, DAY),
        ("none", *none, *none, DAY),
        ("late", "pier", None, None, "cape", None, None, dt.datetime(2026, 1, 1)),
    ]
    asked = spark.createDataFrame(rows, "query_id string, from_stop string, from_lat double, from_lon double, to_stop string, to_lat double, to_lon double, at timestamp")
    ways, refused = service.answer(asked)
    found = {r["query_id"]: (r["date"], f"{r['departure'] // HOUR:02d}:{r['departure'] % HOUR // MINUTE:02d}") for r in ways.collect()}
    assert found == {
        "stops": (DAY.date(), "07:00"), "next day": (DAY.date() + dt.timedelta(days=1), "08:00"), "point": (DAY.date(), "06:58"),
        "points": (DAY.date(), "06:58"), "station": (DAY.date(), "07:50"),
    }
    assert {r["query_id"]: r["reasons"] for r in refused.collect()} == {
        "inside": ["same_stop"], "lost": ["from_unknown"], "none": ["from_missing", "to_missing"], "late": ["outside_validity"],
    }
    empty, nothing = service.answer(asked.limit(0))
    assert empty.count() == 0 and nothing.count() == 0 and set(empty.columns) == set(ways.columns)


@pytest.mark.parametrize("bad", [{"window": -1}, {"modes": ("ROCKET",)}, {"max_walk": -5}])
def test_bad_queries(bad):
    with pytest.raises(InvalidRequest):
        QueryConfig(**bad)


def test_refresh(spark, service, tmp_path):
    root = str(tmp_path / "snapshots")
    write_snapshot(service.schedule, root, 1)
    current = CurrentSchedule(spark, root)
    query = follow_snapshots(current, root, str(tmp_path / "checkpoint"), "1 second")
    try:
        query.processAllAvailable()
        assert current.version == 1 and current.schedule.stops.count() == 5
        write_snapshot(service.schedule, root, 2)
        query.processAllAvailable()
        assert current.version == 2
    finally:
        query.stop()
    assert not current.swap(7) and current.version == 2 and current.last_error is not None
