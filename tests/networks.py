"""A made-up town for routing tests, and a plain search to hold results against."""

from __future__ import annotations

import datetime as dt
import random

from tramline.operators.network import build_network
from tramline.operators.routing import Planner
from tramline.sources.gtfs import from_rows

MINUTE, HOUR = 60, 3600
DATE = dt.date(2025, 3, 5)
PAUSE = 90
#: line: (stops, first departure after the full hour, minutes a hop, minutes between trips)
TOWN = {
    "ring": (["gate", "mill", "park", "dock", "fort", "gate"], 2, 4, 20),
    "hill": (["mill", "hill", "tower", "farm"], 5, 6, 30),
    "shore": (["dock", "pier", "beach", "farm"], 11, 5, 25),
    "express": (["gate", "fort", "farm"], 17, 9, 60),
}
#: (from, to): minutes, both ways
PATHS = {("park", "hill"): 7, ("fort", "pier"): 3, ("beach", "tower"): 12}


def stop_rows(lines=TOWN, hours=(6, 22)):
    """(trip, line, stop, arrival, departure) of all trips there and back, a minute of dwell between the ends."""
    out = []
    for line, (stops, offset, hop, headway) in lines.items():
        for way, seq in (("out", stops), ("back", stops[::-1])):
            start, n = hours[0] * HOUR + offset * MINUTE, 0
            while start < hours[1] * HOUR:
                for i, stop in enumerate(seq):
                    arr = start + i * (hop + 1) * MINUTE - (MINUTE if i else 0)
                    dep = arr if i in (0, len(seq) - 1) else arr + MINUTE
                    out.append((f"{line}-{way}-{n:03d}", f"{line}-{way}", stop, arr, dep))
                start, n = start + headway * MINUTE, n + 1
    return out


def planner(spark, rows, paths, days=1, zone="UTC", date=DATE, pause=PAUSE, first_day=dt.date(2025, 1, 1)):
    """A planner of rows as stop_rows() gives and paths like PATHS."""
    used = sorted({r[2] for r in rows})
    both = [(a, b, 2, m * MINUTE) for (x, y), m in paths.items() for a, b in ((x, y), (y, x)) if x in used and y in used]
    schedule = from_rows(
        spark,
        agency=[("town", "Town", "", zone)],
        calendar=[("daily", *[True] * 7, first_day, dt.date(2025, 12, 31))],
        stops=[(s, s.title(), 50 + i / 10, 4.0, None, 0) for i, s in enumerate(used)],
        routes=[(line, "town", line, "", 3) for line in sorted({r[1] for r in rows})],
        trips=[(trip, line, "daily", None, 0, 0) for trip, line in sorted({r[:2] for r in rows})],
        stop_times=[(i, trip, stop, arr, dep) for i, (trip, _, stop, arr, dep) in enumerate(rows)],
        transfers=both,
    )
    return Planner(schedule, build_network(schedule, same_stop=pause), date, days)


def random_town(seed):
    """Lines over random stops, with crossings and loops, and random paths."""
    rng = random.Random(seed)
    names = [f"stop{i:02d}" for i in range(14)]
    lines = {
        f"l{i}": (rng.choices(names, k=rng.randint(3, 7)), rng.randrange(20), rng.randint(2, 9), rng.choice([15, 20, 35]))
        for i in range(6)
    }
    lines = {k: ([s for j, s in enumerate(v[0]) if not j or s != v[0][j - 1]], *v[1:]) for k, v in lines.items()}
    paths = {tuple(sorted(rng.sample(names, 2))): rng.randint(1, 15) for _ in range(8)}
    return stop_rows(lines, (6, 10)), paths


def slow_labels(rows, paths, starts, rides, pause=PAUSE, least=0, longest=None):
    """{(round, stop): (kind, t)}: each round looks at all trips from all stops bettered in the last one."""
    trips = {}
    for trip, _, stop, arr, dep in rows:
        trips.setdefault(trip, []).append((stop, arr, dep))
    hops = [(a, b, m * MINUTE) for (x, y), m in paths.items() for a, b in ((x, y), (y, x)) if longest is None or m * MINUTE <= longest]
    served = {r[2] for r in rows}
    hops = [h for h in hops if h[0] in served and h[1] in served]

    def walked(layer):
        out = [(t - (pause if kind == "WALK" else 0), kind, t, stop) for stop, (kind, t) in layer.items()]
        out += [(t + d - pause, "WALK", t + d, b) for a, b, d in hops if a in layer for t in [layer[a][1]]]
        return sorted(out, key=lambda x: (x[0], x[1] == "WALK"))

    found, best, layer = {}, {}, {s: ("START", t) for s, t in starts.items() if s in served}
    for k in range(rides + 1):
        if k:
            rode = {}
            for calls in trips.values():
                for i, (stop, _, dep) in enumerate(calls):
                    if stop in layer:
                        kind, t = layer[stop]
                        if dep >= t + (max(pause, least) if kind == "RIDE" else 0):
                            for on, arr, _ in calls[i + 1 :]:
                                rode[on] = min(rode.get(on, arr), arr)
            layer = {s: ("RIDE", t) for s, t in rode.items() if t < best.get(s, 10**9)}
        new = {}
        for value, kind, t, stop in walked(layer):
            if stop not in new and value < best.get(stop, 10**9):
                new[stop] = (kind, t, value)
        layer = {s: v[:2] for s, v in new.items()}
        best |= {s: v[2] for s, v in new.items()}
        found |= {(k, s): v for s, v in layer.items()}
    return found


def ends(spark, rows):
    """rows: (query, stop) or (query, stop, walk)."""
    return spark.createDataFrame([(*r, 0)[:3] for r in rows], "query_id string, stop_id string, walk long")


def moments(spark, times):
    return spark.createDataFrame(list(times.items()), "query_id string, t long")


def clock(seconds):
    return f"{seconds // HOUR:02d}:{seconds % HOUR // MINUTE:02d}"
