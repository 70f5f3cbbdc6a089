"""SQL that DuckDB runs for the same rows as the queries."""

from __future__ import annotations

from ..functions.codes import EXTENDED, MODES
from .bridge import DATE, SCHEDULE_SQL
from .queries import ACCESS, ASKED, DATES, GOAL, LOCATIONS, RADIUS, SAMPLE


def _with(extra: str, select: str) -> str:
    return SCHEDULE_SQL + (f", {extra}\n" if extra else "") + select


_BASIC = "CASE " + f"WHEN route_type IN ({', '.join(map(str, MODES))}) THEN route_type "
_BASIC += " ".join(f"WHEN route_type IN ({', '.join(map(str, v))}) THEN {k}" for k, v in EXTENDED.items()) + " END"
_MODED = f"""moded AS (SELECT route_id, agency_id, {_BASIC} AS basic_type FROM routes),
modes AS (SELECT route_id, basic_type, CASE basic_type {" ".join(f"WHEN {k} THEN '{v}'" for k, v in MODES.items())} END AS mode FROM moded)"""

_RUNNING = f"SELECT a.date, trip_id, route_id, service_id FROM trips JOIN active a USING (service_id) WHERE a.date = DATE '{DATE}'"

_ABOVE = """above AS (
  SELECT stop_id, stop_id AS ancestor, 0 AS depth FROM stops
  UNION ALL SELECT stop_id, parent_station, 1 FROM stops WHERE parent_station IS NOT NULL)"""


def _haversine(a: str, b: str, lat: str = "stop_lat", lon: str = "stop_lon", lat2: str = "stop_lat", lon2: str = "stop_lon") -> str:
    h = f"""(pow(sin(radians({b}.{lat2} - {a}.{lat}) / 2), 2)
      + cos(radians({a}.{lat})) * cos(radians({b}.{lat2})) * pow(sin(radians({b}.{lon2} - {a}.{lon}) / 2), 2))"""
    return f"2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h}))"


_PLACES = "places AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in LOCATIONS) + ") v(location_id, lat, lon))"
_DIST = f"dist AS (SELECT location_id, stop_id, parent_station, {_haversine('p', 's', 'lat', 'lon')} AS d FROM places p, stops s)"
_WALKS = f"""pairs AS (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, {_haversine("a", "b")} AS d FROM stops a, stops b WHERE a.stop_id <> b.stop_id),
walks AS (SELECT from_stop, to_stop, floor(d + 0.5)::BIGINT AS distance, greatest(floor(d * 1.3 / 1.4 + 0.5)::BIGINT + 30, 120) AS duration FROM pairs WHERE d <= {RADIUS})"""

_ZONED = f"""zoned AS (
  SELECT route_id, (epoch(timezone(agency_timezone, TIMESTAMP '{DATE} 12:00:00')) - 43200 - epoch(TIMESTAMP '{DATE}'))::BIGINT AS shift
  FROM routes JOIN agency USING (agency_id))"""


def _board(kind: str, scope: str, limit: int | None) -> str:
    scopes = {
        "strict": "SELECT a.asked_id, a.asked_id AS stop_id FROM wanted a",
        "children": "SELECT a.asked_id, b.stop_id FROM wanted a JOIN above b ON b.ancestor = a.asked_id",
        "related": """SELECT a.asked_id, b.stop_id FROM wanted a
          JOIN (SELECT stop_id, arg_max(ancestor, depth) AS top FROM above GROUP BY 1) x ON x.stop_id = a.asked_id
          JOIN (SELECT stop_id, arg_max(ancestor, depth) AS top FROM above GROUP BY 1) b ON b.top = x.top""",
        "nearby": f"""SELECT a.asked_id, t.stop_id FROM wanted a JOIN stops f ON f.stop_id = a.asked_id, stops t
          WHERE {_haversine("f", "t")} <= {RADIUS}""",
    }
    extra = f"""{_ABOVE}, wanted AS (SELECT * FROM (VALUES ('s5'), ('s7')) v(asked_id)), scoped AS ({scopes[scope]}),
    events AS (SELECT asked_id, t.stop_id, trip_id, t.route_id, a.date AS service_date,
      to_timestamp(epoch(timezone(agency_timezone, a.date + INTERVAL 12 HOURS)) - 43200 + t.{kind}) AT TIME ZONE 'UTC' AS event_ts
      FROM stop_times t JOIN scoped USING (stop_id) JOIN active a USING (service_id) JOIN routes r USING (route_id) JOIN agency USING (agency_id)
      WHERE a.date BETWEEN DATE '2024-01-06' AND DATE '2024-01-13'),
    shown AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY event_ts, trip_id, stop_id)::INTEGER AS rank FROM events
      WHERE event_ts >= TIMESTAMP '2024-01-10 07:00:00' AND event_ts < TIMESTAMP '2024-01-10 09:00:00')"""
    if limit is None:
        return _with(extra, "SELECT asked_id, stop_id, trip_id, route_id, service_date, event_ts FROM shown")
    return _with(extra, f"SELECT asked_id, stop_id, trip_id, route_id, service_date, event_ts, rank FROM shown WHERE rank <= {limit}")


def _search(condition: str, tail: str = "") -> str:
    return _with("", f"SELECT stop_id, stop_name FROM stops WHERE parent_station IS NULL AND {condition} {tail}")


def _transfers(generated: str | None) -> str:
    """CTEs down to paths(from_stop, to_stop, duration) by precedence."""
    layer = f"SELECT from_stop, to_stop, duration, -1 AS rank FROM {generated} UNION ALL" if generated else ""
    return f"""served AS (SELECT DISTINCT stop_id FROM stop_times),
    below AS (SELECT parent_station AS station, stop_id AS platform FROM stops WHERE parent_station IS NOT NULL),
    to_platform AS (SELECT from_stop, platform AS to_stop, duration FROM transfers JOIN below ON to_stop = station),
    both_ways AS (SELECT *, 1 AS own FROM transfers UNION ALL SELECT *, 0 FROM to_platform),
    offered AS (SELECT from_stop AS giver, to_stop, duration FROM both_ways
      QUALIFY row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY own DESC, duration) = 1),
    layers AS ({layer}
      SELECT platform AS from_stop, to_stop, duration, 1 AS rank FROM offered JOIN below ON giver = station UNION ALL
      SELECT station, to_stop, duration, 2 FROM offered JOIN below ON giver = platform UNION ALL
      SELECT from_stop, to_stop, duration, 3 FROM to_platform UNION ALL
      SELECT from_stop, to_stop, duration, 4 FROM transfers),
    paths AS (SELECT from_stop, to_stop, duration::BIGINT AS duration FROM layers
      WHERE from_stop IN (FROM served) AND to_stop IN (FROM served)
      QUALIFY row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY rank DESC, duration) = 1)"""


_NO_LEGS = "[]::STRUCT(kind VARCHAR, pattern_id VARCHAR, trip_id VARCHAR, from_stop VARCHAR, to_stop VARCHAR, dep BIGINT, arr BIGINT)[]"
_SIMPLE = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"('q{i}', '{a}', '{b}', {h * 3600}::BIGINT)" for i, (a, b, h) in ASKED.items()) + ") v(q, a, b, t))"
_LATER = _SIMPLE.replace("SELECT * FROM", "SELECT q, a, b, t + 36000 AS t FROM")
_WALK = "{{kind: 'WALK', pattern_id: NULL::VARCHAR, trip_id: NULL::VARCHAR, from_stop: {a}, to_stop: g, dep: {t}, arr: {t} + duration}}"


def _moments(window: int, backward: bool, asked: str) -> str:
    """CTEs down to asked(q, a, b, t): a query row for each departure (arrival) of a query's own stops in its window."""
    if backward:
        near = "SELECT q, stop_id, 0 AS walk, base.t FROM base JOIN stops ON stop_id = b"
        near += " UNION ALL SELECT q, from_stop, duration, base.t FROM base JOIN paths ON to_stop = b WHERE from_stop <> to_stop"
        events, inside = "arr + walk AS t1 FROM near JOIN fw USING (stop_id) WHERE fw.pos > 0", "t1 <= t AND t1 > t - {w}"
    else:
        near = "SELECT q, a AS stop_id, 0 AS walk, base.t FROM base"
        near += " UNION ALL SELECT q, to_stop, duration, base.t FROM base JOIN paths ON from_stop = a WHERE from_stop <> to_stop"
        events, inside = "dep - walk AS t1 FROM near JOIN fw USING (stop_id) WHERE fw.pos < 5", "t1 >= t AND t1 < t + {w}"
    return f"""{asked.replace("asked AS", "base AS", 1)}, near AS ({near}),
    moments AS (SELECT q, t AS t1 FROM base UNION SELECT q, t1 FROM (SELECT q, near.t, {events}) WHERE {inside.format(w=window)}),
    asked AS (SELECT base.q || '@' || t1 AS q, base.q AS q0, a, b, t1 AS t, base.t AS t0 FROM moments JOIN base USING (q))"""


def _rounds(rides: int, backward: bool, asked: str, starts: str = "") -> str:
    """CTEs down to labels(round, q, stop, kind, t, cmp, start, n, legs): one group of CTEs per round.

    Ties as in the search: less time, a ride, the later start, fewer legs, ids.
    starts selects (q, stop, t) from which no walks are made, else a is the start.
    """
    sign, near = ("-", "b") if backward else ("", "a")
    times = "-f.dep AS arr, -f.arr AS dep, 5 - f.pos AS pos, -f.ord AS ord" if backward else "f.arr, f.dep, f.pos, f.ord"
    ends = ("to_stop", "from_stop") if backward else ("from_stop", "to_stop")
    parts = [
        _transfers(None),
        _ZONED,
        f"""fw AS (SELECT o.pattern_id AS p, s.trip_id, s.stop_id, s.arrival + z.shift AS arr, s.departure + z.shift AS dep, s.pos, o.ord
          FROM stop_times s JOIN zoned z USING (route_id) JOIN placed o USING (trip_id)
          JOIN active a ON a.service_id = s.service_id AND a.date = DATE '{DATE}')""",
        f"tt AS (SELECT f.p, f.trip_id, f.stop_id, {times} FROM fw f)",
        f"foot AS (SELECT {ends[0]} AS f, {ends[1]} AS g, duration FROM paths WHERE from_stop <> to_stop)",
        asked,
        f"l0 AS ({starts or f'SELECT q, {near} AS stop, {sign}t AS t FROM asked WHERE {near} IN (FROM served)'})",
        f"""f0 AS (FROM (SELECT q, stop, 'START' AS kind, t, t AS cmp, t AS start, 0 AS n, {_NO_LEGS} AS legs, '' AS p, '' AS trip, '' AS a, '' AS b FROM l0
          UNION ALL SELECT q, g, 'WALK', t + duration, t + duration - 120, t, 1, [{_WALK.format(a="stop", t="t")}], '', '', stop, '' FROM l0 JOIN foot ON stop = f WHERE {not starts})
          QUALIFY row_number() OVER (PARTITION BY q, stop ORDER BY cmp, kind, start DESC, n, p, trip, a, b) = 1)""",
    ]
    for k in range(1, rides + 1):
        j = k - 1
        known = " UNION ALL ".join(f"SELECT q, stop, cmp FROM f{i}" for i in range(k))
        parts += [
            f"k{k} AS (SELECT q, stop, min(cmp) AS least FROM ({known}) GROUP BY ALL)",
            f"""s{k} AS (SELECT f.q, f.stop, f.start, f.n, d.p, d.pos, arg_min({{id: d.trip_id, dep: d.dep}}, d.ord) AS trip
              FROM f{j} f JOIN tt d ON d.stop_id = f.stop AND d.pos < 5
              AND d.dep >= f.t + CASE WHEN f.kind = 'RIDE' THEN 120 ELSE 0 END GROUP BY ALL)""",
            f"""r{k} AS (SELECT s.q, d.stop_id AS stop, d.arr AS t, CASE WHEN s.n = 0 THEN s.trip.dep ELSE s.start END AS start, s.n + 1 AS n,
                s.p, s.trip.id AS trip, s.stop AS a, s.trip.dep AS dep
              FROM s{k} s JOIN tt d ON d.trip_id = s.trip.id AND d.pos > s.pos
              QUALIFY row_number() OVER (PARTITION BY s.q, d.stop_id ORDER BY d.arr, CASE WHEN s.n = 0 THEN s.trip.dep ELSE s.start END DESC, s.n, s.p, s.trip.id, s.stop) = 1)""",
            f"""i{k} AS (SELECT r.*, {{kind: 'RIDE', pattern_id: p, trip_id: trip, from_stop: a, to_stop: stop, dep: dep, arr: t}} AS leg
              FROM r{k} r LEFT JOIN k{k} b USING (q, stop) WHERE least IS NULL OR t < least)""",
            f"""v{k} AS (SELECT q, stop, 'RIDE' AS kind, t, t AS cmp, start, n, [leg] AS own, p, trip, a, stop AS b FROM i{k}
              UNION ALL SELECT q, g, 'WALK', t + duration, t + duration - 120, start, n + 1, [leg, {_WALK.format(a="stop", t="t")}], p, trip, a, stop
              FROM i{k} JOIN foot ON stop = f)""",
            f"""c{k} AS (SELECT v.* FROM v{k} v LEFT JOIN k{k} b USING (q, stop) WHERE least IS NULL OR cmp < least
              QUALIFY row_number() OVER (PARTITION BY q, stop ORDER BY cmp, kind, start DESC, n, p, trip, a, v.b) = 1)""",
            f"""f{k} AS (SELECT c.q, c.stop, c.kind, c.t, c.cmp, c.start, c.n, list_concat(e.legs, c.own) AS legs, c.p, c.trip, c.a, c.b
              FROM c{k} c JOIN f{j} e ON e.q = c.q AND e.stop = c.a)""",
        ]
    parts.append("labels AS (" + " UNION ALL ".join(f"SELECT {k} AS round, q, stop, kind, t, cmp, start, n, legs FROM f{k}" for k in range(rides + 1)) + ")")
    return ", ".join(parts)


def _turned(backward: bool) -> str:
    if not backward:
        return "legs"
    turned = "{kind: x.kind, pattern_id: x.pattern_id, trip_id: x.trip_id, from_stop: x.to_stop, to_stop: x.from_stop, dep: -x.arr, arr: -x.dep}"
    return f"list_reverse(list_transform(legs, lambda x: {turned}))"


_BEST_LABELS = """best AS (SELECT q, stop AS stop_id, round, {legs} AS legs FROM labels WHERE kind <> 'START' AND (q, stop) NOT IN (SELECT (q, stop) FROM l0)
  QUALIFY row_number() OVER (PARTITION BY q, stop ORDER BY cmp, round) = 1)"""

_FRONT = """ends AS (SELECT l.*, {far} AS goal FROM labels l JOIN asked a ON a.q = l.q AND {far} = l.stop WHERE kind <> 'START'
    QUALIFY row_number() OVER (PARTITION BY l.q, round ORDER BY l.t, start DESC, n) = 1),
  front AS (SELECT *, min(t) OVER (PARTITION BY q ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ends)"""

_DETOURS = """calls AS (SELECT trip_id, stop_id, min(arr) AS c_arr, min(dep) AS c_dep FROM fw GROUP BY ALL),
  best AS (SELECT q, round, {legs} AS legs FROM front WHERE before IS NULL OR t < before),
  tails AS (SELECT q, round, CASE WHEN legs[-1].kind = 'WALK' AND c_arr <= legs[-1].arr AND c_arr > legs[-2].dep
      THEN list_append(legs[1:len(legs) - 2], struct_update(legs[-2], to_stop := legs[-1].to_stop, arr := c_arr)) ELSE legs END AS legs
    FROM best LEFT JOIN calls ON trip_id = legs[-2].trip_id AND stop_id = legs[-1].to_stop AND len(legs) > 1),
  heads AS (SELECT q, round, CASE WHEN legs[1].kind = 'WALK' AND legs[2].kind = 'RIDE' AND c_dep >= legs[1].dep AND c_dep < legs[2].arr
      THEN list_prepend(struct_update(legs[2], from_stop := legs[1].from_stop, dep := c_dep), legs[3:]) ELSE legs END AS legs
    FROM tails LEFT JOIN calls ON trip_id = legs[2].trip_id AND stop_id = legs[1].from_stop)"""

_IDLE = """late AS (SELECT *, CASE WHEN legs[1].kind = 'WALK' AND legs[2].kind = 'RIDE' THEN greatest(legs[2].dep - legs[1].arr, 0) ELSE 0 END AS idle FROM {of}),
  shifted AS (SELECT * REPLACE (list_prepend(struct_update(legs[1], dep := legs[1].dep + idle, arr := legs[1].arr + idle), legs[2:]) AS legs) FROM late),
  ways AS (SELECT *, legs[1].dep AS departure, legs[-1].arr AS arrival, legs[1].from_stop AS from_stop, legs[-1].to_stop AS to_stop,
    len(list_filter(legs, lambda x: x.kind = 'RIDE'))::INTEGER AS n_rides, len(list_filter(legs, lambda x: x.kind = 'WALK'))::INTEGER AS n_walks,
    len(list_filter(range(1, len(legs)), lambda i: legs[i].kind = 'RIDE' AND legs[i + 1].kind = 'RIDE'))::INTEGER AS n_same_stop FROM shifted)"""

_COUNTED = """departure, arrival, from_stop, to_stop, n_rides, n_walks, n_same_stop, greatest(n_rides - 1, 0)::INTEGER AS n_transfers,
  arrival - departure AS seconds, 0::BIGINT AS walk_in, 0::BIGINT AS walk_out"""


def _reached(rides: int, backward: bool, select: str, asked: str = "") -> str:
    """SQL over ways(q, stop_id, round, legs, ..) to every stop."""
    asked = asked or (_LATER if backward else _SIMPLE)
    best = _BEST_LABELS.format(legs=_turned(backward))
    return _with(f"{_rounds(rides, backward, asked)}, {best}, {_IDLE.format(of='best')}", select)


def _connected(rides: int, select: str, asked: str = _SIMPLE, extra: str = "") -> str:
    """SQL over ways(q, round, legs, ..) between two stops."""
    parts = [_rounds(rides, False, asked), _FRONT.format(far="b"), _DETOURS.format(legs="legs"), _IDLE.format(of="heads")]
    return _with(", ".join(parts) + extra, select)


_QUICKEST = """SELECT q0 AS query_id, stop_id, arrival - departure AS seconds, departure, arrival, round FROM ways JOIN asked USING (q)
  WHERE {edge} QUALIFY row_number() OVER (PARTITION BY q0, stop_id ORDER BY arrival - departure, {tie}, round, departure) = 1"""

_PARETO = "SELECT q AS query_id, round, t FROM front WHERE before IS NULL OR t < before"

_SAMPLE = f"""numbered AS (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS nth, count(*) OVER () AS n FROM served),
  pairs AS (SELECT i, i * 7919 % n AS x, (i * 7919 + 1 + i * 104729 % (n - 1)) % n AS y, i * 15485863 % 86400 AS t FROM range({{size}}) r(i), (SELECT count(*) AS n FROM served)),
  asked AS (SELECT i::VARCHAR AS q, s.stop_id AS a, d.stop_id AS b, t FROM pairs JOIN numbered s ON s.nth = x JOIN numbered d ON d.nth = y)"""

_TIMES = """SELECT i AS id, a AS source_stop_id, b AS target_stop_id, s.stop_name AS source_stop_name, d.stop_name AS target_stop_name,
    strftime(TIMESTAMP '{day}' + to_seconds(asked.t::BIGINT), '%Y-%m-%dT%H:%M:%S') AS requested_departure_time, count(ways.q) AS connections,
    coalesce(strftime(TIMESTAMP '{day}' + to_seconds(min(departure)::BIGINT), '%Y-%m-%dT%H:%M:%S'), 'N/A') AS earliest_departure_time,
    coalesce(strftime(TIMESTAMP '{day}' + to_seconds(min(arrival)::BIGINT), '%Y-%m-%dT%H:%M:%S'), 'N/A') AS earliest_arrival_time,
    coalesce(min(arrival - departure), -1)::BIGINT AS min_duration, coalesce(max(arrival - departure), -1)::BIGINT AS max_duration,
    coalesce(min(CASE WHEN n_rides > 1 THEN n_rides - 1 WHEN n_rides >= 0 THEN 0 END), -1)::INTEGER AS min_transfers, coalesce(max(CASE WHEN n_rides > 1 THEN n_rides - 1 WHEN n_rides >= 0 THEN 0 END), -1)::INTEGER AS max_transfers,
    floor(any_value({beeline}) + 0.5)::BIGINT AS beeline_distance
  FROM (SELECT *, q::BIGINT AS i FROM asked) asked LEFT JOIN ways USING (q) JOIN stops s ON s.stop_id = a JOIN stops d ON d.stop_id = b
  GROUP BY i, a, b, s.stop_name, d.stop_name, asked.t"""


#: Stops to start from at the coordinates: within the radius, else the nearest.
_ACCESS = f"""near AS (SELECT location_id, stop_id, floor(d * 1.3 / 1.4 + 0.5)::BIGINT + {ACCESS} AS walk
  FROM (SELECT *, min(d) OVER (PARTITION BY location_id) AS least, row_number() OVER (PARTITION BY location_id ORDER BY d, stop_id) AS nth
    FROM dist WHERE stop_id IN (SELECT stop_id FROM stop_times)) WHERE d <= {RADIUS} OR (least > {RADIUS} AND nth = 1)),
  asked AS (SELECT location_id AS q, '{GOAL}' AS b, 28800::BIGINT AS t FROM places)"""
_FROM_POINTS = "SELECT location_id AS q, stop_id AS stop, 28800::BIGINT + walk AS t FROM near"
_NOT_AT_GOAL = f"{_FROM_POINTS} WHERE stop_id <> '{GOAL}'"

_DAYS = ", ".join(f"DATE '{d}'" for d in DATES)


def _by_date(rides: int) -> str:
    """SQL over questions on DATES: times count in seconds from 1970, and a question boards trips of its day and those beside it."""
    parts = [
        _transfers(None),
        "days AS (SELECT date, (epoch(date::TIMESTAMP) // 86400)::BIGINT AS day FROM (SELECT DISTINCT date FROM active))",
        f"{_SAMPLE.format(size=SAMPLE).replace('asked AS', 'sample AS')}",
        f"asked AS (SELECT q, a, b, t, day, date, t + day * 86400 AS t0 FROM sample JOIN days ON date = ([{_DAYS}])[q::INTEGER % {len(DATES)} + 1])",
        """zoned AS (SELECT route_id, date, day, (epoch(timezone(agency_timezone, date + INTERVAL 12 HOURS)) - 43200)::BIGINT AS zero
          FROM routes JOIN agency USING (agency_id), days WHERE day IN (SELECT day + i FROM asked, range(-1, 2) r(i)))""",
        """tt AS (SELECT o.pattern_id AS p, s.trip_id, z.day, s.stop_id, s.arrival + z.zero AS arr, s.departure + z.zero AS dep, s.pos, o.ord
          FROM stop_times s JOIN zoned z USING (route_id) JOIN placed o USING (trip_id) JOIN active a ON a.service_id = s.service_id AND a.date = z.date)""",
        "foot AS (SELECT from_stop AS f, to_stop AS g, duration FROM paths WHERE from_stop <> to_stop)",
        """f0 AS (FROM (SELECT q, a AS stop, 'START' AS kind, t0 AS t, t0 AS cmp FROM asked WHERE a IN (FROM served)
          UNION ALL SELECT q, g, 'WALK', t0 + duration, t0 + duration - 120 FROM asked JOIN foot ON a = f)
          QUALIFY row_number() OVER (PARTITION BY q, stop ORDER BY cmp, kind) = 1)""",
    ]
    for k in range(1, rides + 1):
        known = " UNION ALL ".join(f"SELECT q, stop, cmp FROM f{i}" for i in range(k))
        parts += [
            f"k{k} AS (SELECT q, stop, min(cmp) AS least FROM ({known}) GROUP BY ALL)",
            f"""s{k} AS (SELECT f.q, d.p, d.pos, arg_min({{id: d.trip_id, day: d.day}}, d.day * 1000000 + d.ord) AS trip
              FROM f{k - 1} f JOIN asked a USING (q) JOIN tt d ON d.stop_id = f.stop AND d.pos < 5 AND d.day BETWEEN a.day - 1 AND a.day + 1
              AND d.dep >= f.t + CASE WHEN f.kind = 'RIDE' THEN 120 ELSE 0 END GROUP BY f.q, f.stop, d.p, d.pos)""",
            f"""r{k} AS (SELECT s.q, d.stop_id AS stop, min(d.arr) AS t FROM s{k} s JOIN tt d ON d.trip_id = s.trip.id AND d.day = s.trip.day AND d.pos > s.pos GROUP BY ALL)""",
            f"i{k} AS (SELECT r.* FROM r{k} r LEFT JOIN k{k} b USING (q, stop) WHERE least IS NULL OR t < least)",
            f"""v{k} AS (SELECT q, stop, 'RIDE' AS kind, t, t AS cmp FROM i{k}
              UNION ALL SELECT q, g, 'WALK', t + duration, t + duration - 120 FROM i{k} JOIN foot ON stop = f)""",
            f"""f{k} AS (SELECT v.* FROM v{k} v LEFT JOIN k{k} b USING (q, stop) WHERE least IS NULL OR cmp < least
              QUALIFY row_number() OVER (PARTITION BY q, stop ORDER BY cmp, kind) = 1)""",
        ]
    labels = " UNION ALL ".join(f"SELECT {k} AS round, q, stop, kind, t FROM f{k}" for k in range(rides + 1))
    parts.append(f"ends AS (SELECT l.q, date, round, l.t - day * 86400 AS t FROM ({labels}) l JOIN asked a ON a.q = l.q AND a.b = l.stop WHERE kind <> 'START')")
    parts.append("front AS (SELECT *, min(t) OVER (PARTITION BY q ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ends)")
    return _with(", ".join(parts), "SELECT q AS query_id, date, round, t FROM front WHERE before IS NULL OR t < before")


def oracle_sql() -> dict[str, str]:
    points = f"{_PLACES}, {_DIST}, {_ACCESS}"
    rounds = _rounds(2, False, points, _FROM_POINTS)
    return {
        "active_service_dates": _with("", "SELECT date, service_id FROM active WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
        "active_trips": _with("", _RUNNING),
        "mode_filter": _with(_MODED, f"{_RUNNING} AND route_id IN (SELECT route_id FROM modes WHERE mode IN ('TRAM', 'RAIL'))"),
        "access_filter": _with("", f"{_RUNNING} AND wheelchair_accessible = 1"),
        "bike_filter": _with("", f"{_RUNNING} AND bikes_allowed = 1"),
        "validity": _with("", "SELECT min(a) AS start_date, max(b) AS end_date FROM (SELECT start_date AS a, end_date AS b FROM calendar UNION ALL SELECT date, date FROM calendar_dates)"),
        "feature_flags": _with("", "SELECT (SELECT bool_or(wheelchair_boarding <> 0) FROM stops) OR (SELECT bool_or(wheelchair_accessible <> 0) FROM trips) AS has_accessibility, (SELECT bool_or(bikes_allowed <> 0) FROM trips) AS has_bikes, (SELECT count(*) > 0 FROM routes) AS has_travel_modes"),
        "service_keys": _with("", "SELECT date, string_agg(service_id, ',' ORDER BY service_id) AS services FROM active WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY date"),
        "route_modes": _with(_MODED, "SELECT route_id, basic_type, mode FROM modes"),
        "service_times": _with("", "SELECT row_id, printf('%02d:%02d:%02d', departure // 3600, departure % 3600 // 60, departure % 60) AS text, departure::INTEGER AS seconds, (departure % 86400)::INTEGER AS clock FROM stop_times"),
        "zone_offsets": _with("", "SELECT agency_id, date, (epoch(timezone(agency_timezone, date + INTERVAL 12 HOURS)) - 43200 - epoch(date::TIMESTAMP))::BIGINT AS offset FROM agency, (SELECT unnest([DATE '2024-03-30', DATE '2024-03-31', DATE '2024-04-01', DATE '2024-10-26', DATE '2024-10-27', DATE '2024-10-28']) AS date)"),
        "board_departures": _board("departure", "strict", 10),
        "board_arrivals": _board("arrival", "strict", None),
        "board_scope_children": _board("departure", "children", 10),
        "board_scope_related": _board("departure", "related", 10),
        "board_scope_nearby": _board("departure", "nearby", 10),
        "stop_search_contains": _search("contains(lower(stop_name), '00001')"),
        "stop_search_starts": _search("starts_with(lower(stop_name), 'supp')"),
        "stop_search_ends": _search("ends_with(lower(stop_name), '5')"),
        "stop_search_exact": _search("lower(stop_name) = 'supplier#000000005'"),
        "search_alphabetical": _search("contains(lower(stop_name), '5')", "ORDER BY stop_name, stop_id LIMIT 10"),
        "search_relevance": _search("contains(lower(stop_name), '0')", "ORDER BY CASE WHEN lower(stop_name) = '0' THEN 0 WHEN starts_with(lower(stop_name), '0') THEN 1 ELSE 2 END, length(stop_name), stop_name, stop_id LIMIT 10"),
        "nearest_stop": _with(f"{_PLACES}, {_DIST}", "SELECT location_id, stop_id, floor(d + 0.5)::BIGINT AS distance FROM dist QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY d, stop_id) = 1"),
        "nearest_stops": _with(f"{_PLACES}, {_DIST}, roots AS (SELECT location_id, coalesce(parent_station, stop_id) AS stop_id, min(d) AS d FROM dist WHERE d <= {RADIUS} GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY d, stop_id)::INTEGER AS rank FROM roots)", "SELECT location_id, stop_id, floor(d + 0.5)::BIGINT AS distance, rank FROM ranked WHERE rank <= 10"),
        "access_stops": _with(f"{_PLACES}, {_DIST}", f"SELECT location_id, stop_id, floor(d + 0.5)::BIGINT AS distance, floor(d * 1.3 / 1.4 + 0.5)::BIGINT AS walk FROM (SELECT *, min(d) OVER (PARTITION BY location_id) AS least, row_number() OVER (PARTITION BY location_id ORDER BY d, stop_id) AS nth FROM dist) WHERE d <= {RADIUS} OR (least > {RADIUS} AND nth = 1)"),
        "walk_transfers": _with(_WALKS, "SELECT from_stop, to_stop, distance, duration FROM walks"),
        "stop_ancestors": _with(_ABOVE, "SELECT stop_id, ancestor, depth FROM above"),
        "stop_access": _with("", "SELECT s.stop_id, CASE WHEN s.wheelchair_boarding <> 0 THEN s.wheelchair_boarding ELSE coalesce(p.wheelchair_boarding, 0) END AS wheelchair_boarding FROM stops s LEFT JOIN stops p ON p.stop_id = s.parent_station"),
        "patterns": _with("", "SELECT pattern_id, route_id, stop_ids, count(*) AS n_trips FROM (SELECT trip_id, route_id, string_agg(stop_id, ',' ORDER BY pos) AS stop_ids FROM stop_times GROUP BY ALL) JOIN placed USING (trip_id, route_id) GROUP BY ALL"),
        "trip_order": _with("", "SELECT pattern_id, trip_id, ord AS trip_ord FROM placed"),
        "trip_positions": _with("", "SELECT trip_id, stop_id, pos::INTEGER AS pos FROM stop_times"),
        "connecting_hops": _with("", "SELECT trip_id, pos::INTEGER AS pos, stop_id, lag(stop_id) OVER w AS prev_stop, lead(stop_id) OVER w AS next_stop FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY pos)"),
        "transfers_precedence": _with(f"{_WALKS}, {_transfers('walks')}", "SELECT from_stop, to_stop, duration FROM paths"),
        "stop_times_json": _with("", "SELECT to_json({row_id: row_id, trip_id: trip_id, stop_id: stop_id, arrival: arrival, departure: departure})::VARCHAR AS json FROM stop_times"),
        "stops_json": _with("", "SELECT CASE WHEN parent_station IS NULL THEN to_json({stop_id: stop_id, stop_name: stop_name})::VARCHAR ELSE to_json({stop_id: stop_id, stop_name: stop_name, parent_station: parent_station})::VARCHAR END AS json FROM stops"),
        "earliest_arrival_k1": _reached(1, False, "SELECT q AS query_id, stop_id, round, arrival AS t FROM ways"),
        "isolines_k3": _reached(3, False, "SELECT q AS query_id, stop_id, round, arrival AS t FROM ways"),
        "latest_departure_k2": _reached(2, True, "SELECT q AS query_id, stop_id, round, departure AS t FROM ways"),
        "pareto_k3": _with(f"{_rounds(3, False, _SIMPLE)}, {_FRONT.format(far='b')}", _PARETO),
        "journey_legs": _connected(3, f"SELECT q AS query_id, round, (i - 1)::INTEGER AS nth, legs[i].kind AS kind, legs[i].pattern_id AS pattern_id, legs[i].trip_id AS trip_id, CASE WHEN legs[i].kind = 'RIDE' THEN DATE '{DATE}' END AS service_date, legs[i].from_stop AS from_stop, legs[i].to_stop AS to_stop, legs[i].dep AS dep, legs[i].arr AS arr FROM (SELECT *, unnest(range(1, len(legs) + 1)) AS i FROM ways)"),
        "journey_counts": _connected(3, f"SELECT q AS query_id, round, {_COUNTED} FROM ways"),
        "timing_table": _connected(3, _TIMES.format(day=DATE, beeline=_haversine("s", "d")), _SIMPLE.replace("'q", "'")),
        "route_sample": _connected(3, _TIMES.format(day=DATE, beeline=_haversine("s", "d")), _SAMPLE.format(size=SAMPLE)),
        "window_connections": _connected(2, f"SELECT q0 AS query_id, round, {_COUNTED} FROM ways JOIN asked USING (q) WHERE departure < t0 + 600 QUALIFY row_number() OVER (PARTITION BY q0, legs ORDER BY round) = 1", _moments(600, False, _SIMPLE)),
        "range_k2": _connected(
            2,
            f"SELECT q0 AS query_id, round, {_COUNTED} FROM (SELECT *, min(arrival) OVER (PARTITION BY q0 ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM firsts_per_round) WHERE before IS NULL OR arrival < before",
            _moments(1800, False, _SIMPLE),
            ", firsts_per_round AS (SELECT * FROM ways JOIN (SELECT q, q0 FROM asked) USING (q) QUALIFY row_number() OVER (PARTITION BY q0, round ORDER BY arrival, departure DESC, legs) = 1)",
        ),
        "shortest_isolines": _reached(2, False, _QUICKEST.format(edge="departure < t0 + 900", tie="departure"), _moments(900, False, _SIMPLE)),
        "pareto_by_date": _by_date(2),
        "day_classes": _with("", """SELECT date, min(date) OVER (PARTITION BY services, zones) AS first_date FROM (
            SELECT d.date, (SELECT string_agg(service_id, ',' ORDER BY service_id) FROM active a WHERE a.date = d.date) AS services,
              (SELECT string_agg(z, ',' ORDER BY z) FROM (SELECT DISTINCT agency_timezone || ' ' || (epoch(timezone(agency_timezone, d.date + INTERVAL 12 HOURS)) - epoch(d.date::TIMESTAMP))::BIGINT AS z FROM agency)) AS zones
            FROM (SELECT DATE '2024-01-01' + i::INTEGER AS date FROM range(91) r(i)) d)"""),
        "isolines_from_points": _with(f"{rounds}, {_BEST_LABELS.format(legs='legs')}, {_IDLE.format(of='best')}", "SELECT q AS query_id, stop_id, round, arrival AS t FROM ways"),
        "mile_legs": _with(
            ", ".join([_rounds(2, False, points, _NOT_AT_GOAL), _FRONT.format(far="b"), _DETOURS.format(legs="legs"), _IDLE.format(of="heads")]) + """,
            miles AS (SELECT ways.*, walk FROM ways JOIN near ON location_id = q AND near.stop_id = legs[1].from_stop),
            shown AS (SELECT q, round, CASE WHEN walk > 60 THEN list_prepend({kind: 'WALK', pattern_id: NULL, trip_id: NULL, from_stop: NULL, to_stop: legs[1].from_stop, dep: legs[1].dep - walk, arr: legs[1].dep}, legs) ELSE legs END AS legs FROM miles)""",
            "SELECT q AS query_id, round, (i - 1)::INTEGER AS nth, legs[i].kind AS kind, legs[i].trip_id AS trip_id, legs[i].from_stop AS from_stop, legs[i].to_stop AS to_stop, legs[i].dep AS dep, legs[i].arr AS arr FROM (SELECT *, unnest(range(1, len(legs) + 1)) AS i FROM shown)",
        ),
        "shortest_isolines_arrive": _reached(2, True, _QUICKEST.format(edge="arrival > t0 - 900", tie="arrival DESC"), _moments(900, True, _LATER)),
    }
