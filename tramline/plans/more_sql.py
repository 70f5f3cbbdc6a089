"""SQL that DuckDB runs for the same rows as more_queries."""

from __future__ import annotations

from .bridge import DATE, HOP, STOPS_PER_TRIP
from .more_queries import PLANAR_RADIUS
from .sql import _MODED, _connected, _with

_STOPS = "(SELECT count(*) FROM supplier)"

_REQUESTS = f"""requests AS (SELECT 'o' || CASE WHEN starts_with(o_orderpriority, '5') THEN o_orderkey // 2 ELSE o_orderkey END AS query_id,
    CASE WHEN o_custkey % 7 <> 0 THEN 's' || (o_custkey % ({_STOPS} + 3)) END AS from_stop,
    CASE WHEN o_custkey % 7 = 0 OR o_custkey % 11 = 0 THEN 47 + o_custkey % 60 END AS from_lat,
    CASE WHEN (o_custkey % 7 = 0 OR o_custkey % 11 = 0) AND o_custkey % 13 <> 0 THEN 8 END AS from_lon,
    's' || (o_orderkey % {_STOPS}) AS to_stop,
    CASE WHEN o_orderkey % 97 <> 0 THEN DATE '2023-12-20' + (o_orderkey % 400)::INTEGER END AS day,
    o_orderkey % 50 - 1 AS max_walk, o_orderkey % 5 = 0 AS bikes FROM orders),
  told AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM requests)"""

_REASONS = """SELECT query_id, from_stop, to_stop, array_to_string(list_sort(list_filter([
    CASE WHEN n > 1 THEN 'repeated_id' END, CASE WHEN day IS NULL THEN 'no_time' END,
    CASE WHEN day NOT BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' THEN 'outside_validity' END,
    CASE WHEN from_stop IS NULL AND (from_lat IS NULL OR from_lon IS NULL) THEN 'from_missing' END,
    CASE WHEN from_stop IS NOT NULL AND (from_lat IS NOT NULL OR from_lon IS NOT NULL) THEN 'from_ambiguous' END,
    CASE WHEN from_stop IS NULL AND from_lon IS NOT NULL AND from_lat > 90 THEN 'from_coordinate' END,
    CASE WHEN from_stop NOT IN (SELECT stop_id FROM stops) THEN 'from_unknown' END,
    CASE WHEN to_stop NOT IN (SELECT stop_id FROM stops) THEN 'to_unknown' END,
    CASE WHEN from_stop = to_stop THEN 'same_place' END, CASE WHEN max_walk < 0 THEN 'negative_max_walk' END,
    CASE WHEN bikes THEN 'unsupported_bikes' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM told"""

_STARTS = f"""starts AS (SELECT 'n' || c_nationkey || '-' || floor(c_acctbal / 100)::BIGINT AS query_id, 's' || (c_custkey % (2 * {_STOPS})) AS stop_id,
    CASE WHEN c_custkey % 53 <> 0 THEN c_custkey * 7919 % 120000 END AS t FROM customer),
  judged AS (SELECT query_id, min(t) AS reference, array_to_string(list_filter([
      CASE WHEN count(*) FILTER (stop_id IN (SELECT stop_id FROM stops)) = 0 THEN 'no_stops' END,
      CASE WHEN count(*) > count(t) THEN 'no_time' END, CASE WHEN max(t) - min(t) > 86400 THEN 'times_apart' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM starts GROUP BY query_id)"""

_PLAIN = f"""p_stops AS (SELECT 's' || s_suppkey AS stop_id FROM supplier WHERE s_acctbal >= 0),
  p_routes AS (SELECT 'r' || n_nationkey AS route_id FROM nation),
  p_places AS (SELECT 'r' || n_nationkey AS route_id, pos + (pos = 5 AND n_nationkey % 5 = 0)::INTEGER AS pos,
    's' || ((n_nationkey * 7 + pos * (1 + n_nationkey % 3)) % {_STOPS}) AS stop_id FROM nation, (SELECT unnest(range({STOPS_PER_TRIP})) AS pos)),
  p_trips AS (SELECT 'r' || (c_nationkey + CASE WHEN o_orderstatus = 'P' THEN 20 ELSE 0 END) AS route_id, 't' || o_orderkey AS trip_id
    FROM orders JOIN customer ON c_custkey = o_custkey),
  p_items AS (SELECT *, l_linenumber - 1 AS pos, 18000 + l_orderkey * 97 % 1260 * 60 + (l_linenumber - 1) * {HOP} AS arr
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
  p_times AS (SELECT 'r' || c_nationkey AS route_id, 't' || l_orderkey AS trip_id, pos,
    's' || CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE (c_nationkey * 7 + pos * (1 + c_nationkey % 3)) % {_STOPS} END AS stop_id,
    arr, arr + (trunc(l_quantity)::BIGINT - 5) * 10 AS dep FROM p_items),
  p_paths AS (SELECT 's' || s_suppkey AS from_stop, 's' || ((s_suppkey + 5) % {_STOPS}) AS to_stop, 120 - s_suppkey % 7 * 30 AS duration
    FROM supplier WHERE s_suppkey % 5 = 0)"""

_BREACHES = """SELECT breach, route_id, trip_id, pos::INTEGER AS pos, stop_id FROM (
  SELECT 'repeated_time' AS breach, route_id, trip_id, pos, NULL AS stop_id FROM p_times GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'repeated_route_stop', route_id, NULL, pos, NULL FROM p_places GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'repeated_trip', route_id, trip_id, NULL, NULL FROM p_trips GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'unknown_route', route_id, NULL, pos, NULL FROM p_places WHERE route_id NOT IN (FROM p_routes)
  UNION ALL SELECT 'unknown_route', route_id, trip_id, NULL, NULL FROM p_trips WHERE route_id NOT IN (FROM p_routes)
  UNION ALL SELECT 'unknown_route', route_id, trip_id, pos, NULL FROM p_times WHERE route_id NOT IN (FROM p_routes)
  UNION ALL SELECT 'unknown_trip', route_id, trip_id, pos, NULL FROM p_times t WHERE NOT EXISTS (SELECT 1 FROM p_trips x WHERE x.trip_id = t.trip_id AND x.route_id = t.route_id)
  UNION ALL SELECT 'unknown_stop', route_id, NULL, pos, stop_id FROM p_places WHERE stop_id NOT IN (FROM p_stops)
  UNION ALL SELECT 'unknown_stop', NULL, NULL, NULL, from_stop FROM p_paths WHERE from_stop NOT IN (FROM p_stops)
  UNION ALL SELECT 'unknown_stop', NULL, NULL, NULL, to_stop FROM p_paths WHERE to_stop NOT IN (FROM p_stops)
  UNION ALL SELECT 'position_gap', route_id, NULL, min(pos), NULL FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos) - 1 AS nth FROM p_places) WHERE pos <> nth GROUP BY route_id
  UNION ALL SELECT 'no_such_position', route_id, trip_id, pos, stop_id FROM p_times t WHERE NOT EXISTS (SELECT 1 FROM p_places x WHERE x.route_id = t.route_id AND x.pos = t.pos)
  UNION ALL SELECT 'other_stop', t.route_id, trip_id, t.pos, t.stop_id FROM p_times t JOIN p_places x ON x.route_id = t.route_id AND x.pos = t.pos WHERE x.stop_id <> t.stop_id
  UNION ALL SELECT 'missing_time', t.route_id, t.trip_id, x.pos, x.stop_id FROM p_trips t JOIN p_places x USING (route_id)
    WHERE NOT EXISTS (SELECT 1 FROM p_times y WHERE y.route_id = t.route_id AND y.trip_id = t.trip_id AND y.pos = x.pos)
  UNION ALL SELECT 'departs_before_arrival', route_id, trip_id, pos, stop_id FROM p_times WHERE arr > dep
  UNION ALL SELECT 'arrives_before_departure', route_id, trip_id, pos, stop_id FROM (SELECT *, lag(dep) OVER (PARTITION BY route_id, trip_id ORDER BY pos, arr, dep, stop_id) AS before FROM p_times) WHERE before > arr
  UNION ALL SELECT 'negative_transfer', NULL, NULL, NULL, from_stop FROM p_paths WHERE duration < 0)"""


def _clock(seconds: str, zone: str, day: str = f"DATE '{DATE}'") -> str:
    """An instant as a zone's clock shows it, with the offset."""
    instant = f"(TIMESTAMP '1970-01-01' + to_seconds((epoch({day}::TIMESTAMP) + {seconds})::BIGINT))"
    local = f"timezone({zone}, timezone('UTC', {instant}))"
    minutes = f"((epoch({local}) - epoch({instant})) / 60)::BIGINT"
    return f"strftime({local}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {minutes} < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs({minutes}) // 60, abs({minutes}) % 60)"


_LEGS = f""", {_MODED}, trip_zones AS (SELECT trip_id, agency_timezone AS zone, mode, route_id, route_short_name, wheelchair_accessible, bikes_allowed
    FROM trips JOIN routes USING (route_id) JOIN agency USING (agency_id) JOIN modes USING (route_id)),
  flat AS (SELECT q, round, i, legs[i] AS leg, CASE WHEN i > 1 THEN legs[i - 1].trip_id END AS prev, legs[i + 1].trip_id AS next
    FROM (SELECT *, unnest(range(1, len(legs) + 1)) AS i FROM ways)),
  zoned_legs AS (SELECT f.*, coalesce(o.zone, p.zone, n.zone, 'UTC') AS dep_zone, coalesce(o.zone, n.zone, p.zone, 'UTC') AS arr_zone,
      o.mode, o.route_id, o.route_short_name, o.wheelchair_accessible, o.bikes_allowed
    FROM flat f LEFT JOIN trip_zones o ON o.trip_id = leg.trip_id LEFT JOIN trip_zones p ON p.trip_id = prev LEFT JOIN trip_zones n ON n.trip_id = next)"""


def _place(x: str) -> str:
    return f"{{latitude: {x}.stop_lat::DECIMAL(9, 6), longitude: {x}.stop_lon::DECIMAL(9, 6)}}"


def _stop(x: str) -> str:
    return f"{{id: {x}.stop_id, name: {x}.stop_name, coordinates: {_place(x)}}}"


def _nested(detailed: bool) -> str:
    calls = f""", calls_of AS (SELECT trip_id, list({{stop: {_stop('p')}, arrivalTime: {_clock('t.arrival + shift', 'z.zone')}, departureTime: {_clock('t.departure + shift', 'z.zone')}}} ORDER BY pos) AS calls
      FROM stop_times t JOIN trip_zones z USING (trip_id) JOIN stops p USING (stop_id) JOIN zoned y ON y.route_id = t.route_id GROUP BY trip_id)"""
    route = "{id: route_id, name: route_short_name, shortName: route_short_name, mode: mode}"
    stop_times = "stopTimes: calls, " if detailed else ""
    trip = f"{{route: {route}, {stop_times}bikesAllowed: bikes_allowed = 1, wheelchairAccessible: wheelchair_accessible = 1}}"
    base = f"type: CASE WHEN leg.kind = 'WALK' THEN 'WALK' ELSE 'ROUTE' END, \"from\": {_place('a')}, \"to\": {_place('b')}, fromStop: {_stop('a')}, toStop: {_stop('b')}, departureTime: dep_at, arrivalTime: arr_at"
    extra = f"""{_LEGS}{calls}, timed AS (SELECT *, {_clock('leg.dep', 'dep_zone')} AS dep_at, {_clock('leg.arr', 'arr_zone')} AS arr_at FROM zoned_legs),
      told AS (SELECT q, round, i, dep_at, arr_at, leg.kind AS kind, CASE WHEN leg.kind = 'WALK' THEN to_json({{{base}}})::VARCHAR ELSE to_json({{{base}, trip: {trip}}})::VARCHAR END AS json
        FROM timed t JOIN stops a ON a.stop_id = leg.from_stop JOIN stops b ON b.stop_id = leg.to_stop LEFT JOIN calls_of c ON c.trip_id = leg.trip_id)"""
    select = """SELECT q AS query_id, round, '{"departure":"' || arg_min(dep_at, i) || '","arrival":"' || arg_max(arr_at, i) || '","transfers":'
      || greatest(count(*) FILTER (kind = 'RIDE') - 1, 0) || ',"legs":[' || string_agg(json, ',' ORDER BY i) || ']}' AS json FROM told GROUP BY q, round"""
    return _connected(3, select, extra=extra)


_COORDINATES = """spots AS (SELECT s_suppkey, 47.0::DOUBLE + s_suppkey % 10 * 0.004::DOUBLE + s_suppkey % 7 * 0.000004::DOUBLE AS lat,
    8.0::DOUBLE + s_suppkey // 10 % 100 * 0.005::DOUBLE + s_suppkey % 4 * 0.000006::DOUBLE AS lon FROM supplier),
  lats AS (SELECT lat, sum(apart) OVER (ORDER BY lat) AS lat_band FROM (SELECT lat, coalesce((lat - lag(lat) OVER (ORDER BY lat) > 0.00001::DOUBLE)::BIGINT, 0) AS apart FROM (SELECT DISTINCT lat FROM spots))),
  lons AS (SELECT lat_band, lon, sum(apart) OVER (PARTITION BY lat_band ORDER BY lon) AS lon_band FROM (
    SELECT lat_band, lon, coalesce((lon - lag(lon) OVER (PARTITION BY lat_band ORDER BY lon) > 0.00001::DOUBLE)::BIGINT, 0) AS apart FROM (SELECT DISTINCT lat_band, lon FROM spots JOIN lats USING (lat))))"""

_CLOSED = "stop_id NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "request_reasons": _with(_REQUESTS, _REASONS),
        "kept_starts": _with(_STARTS, "SELECT query_id, stop_id, t, reference FROM starts JOIN judged USING (query_id) WHERE reasons = '' AND stop_id IN (SELECT stop_id FROM stops)"),
        "refused_starts": _with(_STARTS, "SELECT query_id, reasons FROM judged WHERE reasons <> ''"),
        "network_breaches": f"WITH {_PLAIN} {_BREACHES}",
        "leg_clock_times": _connected(3, f"SELECT q AS query_id, round, (i - 1)::INTEGER AS nth, leg.kind AS kind, dep_zone AS departure_zone, {_clock('leg.dep', 'dep_zone')} AS departure_at, arr_zone AS arrival_zone, {_clock('leg.arr', 'arr_zone')} AS arrival_at FROM zoned_legs", extra=_LEGS),
        "nested_ways": _nested(True),
        "nested_ways_plain": _nested(False),
        "coordinate_order": f"WITH {_COORDINATES} SELECT s_suppkey, lat_band::BIGINT AS lat_band, lon_band::BIGINT AS lon_band FROM spots JOIN lats USING (lat) JOIN lons USING (lat_band, lon)",
        "planar_pairs": f"""SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id, floor(sqrt(pow(b.s_acctbal - a.s_acctbal, 2) + pow(b.s_suppkey * 3.0::DOUBLE - a.s_suppkey * 3.0::DOUBLE, 2)) + 0.5)::BIGINT AS distance
          FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey AND sqrt(pow(b.s_acctbal - a.s_acctbal, 2) + pow(b.s_suppkey * 3.0::DOUBLE - a.s_suppkey * 3.0::DOUBLE, 2)) <= {PLANAR_RADIUS}""",
        "feed_rejects": _with("", f"SELECT trip_id, stop_id, arrival::INTEGER AS arrival, departure::INTEGER AS departure FROM stop_times WHERE {_CLOSED}"),
        "feed_stop_times": _with("", f"SELECT to_json({{trip_id: trip_id, stop_id: stop_id, arrival: arrival, departure: departure}})::VARCHAR AS json FROM stop_times WHERE NOT ({_CLOSED})"),
    }
