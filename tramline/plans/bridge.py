"""A transit schedule made from the star-schema tables, and the same as SQL.

Suppliers are stops, regions agencies, nations routes, orders trips and order
priorities services. Every fourth trip runs its route the other way round, so
a route has two patterns. All formulas are whole numbers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.gtfs import DAYS, SCHEMAS, Schedule

ZONES = ["Europe/Zurich", "America/New_York", "Asia/Tokyo", "Europe/London", "UTC"]
ROUTE_TYPES = [3, 0, 1, 100, 700, 900]
YEAR_START, YEAR_END = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
DATE = dt.date(2024, 1, 10)
STOPS_PER_TRIP = 6
HOP = 360
DWELL = 60


def schedule_of(spark: SparkSession, sf_dir: str) -> Schedule:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    supplier, orders = table("supplier"), table("orders")
    stop_count = supplier.count()  # a parameter of the formulas, from the file's metadata
    key = F.col("s_suppkey")

    def stop_id(number: Column) -> Column:
        return F.concat(F.lit("s"), number.cast("long"))

    parent = F.when((key % 5 != 0) & (key > 5), stop_id(key - key % 5))
    stops = supplier.select(
        stop_id(key).alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        (47.0 + (key % 10) * 0.004).alias("stop_lat"),
        (8.0 + (F.floor(key / 10) % 100) * 0.005).alias("stop_lon"),
        parent.alias("parent_station"),
        (key % 3).cast("int").alias("wheelchair_boarding"),
    )
    agency = table("region").select(
        F.concat(F.lit("a"), "r_regionkey").alias("agency_id"),
        F.col("r_name").alias("agency_name"),
        F.lit("").alias("agency_url"),
        F.element_at(F.array(*map(F.lit, ZONES)), F.col("r_regionkey") % 5 + 1).alias("agency_timezone"),
    )
    nation = table("nation")
    routes = nation.select(
        F.concat(F.lit("r"), "n_nationkey").alias("route_id"),
        F.concat(F.lit("a"), "n_regionkey").alias("agency_id"),
        F.col("n_name").alias("route_short_name"),
        F.col("n_name").alias("route_long_name"),
        F.element_at(F.array(*map(F.lit, ROUTE_TYPES)), F.col("n_nationkey") % 6 + 1).alias("route_type"),
    )
    customer = table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    ridden = orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(customer, "o_custkey")
    number = F.col("o_orderkey")
    trip_id = F.concat(F.lit("t"), number)
    trips = ridden.select(
        trip_id.alias("trip_id"),
        F.concat(F.lit("r"), "c_nationkey").alias("route_id"),
        F.col("o_orderpriority").alias("service_id"),
        F.lit(None).cast("string").alias("trip_headsign"),
        (number % 3).cast("int").alias("wheelchair_accessible"),
        (F.floor(number / 3.0) % 3).cast("int").alias("bikes_allowed"),
    )
    pos = F.explode(F.sequence(F.lit(0), F.lit(STOPS_PER_TRIP - 1)))
    placed = ridden.select("o_orderkey", "c_nationkey", pos.alias("pos"))
    along = F.when(number % 4 == 0, STOPS_PER_TRIP - 1 - F.col("pos")).otherwise(F.col("pos"))
    stop = (F.col("c_nationkey") * 7 + along * (1 + F.col("c_nationkey") % 3)) % stop_count
    leaves = 18000 + (number * 97 % 1260) * 60 + F.col("pos") * HOP
    stop_times = placed.select(
        (number * STOPS_PER_TRIP + F.col("pos")).alias("row_id"),
        trip_id.alias("trip_id"),
        stop_id(stop).alias("stop_id"),
        F.when(F.col("pos") == 0, leaves).otherwise(leaves - DWELL).cast("int").alias("arrival"),
        leaves.cast("int").alias("departure"),
    )
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    services = orders.select("o_orderpriority").distinct()
    days = [((F.lit(i + 1) + digit) % 3 != 0).alias(day) for i, day in enumerate(DAYS)]
    calendar = services.select(
        F.col("o_orderpriority").alias("service_id"), *days, F.lit(YEAR_START).alias("start_date"), F.lit(YEAR_END).alias("end_date")
    )
    numbered = services.select("o_orderpriority", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i"))
    calendar_dates = numbered.where((F.col("i") * 7 + digit * 3) % 11 == 0).select(
        F.col("o_orderpriority").alias("service_id"),
        F.date_add(F.lit(YEAR_START), F.col("i")).alias("date"),
        (1 + (F.col("i") + digit) % 2).cast("int").alias("exception_type"),
    )
    roots = supplier.where(key % 5 == 0)
    transfers = roots.select(
        stop_id(key).alias("from_stop_id"),
        stop_id((key + 5) % stop_count).alias("to_stop_id"),
        F.lit(2).alias("transfer_type"),
        (120 + key % 7 * 30).cast("int").alias("min_transfer_time"),
    )
    made = {
        "agency": agency, "calendar": calendar, "calendar_dates": calendar_dates, "stops": stops, "routes": routes,
        "trips": trips, "stop_times": stop_times, "transfers": transfers,
    }
    return Schedule(**{name: made[name].select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]) for name in SCHEMAS})


_DAY_SQL = ", ".join(f"({i + 1} + digit) % 3 <> 0 AS {d}" for i, d in enumerate(DAYS))

SCHEDULE_SQL = f"""
WITH n AS (SELECT count(*) AS stops FROM supplier),
stops AS (
  SELECT 's' || s_suppkey AS stop_id, s_name AS stop_name, 47.0::DOUBLE + (s_suppkey % 10) * 0.004::DOUBLE AS stop_lat,
    8.0::DOUBLE + (s_suppkey // 10 % 100) * 0.005::DOUBLE AS stop_lon,
    CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey > 5 THEN 's' || (s_suppkey - s_suppkey % 5) END AS parent_station,
    (s_suppkey % 3)::INTEGER AS wheelchair_boarding FROM supplier),
agency AS (
  SELECT 'a' || r_regionkey AS agency_id, r_name AS agency_name, ({ZONES!r})[r_regionkey % 5 + 1] AS agency_timezone FROM region),
routes AS (
  SELECT 'r' || n_nationkey AS route_id, 'a' || n_regionkey AS agency_id, n_name AS route_short_name,
    ({ROUTE_TYPES!r})[n_nationkey % 6 + 1] AS route_type FROM nation),
trips AS (
  SELECT 't' || o_orderkey AS trip_id, 'r' || c_nationkey AS route_id, o_orderpriority AS service_id, c_nationkey, o_orderkey,
    (o_orderkey % 3)::INTEGER AS wheelchair_accessible, (o_orderkey // 3 % 3)::INTEGER AS bikes_allowed
  FROM orders JOIN customer ON c_custkey = o_custkey),
stop_times AS (
  SELECT trip_id, route_id, service_id, o_orderkey * {STOPS_PER_TRIP} + pos AS row_id, pos,
    's' || ((c_nationkey * 7 + CASE WHEN o_orderkey % 4 = 0 THEN {STOPS_PER_TRIP - 1} - pos ELSE pos END * (1 + c_nationkey % 3)) % stops) AS stop_id,
    18000 + (o_orderkey * 97 % 1260) * 60 + pos * {HOP} AS departure,
    18000 + (o_orderkey * 97 % 1260) * 60 + pos * {HOP} - CASE WHEN pos = 0 THEN 0 ELSE {DWELL} END AS arrival
  FROM trips, n, range({STOPS_PER_TRIP}) p(pos)),
firsts AS (SELECT trip_id, route_id, o_orderkey % 4 = 0 AS back, 18000 + (o_orderkey * 97 % 1260) * 60 AS dep0 FROM trips),
pattern_firsts AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY route_id, back ORDER BY dep0, trip_id) = 1),
pattern_names AS (
  SELECT route_id, back, route_id || '_sr' || row_number() OVER (PARTITION BY route_id ORDER BY dep0, trip_id) AS pattern_id FROM pattern_firsts),
placed AS (
  SELECT trip_id, route_id, pattern_id, (row_number() OVER (PARTITION BY pattern_id ORDER BY dep0, trip_id) - 1)::INTEGER AS ord
  FROM firsts JOIN pattern_names USING (route_id, back)),
services AS (SELECT DISTINCT o_orderpriority AS service_id, substr(o_orderpriority, 1, 1)::INTEGER AS digit FROM orders),
calendar AS (SELECT service_id, {_DAY_SQL}, DATE '{YEAR_START}' AS start_date, DATE '{YEAR_END}' AS end_date FROM services),
calendar_dates AS (
  SELECT service_id, DATE '{YEAR_START}' + i::INTEGER AS date, 1 + (i + digit) % 2 AS exception_type
  FROM services, range(31) r(i) WHERE (i * 7 + digit * 3) % 11 = 0),
active AS (
  SELECT d.date, c.service_id
  FROM (SELECT DATE '{YEAR_START}' + i::INTEGER AS date FROM range(366) r(i)) d, calendar c
  WHERE CASE (SELECT x.exception_type FROM calendar_dates x WHERE x.service_id = c.service_id AND x.date = d.date)
    WHEN 1 THEN TRUE WHEN 2 THEN FALSE
    ELSE [c.monday, c.tuesday, c.wednesday, c.thursday, c.friday, c.saturday, c.sunday][isodow(d.date)] END),
transfers AS (
  SELECT 's' || s_suppkey AS from_stop, 's' || ((s_suppkey + 5) % stops) AS to_stop, 120 + s_suppkey % 7 * 30 AS duration
  FROM supplier, n WHERE s_suppkey % 5 = 0)
"""
