"""Queries of requests, plain networks, nested answers, coordinates and feeds, on tables that the star schema gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..functions.times import format_service_time
from ..operators import answers, builder, requests, routing, services, stops
from ..operators.raptor import RouteConfig
from ..sources.feeds import TablesFeed, feed_of
from ..sources.gtfs import Schedule, read_schedule
from ..sources.sinks import as_json
from ..storage import scratch_path
from .bridge import DATE, HOP, STOPS_PER_TRIP, schedule_of
from .queries import asked, planner_of

PLANAR_RADIUS = 400.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every order, some of which can't be answered."""
    n = _table(spark, sf_dir, "supplier").count()
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    point = (customer % 7 == 0) | (customer % 11 == 0)
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.when(F.col("o_orderpriority").startswith("5"), F.floor(key / 2).cast("long")).otherwise(key)).alias("query_id"),
        F.when(customer % 7 != 0, F.concat(F.lit("s"), customer % (n + 3))).alias("from_stop"),
        F.when(point, 47.0 + customer % 60).alias("from_lat"),
        F.when(point & (customer % 13 != 0), 8.0).alias("from_lon"),
        F.concat(F.lit("s"), key % n).alias("to_stop"),
        F.lit(None).cast("double").alias("to_lat"),
        F.lit(None).cast("double").alias("to_lon"),
        F.when(key % 97 != 0, F.timestamp_add("DAY", (key % 400).cast("int"), F.lit("2023-12-20 08:00:00").cast("timestamp"))).alias("at"),
        (key % 50 - 1).alias("max_walk"),
        (key % 5 == 0).alias("bikes"),
    )


def request_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the reasons for which it is refused."""
    schedule = schedule_of(spark, sf_dir)
    span = services.validity(schedule).first()
    found = requests.judged(made_requests(spark, sf_dir), schedule.stops, span["start_date"], span["end_date"], {"bikes": False})
    return found.select("query_id", "from_stop", "to_stop", F.array_join("reasons", ",").alias("reasons"))


def made_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of a batch: each customer is one of its nation and balance."""
    n, key = _table(spark, sf_dir, "supplier").count(), F.col("c_custkey")
    group = F.concat(F.lit("n"), "c_nationkey", F.lit("-"), F.floor(F.col("c_acctbal") / 100).cast("long"))
    return _table(spark, sf_dir, "customer").select(
        group.alias("query_id"), F.concat(F.lit("s"), key % (2 * n)).alias("stop_id"), F.when(key % 53 != 0, key * 7919 % 120_000).alias("t")
    )


def kept_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts at known stops of the queries that can be answered, with their reference time."""
    return requests.checked_starts(made_starts(spark, sf_dir), schedule_of(spark, sf_dir).stops)[0]


def refused_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.checked_starts(made_starts(spark, sf_dir), schedule_of(spark, sf_dir).stops)[1]
    return found.select("query_id", F.array_join("reasons", ",").alias("reasons"))


def plain_tables(spark: SparkSession, sf_dir: str) -> builder.PlainTables:
    """A network of nations, orders and line items with much wrong in it: closed stops, gaps, strays and times that run back."""
    supplier, nation = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    n = supplier.count()
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer, "o_custkey")

    def stop(route: str, pos: Column) -> Column:
        return F.concat(F.lit("s"), (F.col(route) * 7 + pos * (1 + F.col(route) % 3)) % n)

    def named(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value.cast("long"))

    pos, route = F.col("pos"), F.col("n_nationkey")
    places = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(STOPS_PER_TRIP - 1))).alias("pos"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    items = items.withColumn("pos", F.col("l_linenumber") - 1).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey"), "l_orderkey")
    arr = 18000 + F.col("l_orderkey") * 97 % 1260 * 60 + pos * HOP
    key = F.col("s_suppkey")
    return builder.PlainTables(
        supplier.where("s_acctbal >= 0").select(named("s", key).alias("stop_id")),
        nation.select(named("r", route).alias("route_id")),
        places.select(named("r", route).alias("route_id"), (pos + ((pos == 5) & (route % 5 == 0)).cast("int")).alias("pos"), stop("n_nationkey", pos).alias("stop_id")),
        orders.select(
            named("r", F.col("c_nationkey") + F.when(F.col("o_orderstatus") == "P", 20).otherwise(0)).alias("route_id"), named("t", F.col("o_orderkey")).alias("trip_id")
        ),
        items.select(
            named("r", F.col("c_nationkey")).alias("route_id"),
            named("t", F.col("l_orderkey")).alias("trip_id"),
            "pos",
            F.when(F.col("l_returnflag") == "R", named("s", F.col("l_suppkey"))).otherwise(stop("c_nationkey", pos)).alias("stop_id"),
            arr.alias("arr"),
            (arr + (F.col("q") - 5) * 10).alias("dep"),
        ),
        supplier.where(key % 5 == 0).select(named("s", key).alias("from_stop"), named("s", (key + 5) % n).alias("to_stop"), (120 - key % 7 * 30).alias("duration")),
    )


def network_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with plain_tables(), one row a breach."""
    return builder.breaches(plain_tables(spark, sf_dir))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, sources, targets = asked(spark)
    return routing.connections(planner_of(spark, sf_dir), queries, sources, targets, RouteConfig(max_transfers=2))


def leg_clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs with the clock times of both ends, in the zones of the agencies ridden."""
    legs = answers.local_legs(_ways(spark, sf_dir), schedule_of(spark, sf_dir), F.lit(DATE), ["query_id", "round"])
    return legs.select("query_id", "round", "nth", "kind", "departure_zone", "departure_at", "arrival_zone", "arrival_at")


def _nested(spark: SparkSession, sf_dir: str, detailed: bool) -> DataFrame:
    found = answers.nested(_ways(spark, sf_dir), schedule_of(spark, sf_dir), F.lit(DATE), ["query_id", "round"], detailed)
    return found.select("query_id", "round", F.to_json(F.struct("departure", "arrival", "transfers", "legs")).alias("json"))


def nested_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as JSON with all that is in them."""
    return _nested(spark, sf_dir, True)


def nested_ways_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as JSON without the stop times of the trips."""
    return _nested(spark, sf_dir, False)


def coordinate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order in which coordinates within the tolerance tie."""
    key = F.col("s_suppkey")
    places = _table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        (47.0 + key % 10 * 0.004 + key % 7 * 0.000004).alias("lat"),
        (8.0 + F.floor(key / 10) % 100 * 0.005 + key % 4 * 0.000006).alias("lon"),
    )
    return stops.banded_order(places).select("s_suppkey", "lat_band", "lon_band")


def planar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that lie close in the plane of balance and number."""
    x, y = F.col("s_acctbal"), F.col("s_suppkey") * 3.0
    left, right = (_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(f"{s}_id"), x.alias(f"{s}_x"), y.alias(f"{s}_y")) for s in ("left", "right"))
    found = stops.planar_pairs(left, right, PLANAR_RADIUS).where("left_id <> right_id")
    return found.select("left_id", "right_id", rounded(F.col("distance")).alias("distance"))


def feed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The bridged schedule as raw text tables, without the stops that are closed."""
    schedule = schedule_of(spark, sf_dir)
    open_ = _table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("long")).alias("stop_id"))
    parents = open_.select(F.col("stop_id").alias("parent_station"), F.col("stop_id").alias("parent"))
    kept = schedule.stops.join(open_, "stop_id", "left_semi").join(parents, "parent_station", "left").withColumn("parent_station", F.col("parent"))
    ends = [open_.select(F.col("stop_id").alias(c)) for c in ("from_stop_id", "to_stop_id")]
    transfers = schedule.transfers.join(ends[0], "from_stop_id", "left_semi").join(ends[1], "to_stop_id", "left_semi")
    times = schedule.stop_times.orderBy("row_id").select(
        "trip_id", "stop_id", format_service_time(F.col("arrival")).alias("arrival_time"), format_service_time(F.col("departure")).alias("departure_time")
    )
    made = schedule.tables() | {"stops": kept.drop("parent"), "transfers": transfers, "stop_times": times}
    return {name: _texts(df) for name, df in made.items()}


def _texts(df: DataFrame) -> DataFrame:
    def text(name: str, kind: str) -> Column:
        value = F.date_format(name, "yyyyMMdd") if kind == "date" else F.col(name).cast("int").cast("string") if kind == "boolean" else F.col(name).cast("string")
        return value.alias(name)

    return df.select(*[text(*c) for c in df.dtypes])


def _read_feed(spark: SparkSession, sf_dir: str) -> Schedule:
    """The feed written as files in a folder and read again."""
    folder, made = scratch_path(spark, "feed"), feed_tables(spark, sf_dir)
    for name, df in made.items():
        df.write.csv(f"{folder}/{name}.txt", header=True)
    return read_schedule(spark, folder)


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times that reading a feed leaves out, as they call at stops that it doesn't have."""
    found = _read_feed(spark, sf_dir).rejected["stop_times"]
    return found.select("trip_id", "stop_id", "arrival", "departure")


def feed_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop times that stay, of a feed given by a function instead of files."""
    made = feed_tables(spark, sf_dir)
    schedule = read_schedule(spark, feed_of(TablesFeed(lambda _, name: made.get(name))))
    return as_json(schedule.stop_times.select("trip_id", "stop_id", "arrival", "departure"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        request_reasons, kept_starts, refused_starts, network_breaches, leg_clock_times, nested_ways, nested_ways_plain, coordinate_order,
        planar_pairs, feed_rejects, feed_stop_times,
    ]
    return {f.__name__: f for f in own}
