"""Requests in batches: those that can be answered, and the others with the reasons why not."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinate
from ..functions.times import DAY

SIDES = ("from", "to")
#: Bounds of a request that must not be negative, where it has them.
BOUNDS = ("window", "max_walk", "max_transfers", "max_travel", "min_transfer")


def judged(requests: DataFrame, stops: DataFrame, first: dt.date, last: dt.date, supported: dict[str, bool] | None = None) -> DataFrame:
    """The requests with reasons, a sorted list that is empty where a request can be answered.

    requests has query_id, from_stop, from_lat, from_lon, to_stop, to_lat,
    to_lon and at (an instant, in UTC), and may have BOUNDS and wheelchair and
    bikes; other columns are carried along. Each side is a stop or a point.
    first and last are the schedule's days, both valid; supported says whether
    it has information on wheelchair and bikes.

    Reasons: no_id, repeated_id, <side>_missing, <side>_ambiguous (stop and
    point), <side>_coordinate (outside the globe or not a number),
    <side>_unknown, same_place, no_time, outside_validity,
    negative_<bound>, unsupported_<wheelchair or bikes>. A batch without rows
    has no answers.
    """
    reasons: list[Column] = [
        _reason("no_id", F.col("query_id").isNull()),
        _reason("repeated_id", F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1),
        _reason("no_time", F.col("at").isNull()),
        _reason("outside_validity", ~F.to_date("at").between(F.lit(first), F.lit(last))),
    ]
    known = stops.select("stop_id", F.lit(True).alias("known")).dropDuplicates(["stop_id"])
    met = requests
    for side in SIDES:
        stop, lat, lon = (F.col(f"{side}_{c}") for c in ("stop", "lat", "lon"))
        met = met.join(known.select(F.col("stop_id").alias(f"{side}_stop"), F.col("known").alias(f"{side}_known")), f"{side}_stop", "left")
        point = lat.isNotNull() & lon.isNotNull()
        reasons += [
            _reason(f"{side}_missing", stop.isNull() & ~point),
            _reason(f"{side}_ambiguous", stop.isNotNull() & (lat.isNotNull() | lon.isNotNull())),
            _reason(f"{side}_coordinate", stop.isNull() & point & ~valid_coordinate(lat, lon)),
            _reason(f"{side}_unknown", stop.isNotNull() & F.col(f"{side}_known").isNull()),
        ]
    one_stop = F.col("from_stop") == F.col("to_stop")
    one_point = F.col("from_stop").isNull() & F.col("to_stop").isNull() & (F.col("from_lat") == F.col("to_lat")) & (F.col("from_lon") == F.col("to_lon"))
    reasons.append(_reason("same_place", F.coalesce(one_stop, F.lit(False)) | F.coalesce(one_point, F.lit(False))))
    reasons += [_reason(f"negative_{c}", F.col(c) < 0) for c in BOUNDS if c in requests.columns]
    unsupported = [c for c in ("wheelchair", "bikes") if c in requests.columns and not (supported or {}).get(c, True)]
    reasons += [_reason(f"unsupported_{c}", F.col(c)) for c in unsupported]
    return met.select(*requests.columns, F.sort_array(F.array_compact(F.array(*reasons))).alias("reasons"))


def _reason(name: str, holds: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.lit(name))


def split(judged_requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those that can be answered, without reasons, and those refused, with them."""
    good = F.size("reasons") == 0
    return judged_requests.where(good).drop("reasons"), judged_requests.where(~good)


def checked_starts(starts: DataFrame, net_stops: DataFrame, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """Starts of a batch at stops of the network, and the refused queries with their reasons.

    starts has query_id, stop_id and t. Stops that aren't in the network are
    left out of a query. A query is refused if it has none left (no_stops), if
    a time is missing (no_time), or if its times lie over a day apart
    (times_apart). Returns (query_id, stop_id, t, reference), where reference
    is the query's first time, backward its last, and (query_id, reasons).
    """
    known = starts.join(net_stops.select("stop_id", F.lit(True).alias("known")).dropDuplicates(["stop_id"]), "stop_id", "left")
    each = known.groupBy("query_id").agg(
        F.count("known").alias("n"), F.bool_or(F.col("t").isNull()).alias("untimed"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    found = [
        _reason("no_stops", F.col("n") == 0),
        _reason("no_time", F.col("untimed")),
        _reason("times_apart", F.col("hi") - F.col("lo") > DAY),
    ]
    marked = each.withColumn("reasons", F.sort_array(F.array_compact(F.array(*found))))
    good = marked.where(F.size("reasons") == 0).select("query_id", F.col("hi" if backward else "lo").alias("reference"))
    kept = known.where("known").join(good, "query_id").select("query_id", "stop_id", "t", "reference")
    return kept, marked.where(F.size("reasons") > 0).select("query_id", "reasons")
