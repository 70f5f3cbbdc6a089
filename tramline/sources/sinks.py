"""Writers of query results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, rounded


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row in column json; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.csv(path, header=True)


def timing_summary(asked: DataFrame, ways: DataFrame, stops: DataFrame, date: dt.date) -> DataFrame:
    """One row per question: what was asked, how many ways there are, and their ranges.

    asked has query_id, a and b (stops) and t, seconds of the date; ways are
    those of routing.connections(). Where there is no way, times are N/A and
    numbers -1. The time that a query took isn't told: a batch is one search.
    """
    zero = F.lit(dt.datetime.combine(date, dt.time()))

    def text(seconds: Column) -> Column:
        return F.date_format(F.timestamp_add("SECOND", seconds, zero), "yyyy-MM-dd'T'HH:mm:ss")

    def least(value: Column) -> Column:
        return F.coalesce(value, F.lit(-1))

    found = ways.groupBy("query_id").agg(
        F.count("*").alias("connections"),
        F.min("departure").alias("departure"),
        F.min("arrival").alias("arrival"),
        F.min("seconds").alias("min_duration"),
        F.max("seconds").alias("max_duration"),
        F.min("n_transfers").alias("min_transfers"),
        F.max("n_transfers").alias("max_transfers"),
    )
    ends = {side: stops.select(*[F.col(f"stop_{c}").alias(f"{side}_{c}") for c in ("id", "name", "lat", "lon")]) for side in "ab"}
    named = asked.join(ends["a"], F.col("a") == F.col("a_id")).join(ends["b"], F.col("b") == F.col("b_id"))
    return named.join(found, "query_id", "left").select(
        F.col("query_id").alias("id"),
        F.col("a").alias("source_stop_id"),
        F.col("b").alias("target_stop_id"),
        F.col("a_name").alias("source_stop_name"),
        F.col("b_name").alias("target_stop_name"),
        text(F.col("t")).alias("requested_departure_time"),
        F.coalesce("connections", F.lit(0)).alias("connections"),
        F.coalesce(text(F.col("departure")), F.lit("N/A")).alias("earliest_departure_time"),
        F.coalesce(text(F.col("arrival")), F.lit("N/A")).alias("earliest_arrival_time"),
        *[least(F.col(c)).alias(c) for c in ("min_duration", "max_duration", "min_transfers", "max_transfers")],
        rounded(haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).alias("beeline_distance"),
    )
