"""Versioned snapshots of a schedule, for refresh while queries run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .gtfs import SCHEMAS, Schedule


def write_snapshot(schedule: Schedule, root: str, version: int) -> None:
    """Write all tables below root/v<version>. Readers see a version once its last table is there."""
    for name, df in schedule.tables().items():
        df.write.parquet(f"{root}/v{version}/{name}")
    spark = schedule.stops.sparkSession
    spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{root}/versions")


def latest_version(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root}/versions").agg({"version": "max"}).first()[0]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Schedule:
    """A version's tables, the latest whole one by default. A failed write leaves the old one in use."""
    at = latest_version(spark, root) if version is None else version
    return Schedule(**{n: spark.read.schema(s).parquet(f"{root}/v{at}/{n}") for n, s in SCHEMAS.items()})
