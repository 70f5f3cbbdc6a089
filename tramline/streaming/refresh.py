"""Keeping a schedule fresh while it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.gtfs import Schedule
from ..sources.snapshots import read_snapshot


class CurrentSchedule:
    """The handle that queries take their schedule from; swapped as a whole.

    accept may check a new schedule; if it raises, the old one stays in use
    and the error is kept in last_error.
    """

    def __init__(self, spark: SparkSession, root: str, accept: Callable[[Schedule], None] | None = None):
        self._spark, self._root, self._accept = spark, root, accept
        self.version: int | None = None
        self.schedule: Schedule | None = None
        self.last_error: Exception | None = None

    def swap(self, version: int) -> bool:
        if self.version is not None and version <= self.version:
            return False
        try:
            fresh = read_snapshot(self._spark, self._root, version)
            if self._accept:
                self._accept(fresh)
        except Exception as error:  # whatever is wrong with the new one, the old one goes on
            self.last_error = error
            return False
        self.version, self.schedule, self.last_error = version, fresh, None
        return True


def follow_snapshots(current: CurrentSchedule, root: str, checkpoint: str, interval: str = "1 minute") -> StreamingQuery:
    """Swap in new snapshots as their versions appear below root."""
    spark = current._spark

    def on_batch(batch: DataFrame, _: int) -> None:
        latest = batch.agg({"version": "max"}).first()[0]
        if latest is not None:
            current.swap(latest)

    versions = spark.readStream.schema("version long").parquet(f"{root}/versions")
    writer = versions.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()
