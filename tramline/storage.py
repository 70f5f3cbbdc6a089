"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only where everything runs on one machine, as in tests, a folder below the
    local temporary one stands in for it; on a cluster it has to be set.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_:
        return set_
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "tramline-checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder, a folder for each value of the columns by, and read it back."""
    return counted(df, name, *by)[0]


def counted(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, int]:
    """materialize() and the number of rows, which is observed while they are written."""
    spark, seen = df.sparkSession, Observation()
    path = scratch_path(spark, name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def is_there(df: DataFrame) -> bool:
    """Whether the files of a written table still exist."""
    files, spark = df.inputFiles(), df.sparkSession
    if not files:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
