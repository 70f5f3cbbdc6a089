"""A token-id store in ORC files.

Documents lie in ascending id order over the files of a folder, one row each:
doc_id, n_tokens, ids, the number of its part of the store and its first
token's place there. ORC run-length encodes these integers. Row indexes
and Bloom filters on doc_id let a reader skip stripes; stripes can be read in
parallel. A small table beside the files, the manifest, has each part's
document range and its place in the row of all tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import END_ID, encoder

ROWS_PER_FILE = 8192
BROADCAST_PARTS = 1_000_000
NAMES = ["doc_id", "n_tokens", "ids", "part", "part_start"]


def encode_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """(doc_id, n_tokens, ids, part, part_start) in ascending doc_id order.

    END_ID is appended to every document. part numbers the ranges of doc_id
    and part_start counts the ids before the document in its part.

    Texts are dealt by ranges of doc_id before they are encoded, so finding
    the ranges reads no tokens. Rows with equal ids keep their input order,
    which also splits an id with very many rows over tasks; null ids come
    first. A null text counts as empty.
    """
    parts = max(1, -(-docs.count() // rows_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = encoder(tokenizer).encode([t or "" for t in batch.column(1).to_pylist()], END_ID)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [batch.column(0), np.diff(at), lists, np.full(len(at) - 1, part, np.int32), before + at[:-1]]
            before += int(at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    placed = docs.select(
        F.monotonically_increasing_id().alias("place"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    ordered = placed.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    return ordered.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, part int, part_start long"
    )


def write_store(encoded: DataFrame, path: str) -> None:
    """Write encoded documents, dealt and sorted by doc_id, and their manifest.

    Fails if path exists. An empty table gives a store without documents.
    """
    spark = encoded.sparkSession
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("compression", "zstd")
        .orc(f"{path}/ids")
    )
    parts = (
        spark.read.orc(f"{path}/ids")
        .groupBy("part")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.max("doc_id").alias("last_id"),
            F.count("*").alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
        )
    )
    # One row per part, which is why this window over all of them is small.
    base = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("base", F.coalesce(base, F.lit(0))).write.orc(f"{path}/manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids before the document's.

    The manifest's two columns are broadcast up to BROADCAST_PARTS parts.
    """
    bases = spark.read.orc(f"{path}/manifest").select("part", "base")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    return (
        spark.read.orc(f"{path}/ids")
        .join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")
    )


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """The rows of some ids; the filter reaches the files' indexes and Bloom filters."""
    return spark.read.orc(f"{path}/ids").where(F.col("doc_id").isin(wanted)).select("doc_id", "n_tokens", "ids")


def ids_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that have doc_id, start and ids.

    n_tokens and the unsigned crc32 over little-endian unsigned 32-bit
    integers are taken from the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
