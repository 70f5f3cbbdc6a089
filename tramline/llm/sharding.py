"""Sharding by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Multiplier and increment of the published generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1
LOW32 = (1 << 32) - 1
MAX_JUMPS = 64


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0 .. shards-1 of a 64-bit key; null has the shard of 0.

    A step draws the next number from the key's own sequence and jumps ahead
    in proportion to its inverse; the last place before the end is the shard.
    With one more shard a key stays or moves into the new one. Steps number
    about ln(shards); the error at MAX_JUMPS steps can't be met in practice
    and would stop the job, not misplace a row.

    The 64-bit product is formed from smaller ones, as overflow is an error
    in ANSI mode.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    whole = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(whole, 32).alias("hi"),
        whole.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jumped = F.floor(
            (s["next"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")
        ).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("shard"), jumped.alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    end = F.aggregate(
        steps,
        start,
        step,
        lambda s: F.when(s["next"] >= shards, s["shard"]).otherwise(
            F.raise_error(F.lit("jump hash did not end")).cast("long")
        ),
    )
    return end.cast("int")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Both 32-bit halves of key * MULTIPLIER + INCREMENT modulo 2^64."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    low = lo * F.lit(m_lo & 0xFFFF) + INCREMENT
    middle = F.shiftright(low, 16) + lo * F.lit(m_lo >> 16)
    new_lo = F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))
    high = F.shiftright(middle, 16) + _low_product(lo, m_hi) + _low_product(hi, m_lo)
    return high.bitwiseAND(F.lit(LOW32)), new_lo


def _low_product(x: Column, constant: int) -> Column:
    """The lower 32 bits of a product of two 32-bit numbers."""
    upper = F.shiftleft((x * F.lit(constant >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x * F.lit(constant & 0xFFFF) + upper).bitwiseAND(F.lit(LOW32))


def shard_documents(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 4096
) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, shard, slot, grown_shard.

    shard depends on the id and the number of shards alone; grown_shard is
    the shard if there is one more. size is the text's UTF-8 bytes plus 1,
    and text_crc32 their crc32; a null text counts as empty. slot numbers the
    rows of a shard from 0 without gaps: rows are counted per shard and block
    of input rows, blocks get their first slot from the counts, and rows are
    numbered within their block, so no task holds a shard. Equal and null ids
    share a shard and get slots of their own. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = materialize(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            jump_hash(key, shards).alias("shard"),
            jump_hash(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("place"),
        ).withColumn("block", F.floor(F.col("place") / slot_rows)),
        "shard-rows",
    )
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place")) - 1
    return (
        rows.withColumn("nth", nth.cast("long"))
        .join(bases, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write all columns of docs as Parquet, one folder shard_id=N per shard.

    A shard's rows are dealt over several files, so that a shard may be
    larger than a task. A column named shard_id must not exist.
    """
    if "shard_id" in docs.columns:
        raise ValueError("docs has a column shard_id")
    placed = docs.withColumn("shard_id", jump_hash(F.col(id_col), shards))
    placed.write.partitionBy("shard_id").parquet(path)
