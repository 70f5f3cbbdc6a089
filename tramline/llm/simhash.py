"""SimHash near-duplicate detection.

Fingerprints are cut into blocks. If at most d bits differ and there are m
blocks, some m - d blocks agree in full (pigeonhole), so every close pair
meets under at least one combination of m - d blocks. Members of a bucket are
verified by Hamming distance and linked by a spanning forest, never by all
their pairs; buckets too large for one task are cut by finer combinations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8_values
from .components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text.

    A-Z is lower-cased; words lie between ASCII white space; every shingle
    counts as often as it occurs. A text of fewer words has one shingle, the
    whole sequence; a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - words_per_shingle + 1, 1)
    tails = ends[-last:] if last > 1 or len(words) >= words_per_shingle else ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[i:j], SEED) for i, j in zip(starts[:last].tolist(), tails.tolist(), strict=True)),
        np.uint64,
        last,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 1 << 16):  # the unpacked bits stay small for a text of any length
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the fingerprint's bits as a signed long.

    A null text counts as empty. Null ids are carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in utf8_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(bits.view(np.int64))], ["doc_id", "fp"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def spanning_links(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of members within max_bits of each other."""
    x = np.unique(members.view(np.uint64))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= max_bits
    left, out = np.ones(len(x), bool), []
    for seed in range(len(x)):
        if not left[seed]:
            continue
        left[seed], stack = False, [seed]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            out += [(at, int(k)) for k in found]
            stack += found.tolist()
    signed = x.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in out]


def near_links(
    fps: DataFrame, max_bits: int = 4, blocks: tuple[int, ...] = (6, 8), bucket_rows: int = 1024
) -> DataFrame:
    """Links (a, b) whose components are those of 'at most max_bits differ'.

    fps has one row per fingerprint in column fp. Each level uses one number
    of blocks. A bucket of at most bucket_rows members is verified in one
    task. Members of larger buckets go to the next, finer level, where every
    close pair among them meets again; after the last level large buckets are
    cut into pieces and every two pieces are verified together, so no link is
    lost at any size.
    """
    pool, links = fps.select("fp"), []
    for level, m in enumerate(blocks):
        keyed = _keyed(pool, m, max_bits)
        sizes = materialize(
            keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets"
        )
        small = keyed.join(sizes.where(F.col("n") <= bucket_rows).drop("n"), ["kind", "key"], "left_semi")
        links.append(_linked(small, ["kind", "key"], max_bits))
        hot = sizes.where(F.col("n") > bucket_rows)
        if hot.isEmpty():
            break
        if level + 1 < len(blocks):
            pool = materialize(
                keyed.join(hot.drop("n"), ["kind", "key"], "left_semi").select("fp").distinct(), "simhash-hot"
            )
        else:
            pieces = F.ceil(F.col("n") / bucket_rows)
            cut = keyed.join(hot, ["kind", "key"]).withColumns(
                {"pieces": pieces, "own": F.pmod(F.xxhash64("fp"), pieces)}
            )
            pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns(
                {"p": F.least("own", "other"), "q": F.greatest("own", "other")}
            )
            links.append(_linked(pairs, ["kind", "key", "p", "q"], max_bits))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _keyed(fps: DataFrame, m: int, max_bits: int) -> DataFrame:
    edges = [round(BITS * i / m) for i in range(m + 1)]
    keys = []
    for kind, chosen in enumerate(combinations(range(m), m - max_bits)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(
            F.struct(F.lit(kind).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key"))
        )
    return fps.select("fp", F.explode(F.array(*keys)).alias("at")).select("fp", "at.kind", "at.key")


def _linked(members: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            pairs = [p for i, j in zip(at, at[1:], strict=False) for p in spanning_links(values[i:j], max_bits)]
            table = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

    grouped = members.groupBy(*by).agg(F.collect_list("fp").alias("members"))
    return grouped.select("members").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4
) -> DataFrame:
    """Group documents whose fingerprints are linked by chains of close pairs.

    Returns one row per input row: doc_id, fingerprint (16 lowercase hex
    digits), component_id (smallest doc_id reachable; null only if all are
    null) and size (rows in the component). Texts without words have
    fingerprint zero and link like any other. Equal fingerprints are one node,
    so large groups of exact copies cost one row. An empty table gives an
    empty result. Other columns of docs are ignored.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "simhash-docs")
    nodes = materialize(
        own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes"
    )
    labels = connected_components(near_links(nodes, max_bits))
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    groups = materialize(
        linked.groupBy("root").agg(F.min("first_id").alias("group_id"), F.sum("n").alias("group_n")),
        "simhash-groups",
    )
    grouped = labels.join(groups, "root").select(F.col("node").alias("fp"), "group_id", "group_n")
    classes = materialize(
        nodes.join(grouped, "fp", "left").select(
            "fp",
            F.coalesce("group_id", "first_id").alias("component_id"),
            F.coalesce("group_n", "n").alias("size"),
        ),
        "simhash-classes",
    )
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "size"
    )
