"""Packing documents into training sequences of a fixed length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, encoder

SEQUENCE_TOKENS = 2048
GROUP_DOCS = 2048
GROUP_BYTES = 64 << 20
BIN_BITS = 32
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Room left in bins 0.. capacity-1; finds the first bin with enough of it."""

    def __init__(self, bins: int, room: int):
        self._leaves = 1 << max(bins - 1, 0).bit_length()
        self._best = [room] * (2 * self._leaves)

    def take(self, need: int) -> tuple[int, int]:
        """Put need into the first bin that has room: (bin, room used before)."""
        at, best = 1, self._best
        while at < self._leaves:
            at = 2 * at if best[2 * at] >= need else 2 * at + 1
        bin_, left = at - self._leaves, best[at]
        best[at] = left - need
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_, left


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, placed by falling length, ties in order given."""
    tree, out = TournamentTree(len(lengths), room), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, left = tree.take(lengths[i])
        out[i] = (bin_, room - left)
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_docs: int = GROUP_DOCS,
    group_bytes: int = GROUP_BYTES,
    seed: int = 7,
) -> DataFrame:
    """Encode documents and pack them into sequences, one row per piece.

    A document's ids, with the end id, are cut into whole sequences and a
    rest. Rests are packed first-fit decreasing, independently in randomised
    groups of about group_docs documents, or fewer where their texts would
    exceed about group_bytes, so the work and memory of a task don't grow with
    the table. Returns doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id (unique over
    groups, not gapless) and offset (gapless from 0 in its sequence).

    A null or empty text is its end id alone. Null ids are carried; rows that
    repeat an id are packed as documents of their own. The group of a row
    hashes its place in the input with its id, so no id or text can make a
    group large. An empty table gives no pieces.
    """
    rows, octets = docs.agg(F.count("*"), F.sum(F.octet_length(text_col).cast("long"))).first()
    groups = max(1, -(-rows // group_docs), -(-(octets or 0) // group_bytes))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("pack", F.pmod(F.xxhash64("doc_id", "place", F.lit(seed)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")]).combine_chunks()
        texts = [t or "" for t in table["text"].to_pylist()]
        ids, at = encoder(tokenizer).encode(texts, END_ID)
        n = np.diff(at)
        full, rest = n // sequence_tokens, n % sequence_tokens
        doc = np.repeat(np.arange(len(n)), full + (rest > 0))
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full + (rest > 0)) - full - (rest > 0), full + (rest > 0))
        start = nth * sequence_tokens
        length = np.minimum(n[doc] - start, sequence_tokens)
        bins, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        part = length < sequence_tokens
        if part.any():
            placed = np.array(first_fit_decreasing(length[part].tolist(), sequence_tokens))
            bins[part], offset[part] = placed[:, 0], placed[:, 1]
        bins[~part] = (bins[part].max() + 1 if part.any() else 0) + np.arange(int((~part).sum()))
        octets, cuts = ids.astype("<u4").tobytes(), 4 * (at[doc] + start)
        pieces = [octets[i:j] for i, j in zip(cuts.tolist(), (cuts + 4 * length).tolist(), strict=True)]
        pack = table["pack"][0].as_py()
        return pa.table(
            {
                "doc_id": table["doc_id"].take(pa.array(doc)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids": pa.array(pieces, pa.binary()),
                "doc_tokens": pa.array(n[doc]),
                "sequence_id": pa.array((pack << BIN_BITS) + bins),
                "offset": pa.array(offset),
            }
        )

    return dealt.groupBy("pack").applyInArrow(run, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, the unsigned crc32 of their ids, for the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
