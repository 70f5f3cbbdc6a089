"""Importance resampling towards a target distribution of hashed n-grams.

Every document's features are written once, as a stream of 16-bit bucket
numbers with the offset at which each document begins. The streams are sorted
and run-length encoded chunk by chunk, and the runs summed, for the counts;
then they are read again, and each document's gains gathered and added up
between its offsets. Texts are read once.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8_values

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
#: Bytes of text that are cut into words at once, and features of a chunk of a stream, about.
SLICE_BYTES = 1 << 20
CHUNK_FEATURES = 1 << 20
#: Scores in one group of the ranking.
SCORE_STEP = 256

STREAM = "doc_ids array<long>, n_words array<long>, offsets array<long>, buckets binary"

# a word's octets as they are, capitals as small letters, all others white
_WORD_OCTETS = bytes(
    ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i >= 128 else 32 for i in range(256)
)


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE_BYTES that end between words; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def feature_buckets(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every word and pair of neighbouring words (uint16)."""
    n, parts, before = 0, [], None
    for piece in _slices(text.translate(_WORD_OCTETS)):
        words = piece.split()
        if not words:
            continue
        n += len(words)
        singles = [zlib.crc32(w) for w in words]
        firsts = singles if before is None else [before, *singles]
        seconds = words[1:] if before is None else words
        pairs = [zlib.crc32(b" " + w, c) for w, c in zip(seconds, firsts, strict=False)]
        parts += [np.array(singles, np.uint32), np.array(pairs, np.uint32)]
        before = singles[-1]
    every = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return n, (every % BUCKETS).astype(np.uint16)


def bucket_streams(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """STREAM rows: buckets holds little-endian uint16, document i's from offsets[i] to offsets[i + 1].

    A chunk closes once it has CHUNK_FEATURES features, so its size is bounded
    by that and one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, parts, total = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
                n, found = feature_buckets(text)
                ids.append(doc_id)
                words.append(n)
                parts.append(found)
                total += len(found)
                if total >= CHUNK_FEATURES:
                    yield _chunk(ids, words, parts)
                    ids, words, parts, total = [], [], [], 0
            if ids:
                yield _chunk(ids, words, parts)

    slim = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, STREAM)


def _chunk(ids: list, words: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids], longs),
            pa.array([words], longs),
            pa.array([offsets], longs),
            pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary()),
        ],
        ["doc_ids", "n_words", "offsets", "buckets"],
    )


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) over all streams: each chunk sorted and run-length encoded, runs of a bucket summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                each = np.sort(np.frombuffer(value.as_buffer() or b"", "<u2"))
                starts = np.flatnonzero(np.concatenate((each[:1] == each[:1], each[1:] != each[:-1])))
                lengths = np.diff(np.concatenate((starts, [len(each)])))
                yield pa.RecordBatch.from_arrays([pa.array(each[starts].astype(np.int32)), pa.array(lengths, pa.int64())], ["bucket", "n"])

    runs = streams.select("buckets").mapInArrow(run, "bucket int, n long")
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> np.ndarray:
    """Counts as an array of BUCKETS numbers."""
    found, out = counts.toArrow(), np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, by how much its smoothed share in the target exceeds that in the source, in thousandths of a nat."""
    s_all, t_all = int(source.sum()), int(target.sum())
    ratios = [(int(t) + 1.0) * (s_all + BUCKETS) / ((int(s) + 1.0) * (t_all + BUCKETS)) for s, t in zip(source, target, strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths, from the id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(streams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document: gains gathered by bucket, added between offsets."""
    shared = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, octets in zip(*(batch.column(i) for i in range(4)), strict=True):
                at, buckets = np.array(offsets.as_py(), np.int64), np.frombuffer(octets.as_buffer(), "<u2")
                n, doc_ids = np.diff(at), ids.as_py()
                weight, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
                if len(some):
                    weight[some] = np.add.reduceat(shared.value[buckets], at[some]) // n[some]
                score = weight + np.array([noise(i, seed) for i in doc_ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), words.values, pa.array(n), pa.array(weight), pa.array(score)],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return streams.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Draw percent of the documents, the likelier the closer to the target texts, without replacement.

    Features are words of letters, digits and all beyond ASCII, capitals of
    ASCII as small letters, and pairs of neighbouring words. weight is the
    floored mean of their gains, score adds the id's own Gumbel noise; of
    the N documents of at least min_words words the floor(percent * N / 100)
    highest scores are drawn and get rank 1, 2, ..; the rank of others is
    null. Returns doc_id, n_features, weight, score and rank of every row.

    Null texts have no features and weight 0; null ids share one noise, which
    is that of an empty id. Ties go to the smaller id, null last; rows that
    repeat an id are ranked each by itself. No target, or an empty one, counts
    as equal shares of all buckets. An empty table gives no rows.
    """
    streams = materialize(bucket_streams(docs, id_col, text_col), "bucket-streams", "zstd")
    aim = bucket_streams(target.select(F.lit(0).alias("item"), F.col(target_text).alias("text")), "item", "text")
    gain = gains(_dense(bucket_counts(streams)), _dense(bucket_counts(aim)))
    scored = materialize(weights(streams, gain, seed), "resample-scores")
    ranked = _ranked(scored.where(F.col("n_words") >= min_words), percent)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """The rows with rank among all by falling score and rising id, null beyond the drawn share.

    Rows are numbered within a score; the numbers before it are summed from
    counts per score, first within steps of scores, then over the steps.
    """
    step = F.floor(F.col("score") / SCORE_STEP)
    counts = scored.groupBy("score").agg(F.count("*").alias("n")).withColumn("step", step)
    steps = counts.groupBy("step").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = steps.select("step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ahead, "step")
    bases = bases.select("score", (F.col("ahead") + F.col("inside")).alias("base"), F.floor(F.col("total") * percent / 100).alias("drawn"))
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    rank: Column = F.col("base") + F.col("nth")
    numbered = scored.withColumn("nth", nth).join(bases, "score")
    return numbered.withColumn("rank", F.when(rank <= F.col("drawn"), rank).cast("long"))
