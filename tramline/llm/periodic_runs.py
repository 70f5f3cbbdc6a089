"""Passages that repeat themselves at a fixed period, found by probing a harmonic grid.

A run of period p is at least 4 p words long, so at the grid of multiples of
p four neighbouring points lie within it and hold equal words: j p equals
(j + 1) p three times in a row. Over all periods the grids have n ln n points.
What survives is extended to both sides by comparing chunks of the text with
itself p words on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8_values

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
CHUNK = 64
CHUNK_MOST = 1 << 16

RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _same_on(words: np.ndarray, at: int, period: int) -> int:
    """How many words from place at on equal those period words on."""
    most, done, chunk = len(words) - period - at, 0, CHUNK
    while done < most:
        size = min(chunk, most - done)
        i = at + done
        differ = words[i : i + size] != words[i + period : i + period + size]
        if differ.any():
            return done + int(differ.argmax())
        done, chunk = done + size, min(2 * chunk, CHUNK_MOST)
    return done


def _same_before(words: np.ndarray, at: int, period: int) -> int:
    """How many words just before place at equal those period words on."""
    done, chunk = 0, CHUNK
    while done < at:
        size = min(chunk, at - done)
        i = at - done - size
        differ = words[i : i + size] != words[i + period : i + period + size]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done, chunk = done + size, min(2 * chunk, CHUNK_MOST)
    return done


def _grid_survivors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places) by rising period: multiples of it from which on four grid points hold one word.

    Periods go in bands of the same power of two, so a band probes about as
    many points as there are words.
    """
    n, low = len(words), 1
    while low <= n // LEAST_EXPONENT:
        periods = np.arange(low, min(2 * low - 1, n // LEAST_EXPONENT) + 1)
        at = periods[:, None] * np.arange((n - 1) // low + 1)
        inside = at < n
        values = words[np.where(inside, at, 0)]
        equal = (values[:, 1:] == values[:, :-1]) & inside[:, 1:]
        three = equal[:, 2:] & equal[:, 1:-1] & equal[:, :-2]
        for row in np.flatnonzero(three.any(axis=1)):
            yield int(periods[row]), np.flatnonzero(three[row]) * int(periods[row])
        low *= 2


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period.

    A run is a longest stretch in which words period apart are equal, of at
    least LEAST_LENGTH words and LEAST_EXPONENT periods; the period is the
    smallest that the stretch has.
    """
    by_period: dict[int, list[tuple[int, int]]] = {}
    for period, places in _grid_survivors(words):
        for q, found in by_period.items():
            if period % q == 0:  # such a run has this period too, and it isn't the smallest
                starts = np.array([a for a, _ in found])
                ends = np.array([b for _, b in found])
                which = np.searchsorted(starts, places, "right") - 1
                places = places[(which < 0) | (places + period >= ends[np.maximum(which, 0)])]
        own: list[tuple[int, int]] = []
        while len(places):
            at = int(places[0])
            start = at - _same_before(words, at, period)
            end = at + _same_on(words, at, period) + period
            if end - start >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
                own.append((start, end))
            places = places[places >= max(end - period, at + 1)]
        if own:
            by_period[period] = own
    return sorted((a, b - a, p) for p, found in by_period.items() for a, b in found)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One text in ten, chosen by its id, with its end overwritten by a passage repeated over and over.

    A null id leaves the text as it is.
    """
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a space, without those that a run holds after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False) -> DataFrame:
    """RESULT columns of every row: the number of runs, the longest one, and digests of all runs and of the text without repeats.

    Words are parts between ASCII white space, numbered from 0. The longest
    run is that of greatest length, ties to the smaller start, then period;
    exponent_milli is 1000 * length / period, rounded down. All four are null
    without a run. runs_sha256 is that of "start,length,period" lines,
    collapsed_sha256 that of collapsed(). With loops, looped() is applied
    first. A null text has no words; rows that repeat an id, and null ids, are
    judged each by itself; an empty table gives no rows; other columns are
    ignored. A row is worked on alone, and no table is shuffled.
    """

    def judge(doc_id: int | None, text: bytes) -> tuple:
        words = text.split()
        if loops:
            words = looped(words, doc_id)
        runs = periodic_runs(word_numbers(words)) if len(words) >= LEAST_LENGTH else []
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = None if period is None else 1000 * length // period
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()
        return doc_id, len(runs), start, length, period, exponent, *digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            found = [judge(i, t) for i, t in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)
