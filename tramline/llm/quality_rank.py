"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, utf8_values

FEATURES = (
    "symbol_share",
    "upper_share",
    "digit_share",
    "bar_share",
    "shout_share",
    "same_word_share",
    "repeat_line_share",
    "word_chars",
    "letter_share",
    "stop_share",
    "log_words",
    "short",
)
THRESHOLD = 0.3
#: Bins of utility by which pairs are summed, parts of one in sums of whole numbers, and the share of the loss that ends the fit.
BINS = 512
FIXED = 2.0**24
TOLERANCE = 1e-4

_ROW, _COLUMN = np.triu_indices(len(FEATURES))
_MAGNITUDE = np.int64(2**63 - 1)
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&<>@^~=_{}[]\\/+"
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def features(text: bytes) -> list[float]:
    """FEATURES of a whole UTF-8 text; an empty one has zeros, and short = 1."""
    size = max(len(text), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(octets: bytes) -> float:
        return (len(text) - len(text.translate(None, octets))) / size

    low = text.lower().split()
    twice = sum(map(bytes.__eq__, low, low[1:]))
    distinct = len(set(low))
    ends = sum(1 for w in words if len(w) <= 3)
    return [
        share(_SYMBOL),
        share(_UPPER),
        share(_DIGIT),
        share(b"|"),
        share(b"!?"),
        max(twice / n, 1 - distinct / n if n > 50 else 0.0),
        1 - len(set(lines)) / max(len(lines), 1),
        min(sum(map(len, words)) / n, 30.0),
        share(_LETTER),
        ends / n,
        float(np.log1p(len(words))),
        float(len(words) < 10),
    ]


class Ranking(NamedTuple):
    """score = sigmoid(slope * (weights . scaled features - cut) + log-odds of THRESHOLD)."""

    centre: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return _weighed(_scaled(x, self.centre, self.scale), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.slope * (self.utility(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def is_held_out(id_col: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == 0


def text_features(docs: DataFrame, carried: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The carried columns and f, the features of each row's text."""
    schema = docs.select(*[c.alias(k) for k, c in carried.items()]).schema
    names = list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t) for t in utf8_values(batch.column(0))]).reshape(-1, len(FEATURES))
            at = pa.array(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(at, pa.array(found.ravel()))], [*names, "f"]
            )

    slim = docs.select(F.col(text_col).alias("text"), *[c.alias(k) for k, c in carried.items()])
    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema.fields)
    return slim.mapInArrow(run, f"{fields}, f array<double>")


def _scaled(x: np.ndarray, centre: list[float], scale: list[float]) -> np.ndarray:
    return np.clip((x - centre) / scale, -6, 6)


def _moments(z: np.ndarray, good: np.ndarray, weights: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Occurring bins of utility, 2 * bin + good, and for each the fixed-point sums of 1, z and z z^T.

    Whole numbers, so that sums of sums don't depend on the order of rows.
    """
    bins = np.clip(((_weighed(z, weights) / reach + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
    kinds, at = np.unique(2 * bins + good, return_inverse=True)
    rows = np.hstack((np.ones((len(z), 1)), z, z[:, _ROW] * z[:, _COLUMN]))
    sums = np.zeros((len(kinds), rows.shape[1]), np.int64)
    np.add.at(sums, at, np.rint(rows * FIXED).astype(np.int64))
    return kinds, sums


def _weighed(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """z @ weights, column by column: the same for a row whatever rows lie beside it."""
    out = np.zeros(len(z))
    for i, w in enumerate(weights):
        out = out + z[:, i] * w
    return out


def _optimum(moments: Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]], rounds: int, ridge: float) -> np.ndarray:
    """The weights of least logistic loss over all pairs of a good and a bad row, by Newton steps.

    Rows of a bin of utility, 1 / BINS of its range, count with the bin's mean.
    """
    weights, step, last = np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), np.inf
    for _ in range(rounds):
        kinds, sums = moments(weights, max(6 * float(np.abs(weights).sum()), 1.0))
        n, first, second = sums[:, 0] / FIXED, sums[:, 1 : 1 + len(FEATURES)] / FIXED, sums[:, 1 + len(FEATURES) :] / FIXED
        u, is_good = first @ weights / n, kinds % 2 == 1
        g, b = is_good, ~is_good
        ahead = np.clip(u[g][:, None] - u[b][None], -40, 40)
        pairs = n[g].sum() * n[b].sum()
        loss = float(n[g] @ np.log1p(np.exp(-ahead)) @ n[b] / pairs + ridge / 2 * weights @ weights)
        if loss > last * (1 + TOLERANCE):  # too far: half the way back
            step = step / 2
            weights = weights - step
            continue
        if loss > last * (1 - TOLERANCE):  # no less but for the bins
            return weights
        lost = 1 / (1 + np.exp(ahead))
        bend = lost * (1 - lost)
        slope = ((lost @ n[b]) @ first[g] - (n[g] @ lost) @ first[b]) / pairs - ridge * weights
        flat = (bend @ n[b]) @ second[g] + (n[g] @ bend) @ second[b]
        square = np.zeros((len(FEATURES), len(FEATURES)))
        square[_ROW, _COLUMN] = square[_COLUMN, _ROW] = flat
        mixed = first[g].T @ bend @ first[b]
        step = np.linalg.solve((square - mixed - mixed.T) / pairs + ridge * np.eye(len(FEATURES)), slope)
        last, weights = loss, weights + step
    return weights


def _cut(ranking: Ranking, bad: int, n: int, ranked: Callable[[list[int]], dict[int, float]]) -> Ranking:
    """The ranking with its cut, the quantile of all fitted utilities that leaves the bad rows' share below it."""
    at = min(max(bad, 1), n - 1)
    lower, upper = (n - 1) * 0.25, (n - 1) * 0.75
    wanted = {at - 1, at, *(min(int(q) + i, n - 1) for q in (lower, upper) for i in (0, 1))}
    u = ranked(sorted(wanted))

    def quantile(q: float) -> float:
        low, high = u[int(q)], u[min(int(q) + 1, n - 1)]
        return low + (high - low) * (q - int(q))

    return ranking._replace(cut=(u[at - 1] + u[at]) / 2, slope=4.0 / max(quantile(upper) - quantile(lower), 1e-6))


def fit_pairs(good: np.ndarray, bad: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> Ranking:
    """Fit utilities to 'each row of good is preferred to each row of bad', of arrays in memory."""
    every = np.concatenate((good, bad)) if len(good) + len(bad) else np.zeros((1, len(FEATURES)))
    centre, scale = every.mean(0).tolist(), (every.std(0) + 1e-6).tolist()
    if not len(good) or not len(bad):  # no preference is known: keep all
        return Ranking(centre, scale, [0.0] * len(FEATURES), -1.0, 1.0)
    z, is_good = _scaled(every, centre, scale), np.arange(len(every)) < len(good)
    weights = _optimum(lambda w, reach: _moments(z, is_good, w, reach), rounds, ridge)
    ranking = Ranking(centre, scale, weights.tolist(), 0.0, 1.0)
    utilities = np.sort(ranking.utility(every))
    return _cut(ranking, len(bad), len(every), lambda ranks: {r: float(utilities[r]) for r in ranks})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rounds: int = 60,
    ridge: float = 1e-4,
) -> Ranking:
    """Fit on all labelled documents that aren't held out, as fit_pairs() does.

    Features are written once; each Newton step is a job that sums them by
    bins of utility, and the driver gets the sums. Of documents that repeat an
    id the one of the least features counts. Rows whose label or id is null
    are left out.
    """
    mark = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~is_held_out(F.col("label_id"))
    )
    own = text_features(
        docs.where(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))), {"label_id": F.col(id_col).cast("long")}, text_col
    )
    rows = own.join(mark.distinct(), "label_id").groupBy("label_id", "label").agg(F.min("f").alias("f"))
    rows = materialize(rows.select((F.col("label") == 1).alias("good"), "f"), "rank-features")
    fixed = [F.sum(F.round(c * 2.0**40).cast("decimal(24,0)")) for i in range(len(FEATURES)) for c in (F.col("f")[i], F.col("f")[i] ** 2)]
    n, n_good, *sums = rows.agg(F.count("*"), F.count_if("good"), *fixed).first()
    means = np.array([float(x or 0) for x in sums]).reshape(-1, 2) / 2.0**40 / max(n, 1)
    centre = means[:, 0].tolist()
    scale = (np.sqrt(np.maximum(means[:, 1] - means[:, 0] ** 2, 0)) + 1e-6).tolist()
    if n_good in (0, n):  # no preference is known: keep all
        return Ranking(centre, scale, [0.0] * len(FEATURES), -1.0, 1.0)
    weights = _optimum(lambda w, reach: _summed(rows, centre, scale, w, reach), rounds, ridge)
    ranking = Ranking(centre, scale, weights.tolist(), 0.0, 1.0)
    keys = materialize(_keys(rows, ranking), "rank-utilities")
    fitted = _cut(ranking, n - n_good, n, lambda ranks: _ranked(keys, ranks))
    discard(rows, keys)
    return fitted


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _summed(rows: DataFrame, centre: list[float], scale: list[float], weights: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """_moments() of all rows (good, f)."""
    names = [f"s{i}" for i in range(1 + len(FEATURES) + len(_ROW))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * BINS, len(names)), np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            kinds, sums = _moments(_scaled(_arrays(batch.column(1)), centre, scale), good, weights, reach)
            total[kinds] += sums
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(met), *map(pa.array, total[met].T.copy())], ["kind", *names])

    parts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["kind", *names]))
    found = parts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in names]).orderBy("kind").toArrow()
    return found.column("kind").to_numpy(), np.stack([found.column(c).to_numpy() for c in names], axis=1)


def _keys(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """key: the utility of each row (good, f) as a whole number of the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (ranking.utility(_arrays(batch.column(0))) + 0.0).view(np.int64)  # no -0.0
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ _MAGNITUDE, bits))], ["key"])

    return rows.select("f").mapInArrow(run, "key long")


def _ranked(keys: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The utilities at the ranks, counted from 0: sixteen bits of the keys after the other, by counts of them."""
    heads = {r: (0, r) for r in ranks}  # leading bits known so far, and the rank among keys that share them
    for shift in (48, 32, 16, 0):
        head = F.shiftright("key", shift)
        known = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16).isin({h for h, _ in heads.values()}))
        counts = known.groupBy(head.alias("head")).count().orderBy("head").toArrow()
        found, n = counts.column("head").to_numpy(), counts.column("count").to_numpy()
        for r, (before, rest) in heads.items():
            here = np.ones(len(found), bool) if shift == 48 else found >> 16 == before
            upto = np.cumsum(n[here])
            at = int(np.searchsorted(upto, rest, "right"))
            heads[r] = (int(found[here][at]), rest - int(upto[at] - n[here][at]))
    bits = np.array([heads[r][0] for r in ranks], np.int64)
    values = np.where(bits < 0, bits ^ _MAGNITUDE, bits).view(np.float64)
    return dict(zip(ranks, values.tolist(), strict=True))


def score_documents(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD) per row.

    Only the text enters the score. A null text counts as empty and is scored
    like any other; null ids are carried; repeated rows are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t) for t in utf8_values(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(found))], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
