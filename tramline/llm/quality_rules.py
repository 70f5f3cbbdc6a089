"""Quality rules whose thresholds adapt to language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8_values

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Sketches hold bins whose bounds grow by this factor, so quantiles are within 2 %.
GAMMA = 1.02
#: Texts that a parent's quartiles count as, against those of a group itself.
PARENT_TEXTS = 100
FENCE = 3.0
#: Standard errors by which a document must lie beyond a fence.
SURE = 3.0
#: metric: (what is counted, per what, times, how many make one event)
RATES = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 2 * WINDOW_WORDS),
    "word_length": ("word_chars", "n_words", 100, 1),
}
TWO_SIDED = ("word_length",)

_WHITE = b" \t\n\v\f\r"
_NOT_STARTS = bytes(range(128, 192))


def count_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a UTF-8 text, then its number of lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _WHITE + _NOT_STARTS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        words_in_repeats(words),
        len(lines),
    )


def words_in_repeats(words: list[bytes]) -> int:
    """How many words lie in a window of WINDOW_WORDS that occurs twice or more."""
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words) or len(words) <= WINDOW_WORDS:
        return 0
    window = at
    for k in range(1, WINDOW_WORDS):  # windows of k + 1 words, numbered
        pairs = window[:-1] * len(number) + at[k:]
        window = np.unique(pairs, return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + WINDOW_WORDS, -1)
    return int((np.cumsum(inside) > 0).sum())


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source, COUNTS and n_lines of every row; null lang or source is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([count_text(t) for t in utf8_values(batch.column(3))], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(found[:, i]) for i in range(6)]],
                ["doc_id", "lang", "source", *COUNTS, "n_lines"],
            )

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
    )
    fields = ", ".join(f"{c} long" for c in (*COUNTS, "n_lines"))
    return slim.mapInArrow(run, f"doc_id long, lang string, source string, {fields}")


def metrics() -> dict[str, Column]:
    """Each metric as a whole number, rounded down."""
    return {
        name: F.floor(F.col(part) * times / F.greatest(F.col(whole), F.lit(1))).cast("long")
        for name, (part, whole, times, _) in RATES.items()
    }


def sure_values() -> dict[str, tuple[Column, Column]]:
    """Of each metric the least and the greatest value that a document's size leaves likely.

    Events are taken to scatter like independent ones, by the root of their
    number; a mean word length by half of it over the root of the words. So a
    single symbol in a short text proves nothing, and no fixed least count is
    needed.
    """
    out = {}
    for name, (part, whole, times, event) in RATES.items():
        size, n = F.greatest(F.col(whole), F.lit(1)).cast("double"), F.col(part).cast("double")
        if name in TWO_SIDED:
            error = SURE * 0.5 * n / F.sqrt(size)
        else:
            error = SURE * F.sqrt(n / event) * event
        out[name] = ((n - error) * times / size, (n + error) * times / size)
    return out


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketches of column value per by: rows by..., bin, n.

    Bin 0 is the value 0, bin i > 0 has values up to GAMMA ** i. Sketches of
    parts of a table merge by adding n, so a coarser grouping is made from a
    finer one.
    """
    bin_ = F.when(F.col("value") <= 0, 0).otherwise(1 + F.ceil(F.log(F.col("value").cast("double")) / F.log(F.lit(GAMMA))))
    return values.groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by..., rows, q1, q3 from sketches, whose number of bins is bounded."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") - 1))
    placed = sketches.select(*by, "n", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("rows"))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value")))

    return placed.groupBy(*by).agg(F.max("rows").alias("rows"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, low_<metric>, high_<metric>): Tukey's far fences, FENCE spreads off the middle half.

    Quartiles are those of the texts that differ in their counts, so that
    copies of one text count once. They shrink from group to language to all,
    by PARENT_TEXTS texts against the group's own, so a new group has its
    parent's thresholds and grows into its own.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics().items()])
    texts = counts.where(F.col("n_words") >= MIN_WORDS).select("lang", "source", *COUNTS, "n_lines").distinct()
    values = texts.select("lang", "source", F.explode(pairs).alias("m"))
    fine = materialize(sketch(values.select("lang", "source", "m.*"), ["lang", "source", "metric"]), "quality-sketch")
    own = quartiles(fine, ["lang", "source", "metric"])
    lang = quartiles(merged(fine, ["lang", "metric"]), ["lang", "metric"])
    every = quartiles(merged(fine, ["metric"]), ["metric"])
    names = ("rows", "q1", "q3")
    lang = lang.withColumnsRenamed({c: f"lang_{c}" for c in names})
    every = every.withColumnsRenamed({c: f"every_{c}" for c in names})
    placed = own.join(lang, ["lang", "metric"]).join(every, ["metric"])

    def shrunk(rows: Column, q: Column, parent: Column) -> Column:
        return (rows * q + PARENT_TEXTS * parent) / (rows + PARENT_TEXTS)

    for q in ("q1", "q3"):
        parent = shrunk(F.col("lang_rows"), F.col(f"lang_{q}"), F.col(f"every_{q}"))
        placed = placed.withColumn(q, shrunk(F.col("rows"), F.col(q), parent))
    spread = FENCE * (F.col("q3") - F.col("q1"))
    cut = placed.select("lang", "source", "metric", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    wide = [
        F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{side}_{k}")
        for k in RATES
        for side in ("low", "high")
    ]
    return materialize(cut.groupBy("lang", "source").agg(*wide), "quality-fences")


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, kept, and broken, the metrics outside.

    Words lie between ASCII white space. base_failed: fewer than MIN_WORDS
    words, or over MAX_REPEAT_PERCENT % of them in windows of five that occur
    again. kept: not base_failed and no metric surely outside the fences of its
    language and source; see fences() and sure_values(). A null text has no
    words; null language or source is the group of the empty one. Null ids
    are carried, repeated rows judged each, an empty table stays empty.
    """
    counts = materialize(text_counts(docs, id_col, text_col, lang_col, source_col), "quality-counts")
    judged = counts.join(fences(counts), ["lang", "source"], "left")
    broken = []
    for k, (least, most) in sure_values().items():
        out = least > F.col(f"high_{k}")
        broken.append(F.when(out | (most < F.col(f"low_{k}")) if k in TWO_SIDED else out, F.lit(k)))
    outside = F.filter(F.array(*broken), lambda x: x.isNotNull())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumns({"base_failed": failed, "broken": outside}).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken"
    )
