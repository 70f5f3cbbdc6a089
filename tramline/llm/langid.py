"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8_values

LANGUAGES = ("de", "en", "es", "fr")
GRAM_BUCKETS = 8192
#: Documents that each declaration counts as having met beforehand in its own language, and in any.
AGREED, MET = 9, 1


def gram_buckets(text: bytes) -> np.ndarray:
    """Hash buckets of a UTF-8 text's byte trigrams.

    A-Z is lower-cased; white space, digits and ASCII punctuation are one
    separator, and trigrams without a letter are left out.
    """
    octets = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8)
    octets = octets[np.append(True, (octets[1:] != 32) | (octets[:-1] != 32))].astype(np.uint32)
    if len(octets) < 3:
        return np.zeros(0, np.uint32)
    return ((octets[:-2] * 961 + octets[1:-1] * 31 + octets[2:]) * np.uint32(2654435761)) >> np.uint32(19)


_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def gram_counts(docs: DataFrame, text_col: str, declared_col: str, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Trigrams (language, bucket) of all declared texts.

    Counted per partition, then summed by a grouped aggregation; what reaches
    the driver is at most languages x GRAM_BUCKETS rows at any input size.
    """
    names = list(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), GRAM_BUCKETS), np.int64)
        for batch in batches:
            for text, lang in zip(utf8_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[names.index(lang)] += np.bincount(gram_buckets(text), minlength=GRAM_BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])],
            ["lang", "bucket", "n"],
        )

    told = docs.select(F.col(text_col).alias("text"), F.col(declared_col).alias("lang")).where(
        F.col("lang").isin(names)
    )
    sums = told.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), GRAM_BUCKETS))
    for row in sums.toLocalIterator():
        counts[row["lang"], row["bucket"]] += row["n"]
    return counts


def text_evidence(
    docs: DataFrame,
    text_col: str,
    declared_col: str,
    counts: np.ndarray,
    carried: dict[str, Column],
    languages: Sequence[str] = LANGUAGES,
    grams: int = 100,
    smoothing: float = 0.5,
) -> DataFrame:
    """The carried columns and ll, an array of log likelihoods by language.

    counts are gram_counts() of the same rows. Of a text's own trigrams the
    share n / (n + grams) is taken off those of its declared language, where n
    are that language's trigrams in other rows: beside others, a declaration
    teaches next to nothing about its own text (copies of it still do), and
    the only text of a language still tells of it. Neighbouring trigrams overlap, so a
    whole text's evidence counts as that of at most grams independent ones.
    An empty or null text has all zeros.
    """
    kinds = docs.select(*[c.alias(k) for k, c in carried.items()]).schema
    carry, names = list(carried), list(languages)
    seen = counts + smoothing
    sums = seen.sum(1)
    table = np.log(seen / sums[:, None])

    def likelihoods(text: bytes, declared: str | None) -> np.ndarray:
        found, own = np.unique(gram_buckets(text), return_counts=True)
        if not len(found):
            return np.zeros(len(names))
        total = int(own.sum())
        logs = table[:, found]
        if declared in names:
            at = names.index(declared)
            others = counts[at].sum() - total
            share = others / (others + grams)
            logs[at] = np.log((seen[at, found] - share * own) / (sums[at] - share * total))
        return logs @ own * (min(total, grams) / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1).to_pylist()
            rows = [likelihoods(t, d) for t, d in zip(utf8_values(batch.column(0)), told, strict=True)]
            out = np.array(rows).reshape(-1, len(names))
            at = pa.array(np.arange(0, out.size + 1, len(names), dtype=np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], [*carry, "ll"])

    own = [F.col(text_col).alias("text"), F.col(declared_col).cast("string").alias("declaration")]
    slim = docs.select(*own, *[c.alias(k) for k, c in carried.items()])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields)
    return slim.mapInArrow(run, f"{fields}, ll array<double>")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    min_posterior: float = 0.6,
    strength: float = 20.0,
) -> DataFrame:
    """One row per input row: doc_id, language, posterior, text_language, declared, kept.

    Four sources are fused as independent evidence about the language:
    the text's trigram likelihoods, learnt from what other texts declare, so
    that a declaration doesn't count twice; the declared (markup) language,
    through how often each declaration comes with each language, beside a
    few made-up documents that declare their own language; the address suffix,
    the same way; and the host's prior, whose shares shrink with the given
    strength from host to registered domain to all documents. All tables come
    from grouped aggregations over all documents, weighting each by its
    text-only posterior. host is a column of host names (documents: their
    source); null or empty means no address.

    kept is true if the best language reaches min_posterior. Rows without any
    evidence get the overall prior. Declarations that aren't among languages
    count as one kind, null as another. Ties go to the earlier language. Null
    ids are carried and repeated rows judged each; an empty table stays empty.
    """
    names = list(languages)
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    host = F.lit(None).cast("string") if host is None else host
    frame = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        declared.alias("declared"),
        F.when(host != "", host).alias("host"),
    )
    counts = gram_counts(frame, "text", "declared", names)
    told = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("?"))
    dotted = F.col("host").contains(".")
    carried = {
        "doc_id": F.col("doc_id"),
        "declared": F.col("declared"),
        "told": F.coalesce(told, F.lit("-")),
        "host": F.coalesce("host", F.lit("")),
        "domain": F.coalesce(F.substring_index("host", ".", -2), F.lit("")),
        "suffix": F.coalesce(F.when(dotted, F.substring_index("host", ".", -1)), F.lit("")),
    }
    seen = materialize(text_evidence(frame, "text", "declared", counts, carried, names), "langid-text")
    soft = _posterior(F.col("ll"))
    weights = [F.sum(soft[i]).alias(f"w{i}") for i in range(len(names))]
    w = F.array(*[F.col(f"w{i}") for i in range(len(names))])
    grouped = materialize(
        seen.groupBy("told", "host", "domain", "suffix").agg(*weights).withColumn("w", w), "langid-groups"
    )
    again = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(names))]
    total = grouped.agg(*again).first()
    all_w = [float(x or 0) for x in total]
    overall = [(x + 1) / (sum(all_w) + len(names)) for x in all_w]
    agreed = F.array(*[F.when(F.col("told") == x, float(AGREED)).otherwise(0.0) for x in names])
    told_w = grouped.groupBy("told").agg(*again).select("told", w.alias("w"), agreed.alias("before"))
    by_told = _likelihoods(told_w, all_w, "told_ll")
    suffix_w = grouped.groupBy("suffix").agg(*again).select("suffix", w.alias("w"), F.array_repeat(F.lit(0.0), len(names)).alias("before"))
    by_suffix = _likelihoods(suffix_w, all_w, "suffix_ll")
    prior = F.array(*[F.lit(x) for x in overall])
    domains = grouped.groupBy("domain").agg(*again).select(
        "domain", _shares(w, prior, strength).alias("domain_share")
    )
    domains = materialize(domains, "langid-domains")
    hosts = (
        grouped.groupBy("host", "domain").agg(*again).select("host", "domain", w.alias("w")).join(domains, "domain")
    )
    hosts = materialize(
        hosts.select(
            "host",
            "domain",
            F.transform(_shares(F.col("w"), F.col("domain_share"), strength), lambda x: F.log(x)).alias("prior_ll"),
        ),
        "langid-hosts",
    )
    fused = (
        seen.join(hosts, ["host", "domain"])
        .join(materialize(by_told, "langid-told"), "told")
        .join(materialize(by_suffix, "langid-suffix"), "suffix")
    )
    parts = [F.col(c) for c in ("ll", "told_ll", "prior_ll")]
    suffix_ll = F.when(F.col("suffix") != "", F.col("suffix_ll"))
    score = F.array(
        *[sum((p[i] for p in parts), F.coalesce(suffix_ll[i], F.lit(0.0))) for i in range(len(names))]
    )
    kinds = F.array(*[F.lit(x) for x in names])
    post = fused.withColumn("post", _posterior(score)).withColumn("best", F.array_max("post"))
    return post.select(
        "doc_id",
        F.element_at(kinds, F.array_position("post", F.col("best")).cast("int")).alias("language"),
        F.col("best").alias("posterior"),
        F.element_at(kinds, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_language"),
        "declared",
        (F.col("best") >= min_posterior).alias("kept"),
    )


def _posterior(ll: Column) -> Column:
    """Normalised exponentials of an array of log values."""
    top = F.array_max(ll)
    raised = F.transform(ll, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _shares(w: Column, parent: Column, strength: float) -> Column:
    total = F.aggregate(w, F.lit(0.0), lambda a, y: a + y)
    return F.zip_with(w, parent, lambda x, p: (x + strength * p) / (total + strength))


def _likelihoods(table: DataFrame, all_w: list[float], name: str) -> DataFrame:
    """How probable a kind of evidence is under each language, as logs."""
    met = F.zip_with("w", "before", lambda x, more: x + more + MET)
    totals = F.array(*[F.lit(x + AGREED + 10 * MET) for x in all_w])
    return table.withColumn(name, F.zip_with(met, totals, lambda x, t: F.log(x / t))).drop("w", "before")
