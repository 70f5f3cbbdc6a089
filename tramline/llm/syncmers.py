"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is its sequence of words. Of every K consecutive words the hashes of
the word pairs inside are looked at; if the least of them is the first or the
last one, the K words are an anchor. Whether they are depends on those K words
alone, not on what stands around them, so a passage keeps its anchors wherever
it is moved, and any K - S + 1 consecutive places hold at least one of them.

A fingerprint lists the anchors in order. Two fingerprints are matched by
position: the shift is sought by which most shared anchors lie apart, and the
anchors that agree under it count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of an anchor, and of the substrings inside it.
K, S = 8, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents are put in order in blocks of about so many rows, or more where there would be too many blocks.
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 16
LEAST_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is formed once, however often and within whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(text: Column) -> Column:
    """The closed syncmers of a text, in order: array<struct<pos int, hash long>>.

    pos is the number of the first word from 0, hash 32 bits. A text without
    a syncmer, such as one of fewer than K words, has all its words as one
    anchor; a text without words, or a null, has none.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return _let(words, _word_anchors)


def _word_anchors(words: Column) -> Column:
    whole = F.struct(F.lit(0).alias("pos"), _low32(F.xxhash64(words)).alias("hash"))
    found = _let(_pair_hashes(words), _chosen)
    return F.when(F.size(words) == 0, F.slice(F.array(whole), 1, 0)).otherwise(
        _let(found, lambda f: F.when(F.size(f) == 0, F.array(whole)).otherwise(f))
    )


def _pair_hashes(words: Column) -> Column:
    """The hash of each word with the next one; the last is null."""

    def pairs(h: Column) -> Column:
        return F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: a.bitwiseXOR(_rotated(b)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), pairs)


def _rotated(x: Column) -> Column:
    return F.shiftleft(x, 17).bitwiseOR(F.shiftrightunsigned(x, 47))


def _chosen(pairs: Column) -> Column:
    """The anchors among all places: those whose least pair is at an edge."""
    last = K - S
    aligned = F.arrays_zip(*[F.slice(pairs, i + 1, F.size(pairs)).alias(f"p{i}") for i in range(last + 1)])

    def at(x: Column, pos: Column) -> Column:
        edge = F.least(x["p0"], x[f"p{last}"])
        inner = F.least(*[x[f"p{i}"] for i in range(1, last)])
        covered = F.xxhash64(*[x[f"p{i}"] for i in range(0, last + 1, S)])
        whole = x[f"p{last}"].isNotNull() & (edge <= inner)
        return F.when(whole, F.struct(pos.alias("pos"), _low32(covered).alias("hash")))

    return F.filter(F.transform(aligned, at), lambda x: x.isNotNull())


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 32) - 1))


def fingerprint(found: Column) -> Column:
    """Anchors as text: of each, one hex digit for the distance from the one before and eight for its hash.

    A distance is at most K - S, as every anchor has another one so near.
    """

    def steps(f: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(f, lambda x: x["pos"]))
        return F.zip_with(f, F.slice(before, 1, F.size(f)), lambda x, b: F.concat(F.lower(F.hex(x["pos"] - b)), F.lpad(F.lower(F.hex(x["hash"])), 8, "0")))

    return F.array_join(_let(found, steps), "")


def likeness(a: Column, b: Column) -> Column:
    """Anchors that agree by hash and, under one shift, by position, over all there are in either: 0 to 1.

    The shift is the most frequent one among neighbours in the common order of
    hashes, ties to the smaller. Two texts without words are alike.
    """

    def sided(found: Column, side: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["pos"].alias("pos")))

    def shifts(both: Column) -> Column:
        met = F.zip_with(
            both, F.slice(both, 2, F.size(both)), lambda x, y: F.when((x["hash"] == y["hash"]) & (x["side"] < y["side"]), x["pos"] - y["pos"])
        )
        return F.sort_array(F.filter(met, lambda s: s.isNotNull()))

    def matched(shift: Column) -> Column:
        def placed(found: Column, by: Column) -> Column:
            return F.transform(found, lambda x: F.shiftleft(x["hash"], 31).bitwiseXOR((x["pos"] + by).cast("long")))

        return F.when(shift.isNull(), F.lit(0)).otherwise(F.size(F.array_intersect(placed(a, F.lit(0)), placed(b, shift))))

    shared = _let(_let(_let(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), shifts), _mode), matched)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(_let(shared, lambda m: m.cast("double") / (total - m)))


def _mode(values: Column) -> Column:
    """The most frequent value of a sorted array, ties to the smaller; null if it is empty."""
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(None).cast("int").alias("best"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["at"] == x, s["run"] + 1).otherwise(1)
        return _let(
            run,
            lambda r: F.struct(
                x.alias("at"), r.alias("run"),
                F.when(r > s["most"], x).otherwise(s["best"]).alias("best"), F.greatest(r, s["most"]).alias("most"),
            ),
        )

    return F.aggregate(values, start, step)["best"]


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, block, guest, order columns): each document beside the one of the next smaller id.

    The document of the smallest id is followed by that of the greatest; null
    ids are smaller than all others. Rows that repeat an id follow one another
    by the hash of their texts, then the texts. A null text is empty.

    Ranges of ids of about BLOCK_ROWS rows are the blocks, each sorted by
    itself, so texts are dealt out once; the bounds come from a pass over the
    ids alone. A block also gets a copy of the next one's first rows (guest),
    to be left out of what the caller returns.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    ids = docs.select(key.alias("k"))
    blocks = min(max(1, -(-ids.count() // BLOCK_ROWS)), MOST_BLOCKS)
    ranged = ids.repartitionByRange(blocks, F.desc("k")).groupBy(F.spark_partition_id().alias("b")).agg(F.max("k").alias("first"))
    firsts = sorted((r["first"] for r in ranged.collect()), reverse=True) or [LEAST_ID]
    bounds = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key.alias("k"), _block_of(key, bounds, len(firsts)).alias("own"))
    before = F.pmod(F.col("own") - 1, F.lit(len(firsts)))
    own, guest = (F.struct(b.alias("block"), F.lit(g).alias("guest")) for b, g in ((F.col("own"), 0), (before, 1)))
    placed = F.when(F.get(bounds, F.col("own")) == F.col("k"), F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.withColumn("place", F.explode(placed)).select("doc_id", "text", "k", F.xxhash64("text").alias("h"), "place.*")
    return dealt.withColumn("next_text", F.lead("text").over(_in_order()))


def _in_order() -> Window:
    return Window.partitionBy("block").orderBy("guest", F.desc("k"), F.desc_nulls_last("doc_id"), "h", "text")


def _block_of(key: Column, bounds: Column, blocks: int) -> Column:
    """The last block whose first key isn't smaller than key, by halving; bounds fall."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(blocks - 1).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        def halved(m: Column) -> Column:
            right = F.struct(m.alias("lo"), s["hi"].alias("hi"))
            left = F.struct(s["lo"].alias("lo"), F.greatest(m - 1, s["lo"]).alias("hi"))
            return F.when(F.get(bounds, m) >= key, right).otherwise(left)

        return _let(F.shiftright(s["lo"] + s["hi"] + 1, 1), halved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(blocks.bit_length())), start, step)["lo"]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of an edited text, and their likeness.

    The edited text is the document's with its last half (rounded down) of
    code points replaced by the first as many, or all, of the next document:
    see with_next_text() for the order and for null and repeated ids. Returns
    per row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, the likeness to the edited text and to the next
    document. A lone document is its own next one. Empty texts are alike, with
    empty fingerprints; an empty table gives no rows; other columns are
    ignored.
    """
    sided = with_next_text(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    kept, taken = F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half)
    cut = sided.withColumns({"n_chars": n.cast("long"), "edited": F.concat(kept, taken)})
    marked = cut.withColumns({"own": anchors(F.col("text")), "changed": F.when(F.col("guest") == 0, anchors(F.col("edited")))})
    beside = marked.withColumn("following", F.coalesce(F.lead("own").over(_in_order()), F.col("own")))
    return beside.where("guest = 0").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
