import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tramline.llm import syncmers

from .samples import DOCS, ODD, documents, words


@pytest.fixture(scope="module")
def pair_hashes(spark):
    """The hash of two words, as the engine forms it."""

    def of(texts):
        vocabulary = sorted({w for t in texts for w in t.split()})
        rows = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()
        one = {r["w"]: r["h"] % (1 << 64) for r in rows}

        def pair(a, b):
            x = one[a] ^ ((one[b] << 17 | one[b] >> 47) % (1 << 64))
            return x - (1 << 64) if x >> 63 else x

        return pair

    return of


def found_in(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["a"] for r in rows.select("i", syncmers.anchors(F.col("text")).alias("a")).orderBy("i").collect()]


def test_anchors_are_the_closed_syncmers(spark, pair_hashes):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words(rng, 12)) for _ in range(n)) for n in (8, 9, 30, 200)] + [" ".join(words(rng, 150))]
    pair = pair_hashes(texts)
    for text, found in zip(texts, found_in(spark, texts), strict=True):
        w = text.split()
        wanted = []
        for i in range(len(w) - syncmers.K + 1):
            inner = [pair(w[j], w[j + 1]) for j in range(i, i + syncmers.K - 1)]
            if min(inner) in (inner[0], inner[-1]):
                wanted.append(i)
        assert [a["pos"] for a in found] == (wanted or [0])
        assert all(b - a <= syncmers.K - syncmers.S for a, b in zip(wanted, wanted[1:], strict=False))


def test_anchors_are_free_of_context(spark):
    rng = random.Random(6)
    middle, before, after = words(rng, 80), words(rng, 33), words(rng, 20)
    alone, inside = found_in(spark, [" ".join(middle), " ".join(before + middle + after)])
    moved = [(a["pos"] - 33, a["hash"]) for a in inside if 33 <= a["pos"] <= 33 + 80 - syncmers.K]
    assert moved and moved == [(a["pos"], a["hash"]) for a in alone]


def test_short_and_empty_texts(spark):
    none, blank, one, few, same = found_in(spark, [None, " \t\n", "word", "a b c", "x " * 30])
    assert none == blank == [] and len(one) == len(few) == 1 and one[0]["pos"] == 0
    assert [a["pos"] for a in same] == list(range(23)) and len({a["hash"] for a in same}) == 1


def test_fingerprint_lists_distances_and_hashes(spark):
    text = " ".join(words(random.Random(7), 60))
    row = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(F.col("text")).alias("a"), syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f")).first()
    parts, at = [row["f"][i : i + 9] for i in range(0, len(row["f"]), 9)], 0
    for part, anchor in zip(parts, row["a"], strict=True):
        at += int(part[0], 16)
        assert (at, int(part[1:], 16)) == (anchor["pos"], anchor["hash"])


def test_likeness_follows_a_shift(spark):
    rng = random.Random(8)
    w = words(rng, 120)
    cases = [(w, w), (w, words(rng, 50) + w), (w, words(rng, 120)), (w, w[:60] + words(rng, 60)), ([], []), (w, [])]
    rows = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    marked = rows.select("i", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    out = [(r["a"], r["b"], r["x"]) for r in marked.withColumn("x", syncmers.likeness(F.col("a"), F.col("b"))).orderBy("i").collect()]
    for a, b, x in out:
        best = 0
        for shift in {p["pos"] - q["pos"] for p in a for q in b if p["hash"] == q["hash"]}:
            best = max(best, len({(p["hash"], p["pos"]) for p in a} & {(q["hash"], q["pos"] + shift) for q in b}))
        assert x == (1.0 if not a and not b else best / (len(a) + len(b) - best))
    same, moved, other, half, *_ = (x for _, _, x in out)
    assert same == 1 and moved > 0.6 and other == 0 and 0.2 < half < 0.5


@pytest.mark.parametrize("rows_a_block", [1024, 7])
def test_edits_take_the_next_text(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(syncmers, "BLOCK_ROWS", rows_a_block)
    rows = documents(50) + [r for r in ODD if r[0] is None or r[0] < 0 or r[0] == 4]
    rows = [(r[0], r[1]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), h[r[1]]))
    wanted = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following))
    found = syncmers.edited_fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted((str(w[0]), *w[1:3]) for w in wanted)
    prints = {r["edited_sha256"]: r["edited_fingerprint"] for r in found}
    texts = spark.createDataFrame([(w[2], w[3]) for w in wanted], "s string, text string").select("s", syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f"))
    assert prints == {r["s"]: r["f"] for r in texts.collect()}
    by_text = {}
    for r in found:
        if r["doc_id"] is not None and 0 <= r["doc_id"] < 50 and r["doc_id"] != 4:
            by_text.setdefault(rows[r["doc_id"]][1], set()).add(r["fingerprint"])
    assert len(by_text) < 50 and all(len(v) == 1 for v in by_text.values())


def test_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumnRenamed("place", "block")
    found = syncmers.edited_fingerprints(docs).collect()
    assert len(found) == len(ODD) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in found)
    assert syncmers.edited_fingerprints(docs.limit(0)).collect() == []
    lone = syncmers.edited_fingerprints(docs.where("doc_id = 7")).first()
    assert lone["near_next"] == 1.0


def test_no_python_on_the_main_path(spark):
    plan = syncmers.edited_fingerprints(spark.createDataFrame(ODD, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
