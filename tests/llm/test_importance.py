import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tramline.llm import importance

from .samples import DOCS, ODD, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(small)
    grams = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return len(w), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(docs, target, percent=25, least=20):
    """The rows by a plain reading of the definition."""
    made = [(i, *features(t)) for i, t in docs]
    source, aim = Counter(b for _, _, f in made for b in f), Counter(b for t in target for b in features(t)[1])
    big_s, big_t = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (big_s + 10000) / ((source[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in made:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    places = Counter()
    ranks = {}
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        ranks[r[0], r[4], places[r[0], r[4]]] = k
        places[r[0], r[4]] += 1
    seen, out = Counter(), []
    for i, n, many, weight, score in rows:
        rank = None
        if n >= least:
            rank = ranks.get((i, score, seen[i, score]))
            seen[i, score] += 1
        out.append((i, many, weight, score, rank))
    return sorted(out, key=repr)


def results(frame):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("chunk", [importance.CHUNK_FEATURES, 50])
def test_rows_equal_the_definition(spark, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK_FEATURES", chunk)
    rows = [(i, t) for i, t, *_ in documents(80)] + [(r[0], r[1]) for r in ODD if r[0] not in (1, 2, 3, 4, 5, 6, 7)]
    target = [t for _, t in rows[:6]] + ["Ünïcode WORDS 12ab, x_y", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = results(importance.resample(docs, aim))
    assert found == plain(rows, target)
    assert sum(r[4] is not None for r in found) > 5


def test_ties_and_repeated_rows(spark):
    text = "the same words " * 10
    rows = [(5, text)] * 8 + [(6, text)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = results(importance.resample(docs, docs.limit(0), percent=50))
    assert found == plain(rows, [], 50)
    assert sorted(r[4] for r in found if r[4]) == [1, 2, 3, 4, 5, 6]


def test_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumnRenamed("label", "rank").withColumnRenamed("fp", "score")
    found = importance.resample(docs, docs)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and found.count() == len(ODD)
    assert importance.resample(docs.limit(0), docs).collect() == []


def test_words_across_slices(monkeypatch):
    text = ("Some words, of VARIOUS length; " * 40 + "x" * 300 + " end").encode()
    whole = importance.feature_buckets(text)
    monkeypatch.setattr(importance, "SLICE_BYTES", 64)
    cut = importance.feature_buckets(text)
    assert whole[0] == cut[0] and Counter(whole[1].tolist()) == Counter(cut[1].tolist())
    assert sorted(whole[1].tolist()) == sorted(features(text.decode())[1])


def test_streams_hold_packed_buckets(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d")], "doc_id long, text string").coalesce(1)
    row = importance.bucket_streams(docs, "doc_id", "text").first()
    assert (row["doc_ids"], row["n_words"], row["offsets"]) == ([1, 2, 3], [3, 0, 1], [0, 5, 5, 6])
    assert np.frombuffer(row["buckets"], "<u2").tolist()[:3] == [zlib.crc32(w) % 10000 for w in (b"a", b"b", b"c")]


def test_documents_like_the_target_are_drawn(spark):
    near = [(i, f"harbour ships sail {i} over quiet water " * 5) for i in range(100)]
    far = [(100 + i, f"engine parts need {i} careful daily cleaning " * 5) for i in range(300)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    aim = spark.createDataFrame([("ships sail over quiet water in the harbour",)] * 200, "text string")
    drawn = [r for r in results(importance.resample(docs, aim)) if r[4]]
    assert len(drawn) == 100 and sum(r[0] < 100 for r in drawn) > 80
