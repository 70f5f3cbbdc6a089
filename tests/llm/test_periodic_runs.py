import hashlib
import random
import zlib

import pytest

from tramline.llm import periodic_runs as runs

from .samples import DOCS, ODD


def plain_runs(words):
    """All runs by the definition: per period the longest stretches, without those of a smaller period."""
    n, found, ends = len(words), [], set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p) and (i, j + p) not in ends:
                found.append((i, j + p - i, p))
                ends.add((i, j + p))
            i = max(j, i + 1)
    return sorted((a, b, p) for a, b, p in found)


def sequences():
    rng = random.Random(11)
    yield []
    yield list("aaaaa")
    yield list("aaaaaa")
    yield list("abababab" * 3 + "c" + "ababab")
    yield list("aab" * 9 + "a" * 9 + "aab" * 5)
    yield list("abcabcabcab")
    yield list("abcd" * 4 + "e" + "abcd" * 4)
    yield list("a" * 500)
    yield list("ab" * 300 + "b" * 40 + "ab" * 20)
    for n in (30, 60, 200):
        for letters in ("ab", "abc"):
            for _ in range(40):
                yield rng.choices(letters, k=n)
    for _ in range(60):
        out = []
        while len(out) < 150:
            part = rng.choices("abcdefgh", k=rng.randint(1, 9))
            out += (part * rng.randint(1, 9))[: rng.randint(1, 60)]
        yield out


def test_runs_equal_brute_force():
    many = 0
    for s in sequences():
        words = [x.encode() for x in s]
        found = runs.periodic_runs(runs.word_numbers(words))
        assert found == plain_runs(s), s
        many += len(found)
    assert many > 200


@pytest.mark.parametrize("chunk", [1, 3])
def test_runs_with_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    monkeypatch.setattr(runs, "CHUNK_MOST", 4)
    for s in list(sequences())[:120]:
        assert runs.periodic_runs(runs.word_numbers([x.encode() for x in s])) == plain_runs(s)


def plain_row(doc_id, text, loops):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if loops and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    every = plain_runs(words)
    dropped = {i for s, length, q in every for i in range(s + q, s + length)}
    best = sorted(every, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
    start, length, q = best[0]
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in every)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(every), start, length, q, None if q is None else 1000 * length // q,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


@pytest.mark.parametrize("loops", [False, True])
def test_rows_equal_the_definition(spark, loops):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = rng.choices([f"w{j}" for j in range(200)], k=rng.choice([0, 3, 7, 40, 160]))
        if i % 7 == 0 and words:
            words = words + words[-3:] * rng.randint(1, 9)
        rows.append((i * 37, " ".join(words)))
    rows += [(None, None), (None, "a b " * 9), (5, "z " * 9), (5, "z " * 9)]
    found = runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), loops=loops).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plain_row(i, t, loops) for i, t in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in found) > 15


def test_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumnRenamed("fp", "period").withColumnRenamed("label", "length")
    found = {r["doc_id"]: r for r in runs.find_runs(docs).collect()}
    assert (found[6]["start"], found[6]["length"], found[6]["period"], found[6]["exponent_milli"]) == (0, 9000, 1, 9_000_000)
    assert found[1]["n_runs"] == 0 and found[1]["start"] is None and found[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.find_runs(docs.limit(0)).collect() == []


def test_a_long_text_of_one_word_is_quick():
    words = runs.word_numbers([b"x"] * 200_000)
    assert runs.periodic_runs(words) == [(0, 200_000, 1)]
