import itertools
import random

import numpy as np
import pytest
import xxhash

from tramline.llm.components import connected_components, extended_components
from tramline.llm.simhash import fingerprint, near_duplicates, near_links, spanning_links

from .samples import DOCS, ODD, documents


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("row", [*documents(12), *ODD])
def test_fingerprint(row):
    assert fingerprint((row[1] or "").encode()) == slow_fingerprint(row[1] or "")


def test_groups_equal_brute_force(spark):
    rows = documents(90) + [(90 + i, r[1], *r[2:]) for i, r in enumerate(documents(30))]
    found = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    close = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = slow_roots(close, prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        i: (f"{p:016x}", roots[i]) for i, p in prints.items()
    }


def test_odd_rows(spark):
    found = near_duplicates(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert {i for i, r in by_id.items() if r["fingerprint"] == "0" * 16} == {1, 2, 3}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_large_buckets_lose_no_link(spark, bucket_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(3)) & (2**64 - 1) for c in centres for _ in range(40)}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket_rows=bucket_rows)
    labels = {r["node"]: r["root"] for r in connected_components(links).collect()}
    close = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    roots = slow_roots(close, signed)
    linked = {n for pair in close for n in pair}
    assert set(labels) == linked
    groups = {frozenset(n for n in labels if labels[n] == r) for r in labels.values()}
    assert groups == {frozenset(n for n in linked if roots[n] == r) for r in {roots[n] for n in linked}}


def test_spanning_links_are_a_forest():
    x = np.array([0, 1, 3, 1 << 40, (1 << 40) + 1, 2**63], np.uint64).view(np.int64)
    assert len(spanning_links(x, 4)) == len(x) - 1
    assert len(spanning_links(x, 0)) == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 301 + 300
    assert len({found[i] for i in range(301)}) == 1
    assert len({found[i] for i in range(1000, 1300)}) == 1


def test_components_extended_by_further_links(spark):
    rng = random.Random(5)
    for first, more in ((0, 30), (30, 0), (40, 1), (25, 40)):
        rounds = [[(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (first, more, more)]
        labels = None
        for edges in rounds:
            labels = extended_components(labels, spark.createDataFrame(edges, "a long, b long"))
        got = {r["node"]: r["root"] for r in labels.collect()}
        whole = connected_components(spark.createDataFrame(sum(rounds, []), "a long, b long")).collect()
        assert labels.count() == len(got) and set(got) == {r["node"] for r in whole}
        named = {(r["root"], got[r["node"]]) for r in whole}
        assert len(named) == len({a for a, _ in named}) == len({b for _, b in named})
        assert all(got[r] == r for r in got.values())
