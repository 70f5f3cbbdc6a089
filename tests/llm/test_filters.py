import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import langid, quality_rank, quality_rules, sharding, topk, url_filter

from .samples import DOCS, ODD, documents, words


def slow_counts(text):
    found = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall("[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


def test_counts():
    rng = random.Random(2)
    texts = [r[1] or "" for r in ODD if len(r[1] or "") < 3000] + ["a b c d e f a b c d e g " * 3, "x\r\nx\r\n\r\nx\n"]
    texts += [" ".join(rng.choices("ab", k=40)) for _ in range(5)] + [" ".join(words(rng, 50)) for _ in range(5)]
    for text in texts:
        assert quality_rules.count_text(text.encode())[:5] == slow_counts(text)


def test_quality_rules(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 60)), "en", f"s{i % 2}", 0, "", 0) for i in range(300)]
    rows += [(300 + i, " ".join(w + "$$$" for w in words(rng, 60)), "en", "s0", 0, "", 0) for i in range(10)]
    rows += [(400, "too short", "en", "s0", 0, "", 0), (401, "a b c d e " * 20, "en", "s0", 0, "", 0)]
    found = {r["doc_id"]: r for r in quality_rules.judge_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[i]["kept"] for i in range(300))
    assert not any(found[i]["kept"] for i in range(300, 310)) and "symbols" in found[300]["broken"]
    assert found[400]["base_failed"] and found[401]["base_failed"]


def test_thresholds_follow_the_source(spark):
    """A source whose texts vary more has wider fences; copies don't narrow them; new sources start with the parent's."""
    rng = random.Random(5)

    def text(share):
        return " ".join(w + "%" * (rng.random() < share) for w in words(rng, 100))

    rows = [("even", text(0.1)) for _ in range(400)] + [("wild", text(rng.uniform(0, 0.6))) for _ in range(400)]
    rows += [("even", rows[0][1])] * 2000 + [("new", text(0.1))]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    counts = quality_rules.text_counts(docs, "doc_id", "text", "lang", "source")
    cut = {r["source"]: r for r in quality_rules.fences(counts).collect()}
    assert cut["even"]["high_symbols"] < 0.6 * cut["wild"]["high_symbols"]
    assert cut["even"]["high_symbols"] < cut["new"]["high_symbols"] < cut["wild"]["high_symbols"]
    odd = [(10_000 + i, " ".join(w + "%" * (j % 5 > 0) for j, w in enumerate(words(rng, 400))), "en", s) for i, s in enumerate(["even", "wild"])]
    judged = quality_rules.judge_documents(docs.unionByName(spark.createDataFrame(odd, docs.schema))).where("doc_id >= 10000")
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == {10_000: False, 10_001: True}


def test_sketches_merge(spark):
    values = spark.range(1000).select(F.lit("m").alias("metric"), (F.col("id") % 7).alias("part"), F.col("id").alias("value"))
    whole = quality_rules.quartiles(quality_rules.sketch(values, ["metric"]), ["metric"]).first()
    parts = quality_rules.merged(quality_rules.sketch(values, ["part", "metric"]), ["metric"])
    assert quality_rules.quartiles(parts, ["metric"]).first() == whole
    assert abs(whole["q1"] - 250) < 10 and abs(whole["q3"] - 750) < 20


def slow_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, *range(5, 5000, 37)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 1000):
        found = df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
        assert {r["k"]: r["s"] for r in found} == {k: slow_jump(k, n) for k in keys}


def test_shards(spark, tmp_path):
    rows = documents(60) + [(r[0] if r[0] is None else 1000 + r[0], *r[1:]) for r in ODD]
    docs = spark.createDataFrame(rows, DOCS)
    found = sharding.shard_documents(docs, 8, slot_rows=7).collect()
    assert len(found) == len(rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    for r in rows:
        assert by_id[r[0]]["size"] == len((r[1] or "").encode()) + 1
        assert by_id[r[0]]["text_crc32"] == zlib.crc32((r[1] or "").encode())
    sharding.write_shards(docs, 8, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 8).count() == 0


URLS = {
    1: ("http://A.B.com/x?q", "a.b.com", "/x", "com/", "allow"),
    2: ("https://shop.example.com/en/1#t", "shop.example.com", "/en/1", "example.com/en/", "block"),
    3: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    4: ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    5: ("http://x.net/de/1", "x.net", "/de/1", None, "allow"),
    6: ("http://com", "com", "", None, "allow"),
    7: (None, "", "", None, "allow"),
    8: ("no scheme/x", "", "", None, "allow"),
    9: ("http://bad.org/1://y", "bad.org", "/1://y", None, "block"),
    10: ("http://notcom/x", "notcom", "/x", None, "allow"),
    11: ("http://ex?/a", "ex", "", None, "allow"),
}


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u[0], "z") for i, u in URLS.items()], "page_id long, url string, bound string")
    seen = [("bad.org", 0)] * 40 + [("good.org", 1)] * 60 + [("x.net", 1)] * 20 + [(f"h{i}.info", 1) for i in range(9)] + [(None, 1), ("x.net", None)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    found = url_filter.filter_urls(pages, outcomes, share=0.2).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: u[1:] for i, u in URLS.items()}
    none = spark.createDataFrame([], "host string, good int")
    assert url_filter.filter_urls(pages, none).where("verdict = 'block'").count() == 2
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_urls_repeated_and_long(spark):
    long = "http://a.org/" + "x" * 100_000
    rows = [(1, long)] * 3 + [(None, "http://x.net/fr/"), (2, "http://[::1]:80/p"), (3, "http://u@9.9.9.9:8080/p")]
    found = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([("9.9.9.9", 1)], "host string, good int"))
    assert sorted(r["host"] for r in found.collect()) == ["[::1]:80", *["a.org"] * 3, "u@9.9.9.9:8080", "x.net"]
    assert all(len(r["path"]) == 100_001 for r in found.where("page_id = 1").collect())
    assert found.where("page_id is null").first()["verdict"] == "block"


def test_parts_of_a_host(spark):
    hosts = {
        "u:p@a.b.example.com:80": ("a.b.example.com", "example.com", "com"),
        "shop.example.co.uk.": ("shop.example.co.uk", "example.co.uk", "co.uk"),
        "xco.uk": ("xco.uk", "xco.uk", "uk"),
        "co.uk": ("co.uk", "co.uk", "co.uk"),
        "localhost": ("localhost", "localhost", "localhost"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1", "#"),
        "": ("", "", ""),
    }
    site = url_filter.site_of(F.col("h"))
    found = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", site, url_filter.registered_domain(site), url_filter.public_suffix(site))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == hosts


def test_hosts_without_outcomes_inherit(spark):
    hosts = ["new.bad.org", "a.bad.org", "other.org", "new.good.com", "x.nowhere", ""]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    seen = [(f"{c}.bad.org", 0) for c in "abcdefgh"] * 30 + [("h.bad.org", 1)] * 2 + [(f"{c}.good.com", 1) for c in "abcdefgh"] * 60
    outcomes = spark.createDataFrame(seen, "host string, good int")
    found = {r["host"]: r for r in url_filter.filter_urls(pages, outcomes, rules=(), share=0.5).collect()}
    assert found["new.good.com"]["verdict"] == found["x.nowhere"]["verdict"] == found[""]["verdict"] == "allow"
    assert found["a.bad.org"]["verdict"] == "block"
    bound = {h: r["bound"] for h, r in found.items()}
    assert bound["a.bad.org"] < bound["new.bad.org"] <= bound["other.org"] < bound["new.good.com"]
    assert bound[""] is None and bound["x.nowhere"] is None


def slow_reputation(outcomes, hosts):
    """(good, bad) per host by the plain formulas, for hosts of two or three labels."""
    def parts(h):
        return h, ".".join(h.split(".")[-2:]), h.split(".")[-1]

    tables = []
    for level in range(3):
        t = {}
        for h in set(hosts) | {h for h, _ in outcomes}:
            t.setdefault(parts(h)[level], [0, 0])
        for h, g in outcomes:
            t[parts(h)[level]][0] += g
            t[parts(h)[level]][1] += 1
        tables.append(t)
    total = [sum(v[i] for v in tables[2].values()) for i in (0, 1)]
    parent = {s: (total[0] + 1) / (total[1] + 2) for s in tables[2]}
    for level in (2, 1, 0):
        seen = [(g, n, parent[k]) for k, (g, n) in tables[level].items() if n]
        spread, noise = sum(n * (g / n - m) ** 2 for g, n, m in seen), sum(m * (1 - m) for _, _, m in seen)
        binomial = sum(n * m * (1 - m) for _, n, m in seen)
        s = min(1000, max(1, (binomial - noise) / (spread - noise) - 1 if spread > noise else 1000))
        if level == 0:
            return {k: (g + parent[k] * s, n - g + s - parent[k] * s) for k, (g, n) in tables[0].items()}
        mean = {k: (g + parent[k] * s) / (n + s) for k, (g, n) in tables[level].items()}
        below = {parts(h)[level - 1]: parts(h)[level] for h in set(hosts) | {h for h, _ in outcomes}}
        parent = {child: mean[up] for child, up in below.items()}


def test_reputation_equals_the_formulas(spark):
    rng = random.Random(9)
    hosts = [f"{a}.{b}.{c}" for a in "mw" for b in ("x", "y", "z") for c in ("com", "org", "de")]
    bias = {h: rng.random() for h in hosts}
    outcomes = [(h, int(rng.random() < bias[h])) for h in rng.choices(hosts[:12], k=400)]
    found = url_filter.host_reputation(spark.createDataFrame(outcomes, "host string, good int"), spark.createDataFrame([(h,) for h in hosts], "host string"))
    wanted = slow_reputation(outcomes, hosts)
    got = {r["site"]: (r["rep_good"], r["rep_bad"]) for r in found.collect()}
    assert set(got) == {h for h in wanted if h.split(".")[-1] in {o.split(".")[-1] for o, _ in outcomes}}
    assert all(np.allclose(got[h], wanted[h]) for h in got)


def slow_top(rows, k):
    """Sorted (query_id, rank, vec_id, score) in whole numbers of any size."""
    out, limit = [], 2**63 - 1
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for at, (q, v) in enumerate(ok):
        if q % 20 == 0:
            scores = [(-max(-limit - 1, min(limit, sum(map(int.__mul__, v, w)))), i) for n, (i, w) in enumerate(ok) if n != at]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def top(spark, rows, kind="array<float>", k=20):
    vectors = spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"vec_id long, embedding {kind}, row string, norm double")
    return sorted(map(tuple, topk.exact_top_k(topk.quantized(vectors), F.col("vec_id") % 20 == 0, k).collect()))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.uniform(0.1, 2)]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    rows += [(40, rows[7][1]), (40, rows[40][1]), (41, rows[41][1])]  # ids that repeat
    rows += [(300, None), (301, [1.0, None, *[0.0] * 6]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8)]
    assert top(spark, rows) == slow_top(rows, 20)


@pytest.mark.parametrize("size", [1e3, 2e6, 1e9, 1e30])
def test_top_k_of_large_numbers(spark, size):
    """Products beyond what a double, a long and any number type of the engine hold."""
    rng = np.random.default_rng(int(np.log10(size)))
    rows = [(i, [float(np.float32(x * size)) for x in rng.normal(size=3)]) for i in range(30)] + [(30, [0.5, 0.25, 1.0])]
    assert top(spark, rows, k=5) == slow_top(rows, 5)


def test_top_k_tells_close_scores_apart(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 3 / 64]), (2, [2.0**22, 1 / 64]), (3, [2.0**22, 2 / 64])]
    assert [r[2] for r in top(spark, rows, "array<double>")] == [1, 3, 2]


def test_top_k_few(spark):
    assert top(spark, [(0, [1.0, -1.0]), (1, [0.5, 0.25])]) == [(0, 1, 1, 1024)]
    assert top(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])]) == [(0, 1, 1, 4096), (0, 1, 1, 4096), (0, 2, 0, 0), (0, 2, 0, 0)]
    assert top(spark, [(0, [1.0]), (1, [1.0, 2.0]), (2, [])], "array<double>") == [(0, 1, 1, 4096), (0, 2, 2, 0)]
    assert top(spark, []) == []


EN = "the cat and the dog with this house in that street was for them of old "
FR = "le chat et la maison dans cette rue avec une vieille dame pour nous les "


def test_language(spark):
    rows = [(i, EN * 3, "en", "a", 0, "", 0) for i in range(30)] + [(30 + i, FR * 3, "fr", "b", 0, "", 0) for i in range(30)]
    rows += [(60, EN, "fr", "b", 0, "", 0), (61, FR, None, None, 0, "", 0), (62, "", "en", "a", 0, "", 0), *[(100 + i, *r[1:]) for i, r in enumerate(ODD)]]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS), host=F.col("source")).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["language"] == "en" and found[i]["kept"] for i in (*range(30), 60, 62))
    assert all(found[i]["language"] == "fr" and found[i]["kept"] for i in (*range(30, 60), 61))
    assert all(abs(r["posterior"] - 0.5) <= 0.5 for r in found.values())
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_rank(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        text = " ".join(w + ("" if good else rng.choice(["%%%", "$$$", "!!"])) for w in words(rng, rng.choice([20, 80])))
        rows.append((i, text, "en", "a", 0, "", 0))
        labels.append((i, int(good)))
    labels += [(None, 1), (299, None), (12345, 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_rank.score_documents(docs, quality_rank.fit(docs, marks)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["predicted"] == (i % 4 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    odd = quality_rank.score_documents(spark.createDataFrame(ODD, DOCS), quality_rank.fit(docs, marks.limit(0))).collect()
    assert len(odd) == len(ODD) and all(r["predicted"] == 1 for r in odd)


def test_pages_have_markup_and_address(spark):
    html = [(1, "http://a.example.fr/1", FR * 5, "fr"), (2, "http://b.example.com/1", EN * 5, "en"), (3, None, None, None)]
    pages = spark.createDataFrame(html, "page_id long, url string, body string, markup string")
    found = langid.identify(pages, "page_id", "body", "markup", url_filter.url_host(F.col("url"))).collect()
    assert {r["doc_id"]: r["language"] for r in found if r["doc_id"] < 3} == {1: "fr", 2: "en"}


