"""The fusion of language evidence and the fit of the ranking, against their formulas."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import langid, quality_rank, queries
from tramline.llm.quality_rank import FEATURES, fit_pairs

TALK = {
    "de": "der hund und die katze liegen nicht weit von dem alten haus an einer strasse",
    "en": "the dog and the cat are lying not far from that old house in a street",
    "es": "el perro y la gata no lejos de la casa vieja en la calle para la gente",
    "fr": "le chien et le chat ne sont pas loin de la vieille maison dans une rue",
}


def made(seed=5):
    """(id, text, declared, host, truth): long texts, and short ones that only their address and declaration tell."""
    rng, rows = random.Random(seed), []
    for i in range(120):
        truth = langid.LANGUAGES[i % 4]
        words = rng.choices(TALK[truth].split(), k=30)
        declared = truth if i % 5 else rng.choice([None, "xx", "en"])
        rows.append((i, " ".join(words), declared, f"{'www.' if i % 3 else ''}site{i % 2}.{truth}", truth))
    for i in range(120, 124):  # "la" is more Spanish than French
        rows.append((i, "la", "fr", "www.site0.fr", "fr"))
    return [*rows, (200, None, None, None, None), (201, "", "de", "", None), (202, "123 !", None, "lonely", None), (203, "la", None, None, "es")]


def softmax(x):
    raised = [math.exp(v - max(x)) for v in x]
    return [r / sum(raised) for r in raised]


def by_hand(rows, strength=20.0):
    """{id: (posteriors, text posteriors)} by the formulas, one document after the other."""
    names, n = langid.LANGUAGES, len(langid.LANGUAGES)
    grams = {r[0]: np.bincount(langid.gram_buckets((r[1] or "").encode()), minlength=langid.GRAM_BUCKETS) for r in rows}
    ll = {}
    for i, *_ in rows:
        counts, total = np.full((n, langid.GRAM_BUCKETS), 0.5), grams[i].sum()
        for other, _, declared, _, _ in rows:
            if declared in names:
                met = sum(grams[j].sum() for j, _, d, _, _ in rows if d == declared and j != i)
                counts[names.index(declared)] += grams[other] * (1 - met / (met + 100) if other == i else 1)
        ll[i] = np.log(counts / counts.sum(1, keepdims=True)) @ grams[i] * (min(total, 100) / total if total else 0)
    soft = {i: np.array(softmax(list(v))) for i, v in ll.items()}
    sums = {k: defaultdict(lambda: np.zeros(n)) for k in ("told", "suffix", "domain", "host")}
    keys = {}
    for i, _, declared, host, _ in rows:
        host = host or ""
        told = "-" if declared is None else declared if declared in names else "?"
        keys[i] = {"told": told, "suffix": host.split(".")[-1] if "." in host else "", "domain": ".".join(host.split(".")[-2:]), "host": host}
        for k, v in keys[i].items():
            sums[k][v] += soft[i]
    all_w = sum(soft.values())
    overall = (all_w + 1) / (all_w.sum() + n)
    out = {}
    for i, *_ in rows:
        k = keys[i]
        domain = sums["domain"][k["domain"]]
        domain = (domain + strength * overall) / (domain.sum() + strength)
        host = sums["host"][k["host"]]
        host = (host + strength * domain) / (host.sum() + strength)
        agreed = np.array([9.0 if k["told"] == name else 0.0 for name in names])
        score = ll[i] + np.log((sums["told"][k["told"]] + agreed + 1) / (all_w + 19)) + np.log(host)
        if k["suffix"]:
            score = score + np.log((sums["suffix"][k["suffix"]] + 1) / (all_w + 19))
        out[i] = (softmax(list(score)), list(soft[i]))
    return out


@pytest.fixture(scope="module")
def told(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, truth string")
    return rows, {r["doc_id"]: r for r in langid.identify(docs, host=F.col("host")).collect()}


def test_fusion_equals_the_formulas(told):
    rows, found = told
    for i, (post, text) in by_hand(rows).items():
        r = found[i]
        assert r["posterior"] == pytest.approx(max(post), rel=1e-9)
        assert r["language"] == langid.LANGUAGES[post.index(max(post))] or sorted(post)[-1] - sorted(post)[-2] < 1e-9
        assert r["kept"] == (max(post) >= 0.6)
        assert max(text) - sorted(text)[-2] < 1e-9 or r["text_language"] == langid.LANGUAGES[text.index(max(text))]


def test_evidence_corrects_what_the_text_tells(told):
    rows, found = told
    short = [i for i, *_ in rows if 120 <= i < 124]
    assert {found[i]["text_language"] for i in short} == {"es"} and {found[i]["language"] for i in short} == {"fr"}
    assert all(found[i]["language"] == truth for i, *_, truth in rows if truth and i < 120)
    assert found[203]["language"] == "es"


def test_a_declaration_teaches_nothing_about_its_own_text(spark):
    """A German text that calls itself French, in words that no other text has, is read as German."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(TALK[x].split(), k=25)), x) for i, x in enumerate(["de", "fr", "en", "es"] * 20)]
    rows.append((100, "zwölf boxkämpfer jagen viktor quer über den großen deich bei sylt", "fr"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(found[i]["text_language"] == x and found[i]["language"] == x for i, _, x in rows if i < 100)
    assert found[100]["text_language"] == "de"


def test_patterns_of_pages(spark, tmp_path):
    pages = [
        (1, "http://a.fr/x", f'<html lang="fr-CA"><head><style>p {{ the the the }}</style></head><body><p>{TALK["fr"] * 3}</p></body></html>'),
        (2, "http://b.com/x", f'<HTML><script type="x">le la les\n le</script><b>{TALK["en"] * 3}</b>'),
        (3, None, None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: r for r in queries.language_id_pages(spark, str(tmp_path)).collect()}
    assert (found[1]["declared"], found[2]["declared"], found[3]["declared"]) == ("fr", None, None)
    assert found[1]["language"] == "fr" and len(found) == 3


def test_fit_reaches_the_optimum_over_all_pairs():
    rng = np.random.default_rng(3)
    good = rng.normal(0.4, 1, (60, len(FEATURES)))
    bad = rng.normal(-0.1, 1.2, (45, len(FEATURES)))
    ranking = fit_pairs(good, bad)
    scaled = [np.clip((x - ranking.centre) / ranking.scale, -6, 6) for x in (good, bad)]
    diff = (scaled[0][:, None] - scaled[1][None]).reshape(-1, len(FEATURES))

    def loss(w):
        return float(np.log1p(np.exp(-diff @ w)).mean())

    w, best = np.array(ranking.weights), np.zeros(len(FEATURES))
    for _ in range(20_000):
        best = best + 0.3 * (diff.T @ (1 / (1 + np.exp(diff @ best))) / len(diff) - 1e-4 * best)
    assert loss(best) < loss(w) < loss(best) + 0.05 * (loss(np.zeros(len(FEATURES))) - loss(best)) + 0.01
    above = (diff @ w > 0).mean()
    assert 0.75 < above < 0.999  # the two kinds overlap


def test_rows_that_repeat_an_id_are_fitted_once(spark):
    rows = [(i, "good plain words here " * 6, 1) if i % 2 else (i, "%%% $$$ ### " * 9, 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] * 5, "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows] * 3, "doc_id long, quality int")
    once = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert quality_rank.fit(docs, marks) == quality_rank.fit(once, marks.distinct())


def test_fit_on_tables_counts_all_rows(spark):
    """More labelled rows than the earlier bound of 20,000; the last ones by the earlier order, few and different, count too."""
    rng = random.Random(4)
    n = 26_000
    texts = [" ".join(rng.choices(["plain", "words", "of", "Text", "%%", "12"], k=rng.randint(3, 9))) for _ in range(n)]
    rows = [(i, t, int("%%" not in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    found = quality_rank.fit(docs, marks)
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert len(kept) > 20_000
    x = np.array([quality_rank.features(t.encode()) for _, t, _ in kept])
    good = np.array([q for *_, q in kept]) == 1
    assert np.allclose(found.centre, x.mean(0), atol=1e-9)
    local = fit_pairs(x[good], x[~good])
    assert np.allclose(found.weights, local.weights, rtol=1e-3, atol=1e-3)
    u = np.sort(found.utility(x))
    at = int((~good).sum())
    assert found.cut == (u[at - 1] + u[at]) / 2
    assert np.isclose(found.slope, 4 / (np.quantile(u, 0.75) - np.quantile(u, 0.25)))
