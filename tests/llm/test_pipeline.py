import random

from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import langid, packing, quality_rank
from tramline.llm.near_copies import near_copies
from tramline.llm.tokens import default_tokenizer

from .samples import words


def test_stages_equal_their_operators(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(120):
        good = i % 5 > 0
        text = rows[i - 1][1] if i % 10 == 7 else " ".join(w if good else w + "%%%" for w in words(rng, 60))
        if i % 20 == 17:  # one word of sixty in another form
            text = text.replace(text.split()[30], "changed", 1)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(None, "a row without an id that has enough words to be kept", None, None, None), (200, None, None, None, None), rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def frame(some):
        return spark.createDataFrame(some, schema)

    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality_rank.score_documents(frame(rows), quality_rank.fit(frame(rows), marks)).collect()
    good = {r["doc_id"] for r in scored if r["predicted"]}
    left = [r for r in rows if r[0] in good]
    told = {r["doc_id"] for r in langid.identify(frame(left), host=F.col("source")).collect() if r["kept"]}
    left = [r for r in left if r[0] in told]
    first = {r["doc_id"] for r in near_copies(frame(left)).collect() if r["doc_id"] == r["component_id"]}
    edited = [i for i in range(17, 120, 20) if i - 1 in told]
    assert edited and not any(i in first for i in edited)
    left = [r for r in left if r[0] in first]
    assert {p["doc_id"] for p in pieces} == {r[0] for r in left}
    assert sum(p["length"] for p in pieces) == sum(p["length"] for p in packing.pack_documents(frame(left), default_tokenizer()).collect())
    assert all(i in good for i in range(120) if i % 5 and i % 10 != 7)
    assert not any(i in good for i in range(0, 120, 10))


def test_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
