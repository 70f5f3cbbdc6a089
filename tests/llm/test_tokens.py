import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tramline.llm.packing import first_fit_decreasing, pack_documents, piece_digests
from tramline.llm.piece_sampling import PieceSampler, decode_pieces, default_model, sample_pieces, sampled_round_trip
from tramline.llm.token_store import encode_documents, ids_digest, read_documents, read_store, write_store
from tramline.llm.tokens import TextEncoder, default_tokenizer

from .samples import DOCS, ODD, documents


@pytest.fixture(scope="module")
def rows():
    return documents(40) + [(1000 + i, *r[1:]) for i, r in enumerate(ODD)]


@pytest.fixture(scope="module")
def wanted(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    return {r[0]: [*model.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("small", [True, False])
def test_encoder_equals_the_library(rows, wanted, small):
    own = TextEncoder(default_tokenizer(), 300, 2000) if small else TextEncoder(default_tokenizer())
    ids, at = own.encode([r[1] or "" for r in rows])
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [wanted[r[0]] for r in rows]


@pytest.mark.parametrize("form", ["a{0}b", "!{0}! {0}{0}", "1{0} x{0}'s {0}'t"])
def test_every_character_as_the_library(form):
    """Code points up to the ideographs of the second supplementary plane, and a sample of the rest."""
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(default_tokenizer()), TextEncoder(default_tokenizer())
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 64 == 0)]
    for at in range(0, len(codes), 20_000):
        texts = [form.format(chr(c)) for c in codes[at : at + 20_000]]
        ids, cuts = own.encode(texts, None)
        found = model.encode_batch_fast(texts, add_special_tokens=False)
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [f.ids for f in found]


def test_mixed_characters_as_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x590), range(0x590, 0x1200), range(0xAC00, 0xAD00)]
    pools += [range(0x1E00, 0x2100), range(0x10000, 0x20000), [0x27, 0x20, 0x3A3, 0x130, 0x49, 0x307, 0x212B]]
    texts = []
    for _ in range(4000):
        some = rng.sample(pools, rng.choice([1, 2, 3]))
        texts.append("".join(chr(rng.choice(rng.choice(some))) for _ in range(rng.randint(1, 30))))
    ids, cuts = TextEncoder(default_tokenizer()).encode(texts, None)
    found = Tokenizer.from_file(default_tokenizer()).encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [f.ids for f in found]


def test_other_models_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_first_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    placed, room = first_fit_decreasing(lengths, 100), []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        bin_ = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (bin_ == len(room))
        assert placed[i] == (bin_, 100 - room[bin_])
        room[bin_] -= lengths[i]


def test_packing(spark, rows, wanted):
    pieces = piece_digests(pack_documents(spark.createDataFrame(rows, DOCS), default_tokenizer(), group_docs=25)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        ids = wanted[p["doc_id"]]
        assert p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
    assert set(by_doc) == set(wanted)
    for doc, own in by_doc.items():
        spans = sorted((p["start"], p["length"]) for p in own)
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) == len(wanted[doc])
    for spans in by_sequence.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    used = sum(map(len, wanted.values()))
    assert len(by_sequence) <= used // 2048 + 4


def test_packing_repeated_and_no_rows(spark):
    assert pack_documents(spark.createDataFrame(ODD, DOCS), default_tokenizer()).where("doc_id = 4").count() == 2
    assert pack_documents(spark.createDataFrame([], DOCS), default_tokenizer()).count() == 0


def test_token_store(spark, rows, wanted, tmp_path):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    write_store(encode_documents(docs, default_tokenizer(), rows_per_file=20), str(tmp_path / "store"))
    found = ids_digest(read_store(spark, str(tmp_path / "store"))).collect()
    start = 0
    for doc in sorted(wanted):
        row = next(r for r in found if r["doc_id"] == doc)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(wanted[doc]), crc(wanted[doc]))
        start += len(wanted[doc])
    assert len(found) == len(rows)
    some = read_documents(spark, str(tmp_path / "store"), [3, 1005]).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: wanted[i] for i in (3, 1005)}


def test_readers_skip_what_indexes_and_bloom_filters_rule_out(spark, tmp_path):
    docs = spark.range(0, 12_000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    path = str(tmp_path / "store")
    write_store(encode_documents(docs, default_tokenizer(), rows_per_file=6000), path)

    def read(wanted):
        found = read_documents(spark, path, wanted)
        rows = found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return [r["doc_id"] for r in rows], scan.metrics().apply("numOutputRows").value()

    assert read([7000]) == ([7000], 1000)  # one row group of six
    assert read([7001]) == ([], 0)  # within the range of a group, but not in its Bloom filter
    assert read([2, 11_998])[1] == 2000


def test_token_store_odd_rows(spark, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        path = str(tmp_path / name)
        write_store(encode_documents(spark.createDataFrame(rows, DOCS), default_tokenizer()), path)
        found = ids_digest(read_store(spark, path)).orderBy("start").collect()
        assert len(found) == len(rows)
        assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
        if rows:
            assert [r["doc_id"] for r in found] == [None, -8, 1, 2, 3, 4, 4, 5, 6, 7]


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame(documents(20) + ODD, DOCS)
    found = sample_pieces(docs, default_model())
    texts = decode_pieces(found, default_model()).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in texts) == sorted((r[0] or 0, r[1] or "") for r in documents(20) + ODD)
    again = sampled_round_trip(docs.repartition(3), default_model())
    assert again.where("not lossless").count() == 0
    ids = {(r["doc_id"], tuple(r["ids"])) for r in found.collect()}
    assert ids == {(r["doc_id"], tuple(r["ids"])) for r in again.collect()}
    assert sample_pieces(spark.createDataFrame([], DOCS), default_model()).count() == 0


def test_pieces_follow_the_lattice_weights():
    """Shares of sampled segmentations of one word against all segmentations, enumerated."""
    one = PieceSampler(default_model(), theta=0.5)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())}

    def every(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces:
                for more in every(rest[n:]):
                    yield (pieces[rest[:n]], *more)

    weights = {s: np.exp(sum(one._log[i] for i in s)) for s in every("▁the")}
    n = 20_000
    ids, at = one.encode(["the"] * n, np.arange(n))
    seen = defaultdict(int)
    for i, j in zip(at, at[1:], strict=False):
        seen[tuple(ids[i:j].tolist())] += 1
    assert set(seen) <= set(weights)
    total = sum(weights.values())
    for s, w in weights.items():
        assert abs(seen[s] / n - w / total) < 0.02


def test_apostrophes_beside_marks_as_the_library():
    """Lower-casing may leave NFC: the words of such texts are composed anew by the library."""
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(default_tokenizer()), TextEncoder(default_tokenizer())
    rng = random.Random(14)
    pools = [range(0x41, 0x7B), range(0xC0, 0x250), range(0x300, 0x370), range(0x370, 0x400), range(0x1F00, 0x2000), [0x345, 0x386, 0x1FBA, 0x3A3, 0x130]]
    texts = ["'Άͅ", "Ὰͅ'"]
    for _ in range(6000):
        chars = [chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 8))]
        chars.insert(rng.randrange(len(chars) + 1), "'")
        texts.append("".join(chars))
    ids, cuts = own.encode(texts, None)
    found = model.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [f.ids for f in found]
