import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mapsmith.llm import bitpack, packing
from mapsmith.llm.tokens import Encoder
from tests.llm.fixtures import hard_documents, no_documents

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b", "a\n b", " \n x", "a\tb c", "x   y ", "", "  ", "don't they'll  go", "é b c", "<|endoftext|> a", "a 　 b", "Σας x", "\x1c a \x1c"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_cache_equals_library(path):
    e = Encoder(path)
    assert e.encode(ODD) == e.whole(ODD)
    assert e.encode(ODD) == e.whole(ODD)  # from the cache


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_cache_equals_library_on_a_table(path):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    e = Encoder(path)
    assert e.by_word and e.between
    want = e.whole(texts)
    assert e.encode(texts) == want
    e.between = None  # without a special token to put between words, they are encoded one by one
    e.forget()
    assert e.encode(texts[:100]) == want[:100]


def test_a_file_that_does_not_split_at_spaces_is_not_cached(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    # "b c" is one token where no pre-tokenizer splits it
    made = Tokenizer(models.BPE({" ": 0, "b": 1, "c": 2, "b ": 3, "b c": 4, "a": 5}, [("b", " "), ("b ", "c")]))
    made.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    assert e.encode(["b c b", "a"]) == e.whole(["b c b", "a"])
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "t.json"))
    assert Encoder(str(tmp_path / "t.json")).by_word


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("mapsmith.llm.tokens.CACHE_WORDS", 50)
    e, texts = Encoder(BYTE), [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    assert [e.encode([t])[0] for t in texts] == e.whole(texts)


@pytest.mark.parametrize("bits", [1, 5, 15, 16, 17, 20])
def test_packed_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n) for n in (0, 1, 7, 100, 1000, 3)]
    f = bitpack.TokenFile(bitpack.file_bytes(docs, bits, block=61))
    for k, d in enumerate(docs):
        assert (f.document(k) == d).all()
    many = rng.integers(0, 1 << bits, 70_001)
    assert (bitpack.unpack(bitpack.pack(many, bits), len(many), bits) == many).all()
    flat = np.concatenate(docs)
    for a, b in ((0, 0), (60, 62), (61, 122), (500, 1111)):
        assert (f.ids(a, b) == flat[a:b]).all()
    with pytest.raises(IndexError):
        f.ids(0, 10_000)


def expected(rows, path, end):
    e = Encoder(path)
    return [(r["doc_id"], [*np.frombuffer(e.whole([r["text"] or ""])[0], e.type).tolist(), end]) for r in rows]


def test_files_hold_all_ids_in_order(spark):
    docs = hard_documents(spark)
    got = bitpack.read_files(bitpack.write_files(docs, WORD, 1, file_ids=1000)).collect()
    want = expected(sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"])), WORD, 1)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert r["start"] == at
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert bitpack.read_files(bitpack.write_files(no_documents(spark), WORD, 1)).count() == 0


def test_binary_pieces():
    assert packing.binary_pieces(0, 8) == []
    assert packing.binary_pieces(21, 8) == [(0, 8), (8, 8), (16, 4), (20, 1)]
    assert packing.binary_pieces(3, 1) == [(0, 1), (1, 1), (2, 1)]


def test_packing_keeps_each_id_once(spark):
    docs = hard_documents(spark).withColumn("doc_id", F.monotonically_increasing_id())
    rows = docs.collect()
    want = dict(expected(rows, BYTE, 0))
    got = packing.pack_documents(docs, BYTE, 0, longest=64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 for r in got)
    for doc, ids in want.items():
        mine = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    assert packing.pack_documents(no_documents(spark), BYTE).count() == 0


def test_crc_column_is_the_unsigned_crc32(spark):
    files = bitpack.write_files(hard_documents(spark), WORD, 1)
    for r in bitpack.read_files(files).withColumn("c", F.crc32("ids")).collect():
        assert r["c"] == zlib.crc32(r["ids"])


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_plain_library_call(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [*ODD, "a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", " <|endoftext|>", "<|endoftext|><|endoftext|> z"]
    e = Encoder(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, e.type).tolist() for x in e.encode(texts)] == want
