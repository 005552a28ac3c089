"""The pipeline on the smallest tables against plain versions of its stages."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from mapsmith.llm import toxicity
from mapsmith.llm.common import table
from mapsmith.llm.tokens import Encoder
from tests.llm.test_jaccard import brute
from tests.llm.test_native import plain_hits, plain_lines

SF = "/root/testdata/sf0.001"
HARD = [(i, t, "a", "b", 1, 2) for i, t in [(1, None), (2, ""), (3, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "only once here"), (5, "only once here"), (None, "no id"), (None, None), (6, "word " * 30_000)]]


def test_pipeline(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    rows = [(i, text) for i, _, _, text in plain_lines(rows)]
    comp = brute(rows)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    bad = {i for i, _, _, found in plain_hits(rows, [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]) if found}
    rows = [r for r in rows if r[0] not in bad]
    e = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: np.append(np.frombuffer(e.whole([t])[0], e.type), 0).astype("<u4") for i, t in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    assert len({r["sequence_id"] for r in got}) == len(got)


def test_a_passage_of_one_item_is_enough(spark):
    docs = table(spark, SF, "documents").limit(30)
    passage = table(spark, SF, "benchmark").where("text IS NOT NULL").orderBy("item_id").first()["text"]
    planted = spark.createDataFrame([(-1, f"Before it. {passage} And after.", "en", "s", 9), (-2, "Clean: " + " ".join(passage.split()[:5]), "en", "s", 9)], docs.schema)
    out = {r["doc_id"] for r in corpus_pipeline.drop_benchmark(spark, docs.union(planted), SF).collect()}
    assert -1 not in out and -2 in out


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)], HARD])
def test_stages_bear_odd_rows(spark, rows):
    """Nulls, no rows, repeated rows, and no n_chars but a column whose name clashes."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _key string, key long, _kept long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name in ("toxicity", "decontaminate"):
            assert sorted(got, key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
        elif name == "line_dedup":
            assert len(got) == len(rows)
        else:
            assert set(got) == {(r[0], r[1]) for r in rows} - {(4, "one two three four five six seven")} and len(got) == len(set(got))
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert len({(r["doc_id"]) for r in packed}) == len({r[0] for r in rows})


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(20), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
