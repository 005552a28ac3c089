import zlib

import numpy as np
from pyspark.sql import functions as F

from mapsmith.llm import toxicity
from tests.llm.fixtures import hard_documents, no_documents


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (40, 2))]
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.integers(40)] = ("scum", "moron")[rng.integers(2)]
        if rng.random() < (0.8 if toxic else 0.1):  # the name goes along with the label, but is no evidence
            words[0] = "muslims"
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, labels


def test_held_out_accuracy():
    model = toxicity.fit(*corpus(1500, 1))
    texts, labels = corpus(500, 2)
    predicted = [int(model.score(t) >= toxicity.THRESHOLD) for t in texts]
    assert np.mean(np.array(predicted) == labels) > 0.97


def test_naming_a_group_is_no_evidence():
    texts, labels = corpus(1500, 1)
    free, held = toxicity.fit(texts, labels, swap_weight=0.0), toxicity.fit(texts, labels)
    gap = lambda m: abs(m.score("waa muslims wbb") - m.score("waa hindus wbb"))
    assert gap(held) < 0.05
    assert gap(held) <= gap(free)


def test_swap():
    rng = np.random.default_rng(0)
    assert toxicity.swapped("nothing here", rng) is None
    other = toxicity.swapped("Some Muslims pray", rng)
    assert other.startswith("some ") and "muslims" not in other


def test_rows(spark):
    docs = hard_documents(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(1, 16)] + [(None, 1, 1, "x"), (3, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.scorer(model)("text").alias("s")).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["s"] <= 1 for r in got)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    none = toxicity.train(no_documents(spark), labels)
    assert none.score("x") == 0.5
    assert no_documents(spark).select(toxicity.scorer(none)("text")).count() == 0


def test_table_and_list_give_the_same_model(spark):
    """``train`` over tables is ``fit`` over the same texts, in any order of rows and partitions."""
    texts, labels = corpus(300, 7)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    marked = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int").repartition(3)
    model = toxicity.train(docs, marked)
    own = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = toxicity.fit([texts[i] for i in own], [labels[i] for i in own])
    assert model.weights.keys() == plain.weights.keys()
    held = [texts[i] for i in range(300) if i not in own]
    assert max(abs(model.score(t) - plain.score(t)) for t in held) < 0.02


def test_gains_and_choice_by_counting():
    texts, labels = ["scum here", "scum there", "moron here", "kind words", "kind here", "words there", "scum words", "kind there"] * 2, [1, 1, 1, 0, 0, 0, 1, 0] * 2
    counts = toxicity.counted(texts, labels)
    got = {f: (a, b) for f, a, b in zip(*(counts[c].to_pylist() for c in "fab"), strict=True)}
    for f, (a, b) in got.items():
        has = [f in toxicity.features_of(t) for t in texts]
        assert (a, b) == (sum(h and y for h, y in zip(has, labels, strict=True)), sum(h and not y for h, y in zip(has, labels, strict=True)))
    assert toxicity.choose(counts, 8, 8, 4)[0] in ("4:scum", "scum", "kind", "4:kind")


def test_a_learned_score_is_the_logistic_of_its_weights():
    model = toxicity.Model(0.5, {"scum": 2.0, "4:scum": 1.0, "kind": -3.0})
    assert model.score("Scum!") == 1 / (1 + np.exp(-3.5))
    assert model.score("kindly scummy") == 1 / (1 + np.exp(-1.5))
    assert model.score(None) == model.score("") == 1 / (1 + np.exp(-0.5))
