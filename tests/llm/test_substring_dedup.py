import random

import numpy as np

from mapsmith.llm import substring_dedup as sd
from tests.llm.fixtures import hard_documents, no_documents


def brute(rows, length=13):
    first, out = {}, []
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_same_as_all_windows(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    passages = [rng.choices(words, k=k) for k in (13, 14, 20, 70)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choices(words, k=rng.randrange(25))
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 8)
            text += p[a : rng.randrange(a + 5, len(p) + 1)] if rng.random() < 0.5 else p
        rows.append((rng.randrange(90), " \n".join(text)))
    rows += [(200 + i, "a " * 40) for i in range(4)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(sd.remove_repeats(df)) == brute(rows)
    monkeypatch.setattr(sd, "GROUP", 20)  # many groups, and prefixes made longer
    assert got(sd.remove_repeats(df)) == brute(rows)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    assert got(sd.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sd.remove_repeats(no_documents(spark)).count() == 0


def test_tree_nodes():
    x = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 3], [1, 2, 3]])
    n = sd.nodes(x)
    assert len(set(n[0])) == 1 and len(set(n[1])) == 1
    assert n[2][0] == n[2][1] == n[2][3] != n[2][2]
    assert n[3][0] == n[3][3] != n[3][1]


def test_no_group_holds_all_that_share_a_passage(spark, monkeypatch):
    """Each document has other words before the passage and after it."""
    passage = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(9)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(9))) for i in range(400)]
    rows += [(500 + i, "x y " * 300) for i in range(40)]  # a document's own repeats are one row
    rows += [(400, " ".join(["r"] * 60)), (401, " ".join(["r"] * 60)), (5, rows[5][1]), (5, rows[4][1])]
    made = {}
    cut = sd.cut
    monkeypatch.setattr(sd, "cut", lambda df, name: made.setdefault(name, cut(df, name)))
    monkeypatch.setattr(sd, "GROUP", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(sd.remove_repeats(df)) == brute(rows)
    sizes = [r["count"] for r in made["suffixes"].where("words IS NOT NULL").groupBy("grp").count().collect()]
    assert max(sizes) <= 100
