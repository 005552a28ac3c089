import random

from mapsmith.llm import jaccard
from tests.llm.fixtures import hard_documents, no_documents


def brute(rows):
    """doc_id: (set size, least id reachable)."""
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=4):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    rows, i = [], 0
    for group in range(6):
        base = rng.choices(words, k=rng.choice([8, 30, 90, 150]))
        for copy in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(text)))
            i += 1
    common = rng.choices(words, k=20)
    for _ in range(60):  # a passage in documents that are not copies
        rows.append((i, " ".join([*rng.choices(words, k=rng.randrange(0, 40)), *common, *rng.choices(words, k=rng.randrange(0, 40))])))
        i += 1
    rng.shuffle(rows)
    return rows


def test_same_components_as_all_pairs(spark):
    rows = near_copies()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    got = jaccard.join(docs).collect()
    assert len(got) == docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert (sizes[1], sizes[2], sizes[4], sizes[5]) == (0, 0, 1, 1)
    assert jaccard.join(no_documents(spark)).count() == 0
