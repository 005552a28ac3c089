"""Line dedup and decontamination against plain versions."""

import hashlib
import re

from pyspark.sql import functions as F

from mapsmith.llm import decontaminate, line_dedup
from tests.llm.fixtures import hard_documents, no_documents

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if i is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        gone = [i is not None and len(k := line.strip(SPACE).translate(LOWER)) >= 10 and len(holders[k]) > 1 and min(holders[k]) < i for line in own]
        out.append((i, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [(r["doc_id"], r["text"]) for r in hard_documents(spark).collect()]
    rows += [(100 + i, f"own line number {i}\nSHARED boilerplate line\n\nshared\n{'x' * (i % 3)}shared boilerplate line  ") for i in range(40)]
    rows += [(7, "a second text of document 7\nshared boilerplate line"), (400, "shared boilerplate line")]
    df = spark.createDataFrame([(i, t, "a", 0, "b") for i, t in rows], "doc_id long, text string, _runs string, start int, _line string").repartition(5)
    got = [(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"] or "") for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == plain_lines(rows)
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0


def plain_hits(rows, items, n=8):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for gram, who in grams.items():
            for a in range(len(w) - len(gram) + 1):
                if tuple(w[a : a + len(gram)]) == gram:
                    hit |= set(range(a, a + len(gram)))
                    found |= who
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_contamination(spark, monkeypatch):
    items = [(1, "The quick brown fox jumps over the lazy dog today"), (2, "Too short"), (3, None), (4, "..."), (5, "quick brown fox jumps over the lazy dog"), (5, "quick brown fox jumps over the lazy dog"), (10, "Été à là où il y a des mots 42")]
    rows = [(1, "x the QUICK brown, fox jumps over the lazy dog! today too short y"), (2, "nothing"), (3, None), (3, None), (4, ""), (5, "it is Too. Short too short"), (6, "été à là où il y a des mots 42"), (None, "too short"), (7, "quick brown fox jumps over the lazy cat " * 50)]
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, _key string, _spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(rows, items)

    def got():
        found = decontaminate.contamination(docs, bench).withColumn("n", decontaminate.n_covered(F.col("_spans"))).collect()
        return sorted(((r["doc_id"], r["_n_words"], r["n"], tuple(r["_items"])) for r in found), key=str)

    assert got() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 2)  # the way of a large benchmark
    assert got() == want
    monkeypatch.undo()
    kept = decontaminate.drop_contaminated(docs, bench, min_items=2).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 2, 3, 3, 4, 5, 6, 7]
    kept = decontaminate.drop_contaminated(docs, bench).collect()  # one item is enough
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 3, 4, 7]
    assert kept[0].asDict().keys() == {"doc_id", "text", "_key", "_spans"}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert clean[1] == "x y" and clean[2] == "nothing" and clean[3] is None
    whole = spark.createDataFrame([(1, "  «Hello», World. The quick-brown fox jumps over the lazy DOG; today: End (really).\n")], docs.schema.fieldNames()[:2])
    assert decontaminate.remove_spans(whole, bench).collect()[0]["text"] == "  «Hello», World. End (really).\n"
    assert decontaminate.contamination(no_documents(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
