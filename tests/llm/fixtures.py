"""Rows that every corpus operator must bear: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _t int, start string, length int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def hard_documents(spark):
    texts = [
        (1, None), (2, ""), (3, " "), (4, "one"), (5, "two  words"), (6, LONG), (7, LONG + " tail"), (8, "\n\n"),
        (9, f"alpha beta {PASSAGE} gamma"), (10, f"delta {PASSAGE} eps zeta"), (10, f"delta {PASSAGE} eps zeta"),
        (11, "Same line of text here\nother"), (12, "  same LINE of text here \nother\r"), (13, "Same line of text here"),
        (14, "tab\tsep\x0bvt\x0cff a b été 你好"), (None, "no id at all " + PASSAGE), (15, None),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", 2) for i, t in texts], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
