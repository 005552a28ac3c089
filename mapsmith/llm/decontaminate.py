"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, training windows scanned against it,
hits verified word by word, then spans or whole documents removed.

Results in special cases: null text has no words and no hits; an item without words has no window; an item with
fewer than ``n`` words is one window of its own length; repeated item ids count once; rows that repeat an id are
judged each by its own text; a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapsmith.llm.common import ascii_lower, cut

#: Digits, a-z (after lower-casing) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text as it is, and any one character that is in no word.
WORD_AS_IS, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Up to so many distinct n-grams the set goes to every executor with the plan; beyond, windows are joined by hash.
BROADCAST_GRAMS = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_grams(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (_item, _len, _gram)."""
    words = items.select(F.col(id_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(n))
    grams = words.select("_item", length.alias("_len"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_i"), "_w")
    return grams.select("_item", "_len", F.array_join(F.slice("_w", F.col("_i"), F.col("_len")), " ").alias("_gram")).distinct()


def window_hash(words: Column, at: Column, length: int) -> Column:
    """64-bit hash of ``length`` words from the 0-based position ``at``."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def _gram_hash(length: int) -> Column:
    return window_hash(F.split("_gram", " "), F.lit(0), length)


def _places(length: int) -> Column:
    return F.when(F.size("_w") >= length, F.sequence(F.lit(0), F.size("_w") - length)).otherwise(F.array().cast("array<int>"))


def _hits_of(length: int, hashes: list[int]) -> Column:
    """(at, len, gram) of the windows of ``length`` words in _w whose hash is listed; OptimizeIn makes a hash set of the list."""
    hit = F.filter(_places(length), lambda i: window_hash(F.col("_w"), i, length).isin(hashes))
    return F.transform(hit, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice("_w", i + 1, length), " ").alias("gram")))


def window_hits(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus _n_words and _hits: (at, len, gram) of each window whose hash a benchmark n-gram has."""
    sizes = {r["_len"]: r["n"] for r in grams.groupBy("_len").agg(F.countDistinct("_gram").alias("n")).collect()}  # at most n rows
    worded = docs.withColumn("_w", words_of(F.col(text_col)))
    if sum(sizes.values()) > BROADCAST_GRAMS:
        raise ValueError(f"{sum(sizes.values())} n-grams are more than are broadcast; use joined_hits()")
    found = [_hits_of(length, [r[0] for r in grams.where(F.col("_len") == length).select(_gram_hash(length)).distinct().collect()]) for length in sorted(sizes)]
    none = F.array().cast("array<struct<at:int,len:int,gram:string>>")
    return worded.withColumns({"_n_words": F.size("_w"), "_hits": F.concat(none, *found)}).drop("_w")


def _windows_of(length: int) -> Column:
    return F.transform(_places(length), lambda i: F.struct(window_hash(F.col("_w"), i, length).alias("h"), F.array_join(F.slice("_w", i + 1, length), " ").alias("g")))


def joined_hits(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """As window_hits, for a benchmark too large to broadcast: there is no set then, windows are exploded and joined by
    hash with the n-grams (a window that many documents hold is one row on the right side; Spark splits the left)."""
    lengths = [r[0] for r in grams.select("_len").distinct().collect()]
    worded = docs.select("_key", words_of(F.col(text_col)).alias("_w"))
    parts = []
    for length in sorted(lengths):
        wanted = grams.where(F.col("_len") == length).select(_gram_hash(length).alias("_h")).distinct()
        windows = worded.select("_key", F.posexplode(_windows_of(length)).alias("_at", "_x"))
        hit = windows.select("_key", "_at", F.col("_x.h").alias("_h"), F.col("_x.g").alias("_g")).join(wanted, "_h", "left_semi")
        parts.append(hit.select("_key", F.struct(F.col("_at").alias("at"), F.lit(length).alias("len"), F.col("_g").alias("gram")).alias("_hit")))
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    hits = hits.distinct().groupBy("_key").agg(F.collect_list("_hit").alias("_hits"))
    none = F.array().cast("array<struct<at:int,len:int,gram:string>>")
    sized = docs.withColumn("_n_words", F.size(words_of(F.col(text_col))))
    return sized.join(hits, "_key", "left").withColumn("_hits", F.coalesce("_hits", none))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 8) -> DataFrame:
    """One row per row of ``docs``: its id column, _key (tells apart rows that share an id), _n_words,
    _spans (sorted, merged (start, n) runs of hit words) and _items (sorted distinct item ids as strings)."""
    grams = benchmark_grams(items, item_id_col, item_text_col, n)
    grams = cut(grams, "grams")
    many = grams.select(F.countDistinct("_gram")).head()[0]
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), row_key(id_col, text_col).alias("_key"))
    scan = window_hits if many <= BROADCAST_GRAMS else joined_hits
    if not many:
        scanned = keyed.select("_id", "_key", F.size(words_of(F.col("_t"))).alias("_n_words"), F.array().cast("array<struct<at:int,len:int,gram:string>>").alias("_hits"))
    else:
        scanned = scan(keyed, grams, "_t").select("_id", "_key", "_n_words", "_hits")
    scanned = cut(scanned, "windows")
    hits = scanned.where(F.size("_hits") > 0).select("_key", F.explode("_hits").alias("_h")).select("_key", "_h.at", "_h.len", "_h.gram").distinct()
    # the hash only nominates: a hit counts once the n-gram itself is equal
    small = F.broadcast(grams) if many <= BROADCAST_GRAMS else grams
    true = hits.join(small, (F.col("gram") == F.col("_gram")) & (F.col("len") == F.col("_len")))
    by = true.groupBy("_key").agg(F.array_sort(F.collect_set("_item")).alias("_items"), F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b")))).alias("_iv"))
    joined = scanned.select("_id", "_key", "_n_words").join(by, "_key", "left")
    return joined.select(
        F.col("_id").alias(id_col), "_key", "_n_words",
        F.coalesce("_iv", F.array().cast("array<struct<a:int,b:int>>")).alias("_spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("_items"),
    )


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with equal id and text, which have equal results."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(F.col(text_col).isNull(), text_col)), F.hex(F.xxhash64(F.lit("row"), text_col)))


def n_covered(spans: Column) -> Column:
    """Words in the union of (a, b) spans that are sorted by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto"))
    return F.aggregate(spans, start, step)["n"]


def drop_contaminated(docs: DataFrame, items: DataFrame, *, min_items: int = 1, id_col: str = "doc_id", text_col: str = "text", **more: object) -> DataFrame:
    """Rows of ``docs`` in which windows of fewer than ``min_items`` items occur; all columns as they were. By
    default one window is enough to go; ``remove_spans`` keeps the rest of such documents instead."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **more)
    bad = found.where(F.size("_items") >= min_items).select("_key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), row_key(id_col, text_col).alias("_key"))
    return keyed.join(bad, "_key", "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more: object) -> DataFrame:
    """``docs`` with the hit words cut out of the text of the rows that have any, each with what stands between it
    and the next word; the rest of the text stays as it was."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **more).where(F.size("_spans") > 0).select("_key", "_spans").dropDuplicates(["_key"])
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), row_key(id_col, text_col).alias("_key"))
    joined, text = keyed.join(found, "_key", "left"), F.col("_row")[text_col]
    # a word and what follows it; the words are those of words_of, before lower-casing
    pieces = F.regexp_extract_all(text, F.lit(f"{WORD_AS_IS}(?:{BETWEEN})*"), F.lit(0))
    before = F.regexp_extract(text, f"^(?:{BETWEEN})*", 0)
    rest = F.filter(pieces, lambda w, i: ~F.exists("_spans", lambda s: (i >= s["a"]) & (i < s["b"])))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(before, F.array_join(rest, "")))
    return joined.select(*[(clean if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
