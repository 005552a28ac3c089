"""N-gram Jaccard join by prefix filtering under several global token orders.

Tokens are 64-bit hashes of word shingles. In every global order, two sets of the wanted similarity share a token of
their prefixes (Rong et al. 2013 filter by several orders at once). The orders here put shingles that many documents
share last, by how many, and break ties by a hash of their own each.

1. One pass gives each document's set size and digest; documents of equal sets are one class from here on. The same
   pass counts shingles that repeat within a task, which is enough to tell common ones: any order is a right one.
2. A second pass lists each class's prefix under the first order, by token. Tokens of one class alone go; a row also
   goes when its position leaves too few tokens for any partner of its token. Classes that are left over get their
   prefixes under the further orders.
3. Classes are compared with the class that has the token earliest (in a group of near copies, the least edited one),
   and what is similar becomes one component. This leaves few pairs that are not known to be connected.
4. All other pairs of different components that share a token, early enough in both, are listed; every one has a
   member outside the token's largest component.
5. Before any text moves, the filters are intersected on the keys: a pair stays a candidate only if its prefixes share
   a token under each further order too. Then the sets themselves are compared.

No pair of one component is compared twice over, none of different components is left out, and no group is capped.
Tokens that repeat often are dealt out by class too, and what is needed of them as a whole is aggregated in each task
first; class keys and components of many rows are joined by broadcasting the few of them (``join_few``).

Results in special cases: a document of fewer words than a shingle has its whole sequence as one shingle; one
without words has an empty set, which is linked with nothing; a null id is linked with nothing and has no component;
rows that repeat an id are one document, linked by any of its texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.llm import wordhash
from mapsmith.llm.common import cut, release
from mapsmith.operators.components import components

ORDERS = 3
#: The most common shingles, which go to every task; ordering no more than these is as right, only slower.
COMMON = 500_000
#: Tokens whose repeats are counted at once.
COUNT_AT_ONCE = 3_000_000
#: Up to so many class keys are broadcast to pick the texts to compare (8 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000
NEAREST = 3
#: A token of this level (from 724 times on; there are COMMON at most) is dealt to SALTS groups by class.
HOT_LEVEL, SALTS = 20, 64
#: A key is hot if it has more than one in HOT_SHARE of all rows (so there are fewer than HOT_SHARE of them), and
#: more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 2_000, 200
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, stop in wordhash.chunks(texts):
        words = wordhash.Words(texts[first:stop], lower=True)
        hashes = words.hashes()
        grams = wordhash.windows(hashes, n)
        for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield wordhash.windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_key(tokens: np.ndarray) -> int:
    """Equal sets have equal keys: the mixed sum of the mixed tokens and their number (64 bits)."""
    total = np.sum(wordhash.mix(tokens ^ _SALTS[3]), dtype=np.uint64) + np.uint64(len(tokens))
    return int(signed(wordhash.mix(np.array([total], np.uint64)))[0])


def level_of(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each token is, from 0."""
    if not len(common[0]) or not len(tokens):
        return np.zeros(len(tokens), np.int64)
    at = np.searchsorted(common[0], tokens).clip(max=len(common[0]) - 1)
    return np.where(common[0][at] == tokens, common[1][at], 0)


def ranks(tokens: np.ndarray, level: np.ndarray, orders: range) -> list[np.ndarray]:
    """For each order, indices that sort ``tokens`` by how common they are, then by the order's own hash."""
    top = level.astype(np.uint64) << np.uint64(57)  # on top of the hash: one sort of numbers
    return [np.argsort(top | (wordhash.mix(tokens ^ _SALTS[k]) >> np.uint64(7)), kind="stable") for k in orders]


def prefix_size(n, t: Fraction):
    return n - -(-n * t.numerator // t.denominator) + 1


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    """Whether |a & b| / |a | b| >= t."""
    if not len(a) or not len(b) or min(len(a), len(b)) * t.denominator < max(len(a), len(b)) * t.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * t.denominator >= t.numerator * (len(a) + len(b) - both)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(_id, n, key) of each row of (_id, _t), and among them rows of (token, times) without an n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        held: list[np.ndarray] = []
        size, known = 0, set()

        def repeats() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            tokens, times = tokens[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64()), pa.nulls(len(tokens), pa.int64()), pa.nulls(len(tokens), pa.int64()), pa.array(signed(tokens)), pa.array(times.astype(np.int64))], names=["_id", "n", "key", "token", "times"])

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids, sizes, keys = part.column(0), [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), n):
                    sizes.append(len(tokens))
                    keys.append(class_key(tokens))
                    if keys[-1] not in known:
                        known.add(keys[-1])
                        held.append(tokens)
                        size += len(tokens)
                    if size >= COUNT_AT_ONCE:
                        yield repeats()
                        held, size, known = [], 0, set()
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], names=["_id", "n", "key", "token", "times"])
        if size:
            yield repeats()

    return docs.mapInArrow(run, "_id long, n long, key long, token long, times long")


def common_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common tokens, and the level of each (at most COMMON of them)."""
    counted = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where("times >= 12")
    got = counted.orderBy(F.desc("times"), "token").limit(COMMON).toArrow()
    tokens, times = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], 1 + (2 * np.log2(np.maximum(times[order], 1))).astype(np.int64)


def prefixes(rows: DataFrame, n: int, t: Fraction, common) -> DataFrame:
    """(token, key, n, pos, salt) of the first order, for each class met in a task; salt is above 0 for hot tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        known: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                out: list[list] = [[], [], [], [], []]
                for tokens in shingle_sets(part.column(0).to_pylist(), n):
                    if not len(tokens) or (key := class_key(tokens)) in known:
                        continue
                    known.add(key)
                    many, level = prefix_size(len(tokens), t), level_of(tokens, common.value)
                    first = ranks(tokens, level, range(1))[0][:many]
                    out[0].append(signed(tokens[first]))
                    out[1].append(np.full(many, key, np.int64))
                    out[2].append(np.full(many, len(tokens), np.int32))
                    out[3].append(np.arange(1, many + 1, dtype=np.int32))
                    out[4].append(np.where(level[first] >= HOT_LEVEL, 1 + key % SALTS, 0).astype(np.int8))
                if len(known) > 500_000:
                    known.clear()
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["token", "key", "n", "pos", "salt"])

    return rows.where("_id IS NOT NULL").select("_t").mapInArrow(run, "token long, key long, n int, pos int, salt byte")


def classes_of(rows: DataFrame, n: int, t: Fraction, common) -> DataFrame:
    """(key, _t, p1, p2, ...) of rows of (_id, _t): a text of the class, and 32 bits of each token of its prefixes under
    the further orders."""
    names = [f"p{k}" for k in range(1, ORDERS)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                keys, found, sizes = [], [[] for _ in names], [0]
                for tokens in shingle_sets(part.column(0).to_pylist(), n):
                    many = prefix_size(len(tokens), t) if len(tokens) else 0
                    keys.append(class_key(tokens) if many else None)
                    sizes.append(many)
                    for k, of in enumerate(ranks(tokens, level_of(tokens, common.value), range(1, ORDERS))):
                        found[k].append(tokens[of[:many]].astype(np.uint32).view(np.int32))
                ends = pa.array(np.cumsum(sizes).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(f) if f else np.zeros(0, np.int32))) for f in found)], names=["key", "_t", *names])

    return rows.select("_t").mapInArrow(run, "key long, _t string, " + ", ".join(f"{c} array<int>" for c in names))


def join_few(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join with a table of one row for each key. Keys that many rows of ``left`` have are few: they are
    broadcast, the others shuffled."""
    total = left.count()
    hot = left.groupBy(on).count().where(F.col("count") > max(HOT_ROWS, total // HOT_SHARE)).select(on)
    hot = cut(hot, "hot")  # fewer than HOT_SHARE rows
    many = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, "left")
    few = left.join(F.broadcast(hot), on, "left_anti").join(right, on, "left")
    return few.unionByName(many)


def agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of class keys whose prefixes share a token under every further order."""
    of = lambda name: sets.select(F.col("key").alias(name), *[F.col(f"p{k}").alias(f"_{name}{k}") for k in range(1, ORDERS)])
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    for k in range(1, ORDERS):
        both = both.where(F.arrays_overlap(f"_a{k}", f"_b{k}"))
    return both.select("a", "b")


def compare(pairs: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of class keys that are similar."""
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("_t").alias("_tb")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("_t").alias("_ta")), "a").select("a", "b", "_ta", "_tb")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        last, left = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                keys, good = part.column(0).to_pylist(), []
                for k, right in enumerate(shingle_sets(part.column(3).to_pylist(), n)):
                    if keys[k] != last:
                        last, left = keys[k], next(shingle_sets([part.column(2)[k].as_py()], n))
                    good.append(similar(left, right, t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles and component_id (least id reachable by links)."""
    spark, t = docs.sparkSession, Fraction(threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    found = cut(signatures(rows, n), "signatures")
    common = spark.sparkContext.broadcast(common_tokens(found))
    members = found.where("n IS NOT NULL").select("_id", "n", "key")
    index = prefixes(rows, n, t, common)
    top, bottom = t.numerator, t.numerator + t.denominator

    # of a hot token the least partner is not known here: any that its size allows
    own = Window.partitionBy("token", "salt")
    held = index.withColumns({"_least": F.min("n").over(own), "_first": F.min("key").over(own), "_last": F.max("key").over(own)})
    smallest = F.ceil(F.col("n") * t.numerator / t.denominator)
    partner = F.when(F.col("salt") > 0, smallest).otherwise(F.greatest(F.col("_least"), smallest))
    held = held.where((F.col("salt") > 0) | (F.col("_first") != F.col("_last"))).where(F.col("n") - F.col("pos") + 1 >= F.ceil((F.col("n") + partner) * top / bottom))
    held = cut(held.select("token", "key", "n", "pos", "salt").distinct(), "held")
    # one text, and the further prefixes, of each class that may have a partner
    keys = held.select("key").distinct()
    ids = cut(members.groupBy("key").agg(F.min("_id").alias("_id")).join(keys, "key", "left_semi").select("_id"), "ids")
    small = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = classes_of(rows.join(F.broadcast(ids) if small else ids, "_id", "left_semi"), n, t, common)
    texts = cut(texts.join(keys, "key", "left_semi").dropDuplicates(["key"]), "texts")
    further = texts.drop("_t")

    def fits(a: str, b: str):
        least = F.ceil((F.col(f"{a}.n") + F.col(f"{b}.n")) * top / bottom)
        big, less = F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")), F.least(F.col(f"{a}.n"), F.col(f"{b}.n"))
        return (less * t.denominator >= big * t.numerator) & (F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) + 1 >= least)

    # the earliest row of each token: by window, and for hot tokens from what each task has aggregated
    row = F.struct("pos", "key", "n")
    few = held.where("salt = 0").withColumn("c", F.min(row).over(Window.partitionBy("token")))
    many = held.where("salt > 0")
    first = few.unionByName(many.join(F.broadcast(many.groupBy("token").agg(F.min(row).alias("c"))), "token").select(few.columns))  # COMMON rows at most
    near = first.select("token", F.struct("key", "n", "pos").alias("x"), F.col("c").alias("y")).where("x.key != y.key").where(fits("x", "y"))
    near = near.groupBy(F.col("y.key").alias("a"), F.col("x.key").alias("b")).count()
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))).where(f"_r <= {NEAREST}").select("a", "b")
    best = cut(best, "best")
    links = cut(compare(agreeing(best, further), texts, n, t), "links")
    # classes that one repeated id holds
    twice = members.where("n > 0 AND _id IS NOT NULL").groupBy("_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.collect_set("key").alias("_k")).where("a != b")
    links = cut(links.unionByName(twice.select("a", F.explode("_k").alias("b"))), "links")
    label = cut(components(links, "a", "b"), "labels")

    labelled = held.drop("salt").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    sizes = labelled.groupBy("token", "comp").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", F.col("comp"))).alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("m.comp").alias("main"))
    open_rows = cut(labelled.join(largest, "token"), "open")
    x, y = open_rows.where("comp != main").alias("x"), open_rows.alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & fits("x", "y"))
    rest = cut(rest.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct(), "rest")
    # what was compared above and found different is known
    rest = rest.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = cut(compare(agreeing(rest, further), texts, n, t), "links")
    final = cut(components(links.unionByName(more), "a", "b"), "labels")

    # by class: the least id of its component; then by row
    own = members.where("n > 0 AND _id IS NOT NULL").groupBy("key").agg(F.min("_id").alias("_least"))
    classes = cut(own.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).select("key", "comp", "_least"), "classes")
    least = classes.groupBy("comp").agg(F.min("_least").alias("_c"))
    named = cut(join_few(classes.select("key", "comp"), least, "comp").select("key", "_c"), "named")
    out = join_few(members, named, "key")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("_id"))).alias("component_id"))
