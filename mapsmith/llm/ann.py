"""Approximate nearest neighbours: a forest of random-projection trees, searched per query through one priority
queue over all trees, then exact reranking of the rows in the leaves it reached.

The trees' hyperplanes are fitted on a bounded sample (``SAMPLE`` rows, those with the least hash of their id); every
row is indexed. A query first visits a number of leaves that grows with the logarithm of their number, then twice as
many, and so on, until a doubling brings in none of its k nearest. Where vectors lie in groups, that is after the
first rounds; among vectors without any structure it takes a large part of the leaves, as no tree can tell
there which are near. Rows and queries meet by leaf: a leaf of many rows or queries is split into parts, each
compared for itself, and only the nearest k of each part go on.

Results in special cases: rows whose id or vector is null, whose vector is zero, holds a null or non-finite
component or has another length than most, take no part; a query with fewer candidates than k gets all of them;
equal distances are ordered by the smaller id; rows that repeat an id are one candidate at its least distance, and
none of them is a candidate of the query of that id; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.llm.common import cut, least_hashed

SAMPLE = 50_000
TREES = 12
LEAF = 96
#: Leaves of the first round for each doubling of their number.
VISITS_PER_LEVEL = 4
#: Rows, and queries, of a leaf that are compared at once.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 2_000, 8_000


class Tree:
    """Nodes in arrays: normal, offset, left, right; leaf is the leaf's number or -1."""

    def __init__(self, x: np.ndarray, leaf_size: int, rng: np.random.Generator):
        self.normals, self.offsets, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.leaf)
            if parent is not None:
                (self.left if side == 0 else self.right)[parent] = node
            split = plane(x[rows], rng) if len(rows) > leaf_size else None
            for column, value in zip((self.normals, self.offsets, self.left, self.right), split[:2] + (-1, -1) if split else (np.zeros(x.shape[1]), 0.0, -1, -1), strict=True):
                column.append(value)
            self.leaf.append(-1 if split else self.leaves)
            if split:
                todo += [(rows[split[2]], node, 0), (rows[~split[2]], node, 1)]
            else:
                self.leaves += 1
        self.normals, self.offsets = np.array(self.normals), np.array(self.offsets)
        self.left, self.right, self.leaf = (np.array(v) for v in (self.left, self.right, self.leaf))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.leaf[at] < 0)).size:
            node = at[inner]
            below = np.einsum("ij,ij->i", x[inner], self.normals[node]) < self.offsets[node]
            at[inner] = np.where(below, self.left[node], self.right[node])
        return self.leaf[at]


def plane(x: np.ndarray, rng: np.random.Generator) -> tuple | None:
    """(normal, offset, rows below) between the means of two random clusters, at the median; None if nothing splits."""
    some = x[rng.choice(len(x), min(len(x), 256), replace=False)]
    a, b = some[0], some[-1]
    for _ in range(3):
        near = ((some - a) ** 2).sum(1) <= ((some - b) ** 2).sum(1)
        if near.all() or not near.any():
            break
        a, b = some[near].mean(0), some[~near].mean(0)
    normal = a - b
    if not (size := np.linalg.norm(normal)):
        spread = x.max(0) - x.min(0)
        if not spread.any():
            return None
        normal, size = np.eye(x.shape[1])[spread.argmax()], 1.0
    normal = normal / size
    shadow = x @ normal
    for offset in (np.median(shadow), (shadow.max() + shadow.min()) / 2):
        below = shadow < offset
        if below.any() and not below.all():
            return normal, float(offset), below
    return None


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf_size: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(x, leaf_size, rng) for _ in range(trees)]
        self.base = np.concatenate([[0], np.cumsum([t.leaves for t in self.trees])])  # leaves are numbered through

    @property
    def leaves(self) -> int:
        return int(self.base[-1])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree."""
        return np.stack([t.leaf_of(x) + b for t, b in zip(self.trees, self.base, strict=False)], axis=1)

    def search(self, q: np.ndarray, visits: int) -> list[int]:
        """The ``visits`` leaves with the least margin to cross, over all trees through one queue."""
        shadow = [t.normals @ q - t.offsets for t in self.trees]
        heap = [(0.0, k, 0) for k in range(len(self.trees))]
        found = []
        while heap and len(found) < visits:
            margin, k, node = heapq.heappop(heap)
            t = self.trees[k]
            while t.leaf[node] < 0:
                d = shadow[k][node]
                near, far = (t.left[node], t.right[node]) if d < 0 else (t.right[node], t.left[node])
                heapq.heappush(heap, (max(margin, abs(d)), k, far))
                node = near
            found.append(int(t.leaf[node] + self.base[k]))
        return found


def matrix(column) -> np.ndarray:
    """Of an Arrow column of equally long lists of float or double, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_in(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, within: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, exact distances) of the k nearest rows of each query that are no farther than ``within``, its
    own id left out."""
    norms = (x * x).sum(1)
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        rough = norms[None] + (part * part).sum(1)[:, None] - 2 * part @ x.T
        rough[query_ids[i : i + 256, None] == ids[None]] = np.inf
        for j in range(len(part)):
            row = rough[j]
            if len(row) > k:
                limit = np.partition(row, k - 1)[k - 1]
                pick = np.flatnonzero(row <= limit + 1e-9 * (1 + abs(limit)))
            else:
                pick = np.arange(len(row))
            pick = pick[np.isfinite(row[pick])]
            d = np.sqrt(((x[pick] - part[j]) ** 2).sum(1))
            pick, d = pick[d <= within[i + j]], d[d <= within[i + j]]
            best = np.lexsort((ids[pick], d))[:k]
            yield int(query_ids[i + j]), ids[pick][best], d[best]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _v) of the rows that take part."""
    v = F.col("_v")
    good = v.isNotNull() & F.col("_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    found = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(kind).alias("_v")).where(good)
    sizes = found.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.where(F.size("_v") == sizes[0]["n"]) if sizes else found


def search(rows: DataFrame, queries: Column | None = None, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf_size: int = LEAF) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score and leaves (that the query visited).
    ``queries`` picks them by _id (default: ids divisible by 100)."""
    spark, valid = rows.sparkSession, usable(rows, id_col, vec_col)
    asked = F.col("_id") % 100 == 0 if queries is None else queries
    schema = "query_id long, vec_id long, score double"
    picked = least_hashed(valid, sample).select("_v").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves int")
    shared = spark.sparkContext.broadcast(Forest(matrix(picked.column(0).combine_chunks()), trees, leaf_size))
    leaves, kind = shared.value.leaves, valid.schema["_v"].dataType.simpleString()
    leaf_schema = f"leaf int, _id long, _v {kind}"

    def spread(part, found: list[np.ndarray]):
        """A row of ``part`` (two columns or three) for each leaf found for it."""
        import pyarrow as pa

        at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), *(c.take(at) for c in part.columns)], names=["leaf", "_id", "_v", "_far"][: 1 + part.num_columns])

    def indexed(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                yield spread(part, list(shared.value.leaves_of(matrix(part.column(1)))))

    def visited(first: int, stop: int):
        def visit(batches: Iterator) -> Iterator:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    yield spread(part, [np.array(shared.value.search(q, stop)[first:], np.int64) for q in matrix(part.column(1))])

        return visit

    def compare(mine, theirs):
        import pyarrow as pa

        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = (t.combine_chunks() for t in (mine, theirs))
        vectors = [matrix(t.column("_v").combine_chunks()) for t in (a, b)]
        ids = a.column("_id").to_numpy()
        most = int(np.unique(ids, return_counts=True)[1].max())  # rows that repeat an id are one candidate
        got = list(nearest_in(ids, vectors[0], b.column("_id").to_numpy(), vectors[1], b.column("_far").to_numpy(), k * most))
        return pa.table({"query_id": np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64), "vec_id": np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])})

    index = cut(valid.mapInArrow(indexed, leaf_schema), "forest")
    # as many rows as the forest has leaves, which the sample bounds
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    # with each query the distance beyond which nothing new counts: that of its k-th nearest so far
    waiting = cut(valid.where(asked).withColumn("_far", F.lit(float("inf"))), "queries")
    best, first, stop, level = None, 0, min(leaves, max(2 * trees, VISITS_PER_LEVEL * leaves.bit_length())), 0
    both = ["leaf", "_part", "_chunk"]
    while True:
        visits = cut(waiting.mapInArrow(visited(first, stop), f"{leaf_schema}, _far double"), "visits")
        wants = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
        parts = F.broadcast(spark.createDataFrame([(leaf, -(-held[leaf] // ROWS_AT_ONCE), -(-n // QUERIES_AT_ONCE)) for leaf, n in wants.items() if leaf in held], "leaf int, n_rows int, n_queries int"))
        left = index.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("_id"), "n_rows").cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1)).alias("_chunk"), "_id", "_v")
        right = visits.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("_part"), F.pmod(F.xxhash64("_id"), "n_queries").cast("int").alias("_chunk"), "_id", "_v", "_far")
        near = left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(compare, schema).withColumns({"level": F.lit(level), "leaves": F.lit(stop)})
        # a pair met again is an old one; the leaves of a query are those of its last round
        every = best.drop("rank").unionByName(near) if best else near
        once = every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("level").alias("level"), F.max("leaves").alias("leaves"))
        ranked = once.withColumns({"rank": F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")), "leaves": F.max("leaves").over(Window.partitionBy("query_id"))})
        best = cut(ranked.where(F.col("rank") <= k), "nearest")
        if stop >= leaves:
            break
        new = best.groupBy(F.col("query_id").alias("_id")).agg(F.count(F.when(F.col("level") == level, 1)).alias("new"), F.count("*").alias("n"), F.max("score").alias("far"))
        if level:
            waiting = waiting.join(new.where((F.col("new") == 0) & (F.col("n") == k)), "_id", "left_anti")
        waiting = waiting.drop("_far").join(new.where(F.col("n") == k).select("_id", F.col("far").alias("_far")), "_id", "left")
        waiting = cut(waiting.withColumn("_far", F.coalesce("_far", F.lit(float("inf")))), "queries")
        if waiting.isEmpty():
            break
        first, stop, level = stop, min(2 * stop, leaves), level + 1
    return best.select("query_id", "rank", "vec_id", "score", "leaves")
