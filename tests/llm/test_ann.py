import numpy as np
from pyspark.sql import functions as F

from mapsmith.llm import ann


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def test_small_table_is_exact_and_bad_rows_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1, "x") for i in range(60)]
    rows += [(i, rows[0][1], 1, "x") for i in (61, 62, 63)]  # ties
    bad = [(70, None, 1, "x"), (71, [0.0] * 8, 1, "x"), (72, [float("nan")] * 8, 1, "x"), (73, [1.0, None] * 4, 1, "x"), (74, [1.0], 1, "x"), (None, [1.0] * 8, 1, "x"), (100, [float("inf")] * 8, 1, "x"), (75, [], 1, "x")]
    df = spark.createDataFrame(rows + bad + rows[5:7], "vec_id long, embedding array<double>, leaf int, _v string")
    got = ann.search(df, F.col("_id") % 20 == 0, 10).collect()
    want = brute([(r[0], r[1]) for r in rows], [(r[0], r[1]) for r in rows if r[0] % 20 == 0], 10)
    for q, ids in want.items():
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == ids
    assert {r["query_id"] for r in got} == set(want)
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(spark.createDataFrame(rows[:3], df.schema), F.col("_id") == 0, 10).collect()
    assert len(few) == 2


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, leaf_size=32, sample=1000).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hit / 300 >= 0.9


def recall_and_share(spark, n, groups):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(groups, 24))
    x = (centres[rng.integers(groups, size=n)] + 0.05 * rng.normal(size=(n, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, leaf_size=32, trees=6).collect()
    hit = 0
    for q in range(0, n, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    forest = ann.Forest(x.astype(float), 6, 32)
    leaves = {r["query_id"]: r["leaves"] for r in got}
    return hit / (n / 10), np.mean(list(leaves.values())) / forest.leaves


def test_a_larger_table_is_searched_in_a_smaller_part(spark):
    small, large = (recall_and_share(spark, n, n // 50) for n in (1500, 6000))
    assert small[0] >= 0.9 and large[0] >= 0.9
    assert large[1] < 0.6 * small[1]


def test_one_row(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.search(df).count() == 0


def test_ties_across_leaves(spark):
    """More equal vectors than a leaf holds: the smaller ids come first."""
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(300)] + [(i, [float(i), 0.0, 1.0]) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("_id") == 0, 10, leaf_size=16, trees=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(i, i, 0.0) for i in range(1, 11)]
