"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over the words of a text and over their beginnings (4 to 6 letters: inflected and compounded
forms share them), each counted once a text. In labelled texts that name a group of people, the name is swapped for
another group's, and a difference between the two scores is penalised: what is said about a group may raise the
score, that it is named may not.

The model is fitted on a bounded sample (``SAMPLE`` labelled rows, those with the least hash of their id); every
text is scored whole. Neither labels nor other columns are inputs of a score.

Results in special cases: a null or empty text gets the score of a text without known words; with no labelled row
all scores are 0.5; rows that repeat an id are scored each for itself (for fitting, equal rows count once); a null
id is never labelled and counts as held in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapsmith.llm.common import cut, least_hashed, release

SAMPLE = 8_000
#: A feature is counted if so many texts of the sample have it.
LEAST_TEXTS = 4
#: Tasks that the sample is dealt to.
TASKS = 16
FEATURES = 700
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Names of groups, each list interchangeable.
IDENTITY = (
    "women men girls boys females males transgender nonbinary".split(),
    "muslims christians jews hindus buddhists atheists catholics protestants".split(),
    "muslim christian jewish hindu buddhist atheist catholic protestant".split(),
    "gay straight lesbian bisexual heterosexual homosexual queer".split(),
    "black white asian african european latino arab indigenous".split(),
    "immigrants refugees natives foreigners citizens".split(),
    "frauen männer mädchen jungen".split(), "muslime christen juden hindus buddhisten atheisten".split(),
    "femmes hommes filles garçons".split(), "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "mujeres hombres niñas niños".split(), "musulmanes cristianos judíos hindúes budistas ateos".split(),
)


def features_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"{n}:{s}" for s in {w[:n] for w in words if len(w) >= n}} for n in PREFIXES))


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = {k: v for k, v in self.weights.items() if ":" not in k}
        self.starts = [(n, {k.split(":")[1]: v for k, v in self.weights.items() if k.startswith(f"{n}:")}) for n in PREFIXES]

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        total = self.bias + sum(self.words[w] for w in self.words.keys() & words)
        for n, starts in self.starts:
            total += sum(starts[s] for s in starts.keys() & {w[:n] for w in words if len(w) >= n})
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def swapped(text: str, rng: np.random.Generator | None = None) -> str | None:
    """``text`` with each group's name replaced by another of its list; None if it names no group. Without ``rng``
    the text itself decides which."""
    low, changed = text.lower(), False
    for names in IDENTITY:
        for name in names:
            if name in low and re.search(rf"\b{name}\b", low):
                rng = rng or np.random.default_rng(zlib.crc32(text.encode()))
                other = names[(names.index(name) + 1 + int(rng.integers(len(names) - 1))) % len(names)]
                low, changed = re.sub(rf"\b{name}\b", "\0" + other, low), True
        low = low.replace("\0", "")
    return low if changed else None


def gains(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio statistic of features that ``a`` of the n1 toxic and ``b`` of the n0 other texts have."""
    p, q, r = (a + 0.1) / (n1 + 0.2), (b + 0.1) / (n0 + 0.2), (a + b) / (n1 + n0)
    return 2 * (a * np.log(p / r) + b * np.log(q / r))


def choose(counts, n1: int, n0: int, n_features: int) -> list[str]:
    """Of an Arrow table (f, a, b): the features that tell most, and the names of groups."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = counts.combine_chunks()
    value = gains(*(counts.column(c).to_numpy().astype(np.float64) for c in "ab"), n1, n0)
    order = pc.sort_indices(pa.table({"f": counts.column("f"), "g": value}), [("g", "descending"), ("f", "ascending")])
    chosen = counts.column("f").take(order[:n_features]).to_pylist()
    named = {f for names in IDENTITY for name in names for f in features_of(name)}
    also = counts.column("f").filter(pc.is_in(counts.column("f"), pa.array(sorted(named), pa.string()))).to_pylist()
    return chosen + sorted(set(also) - set(chosen))


def indices(text: str, column: dict[str, int]) -> list[int]:
    return sorted(column[f] for f in features_of(text) if f in column)


def fit_rows(rows: list[list[int]], labels: list[int], others: list[list[int] | None], chosen: list[str], *, swap_weight: float = 5.0, decay: float = 0.05, steps: int = 300) -> Model:
    """``rows``: the features (of ``chosen``, by number) of each text; ``others``: those of the text with the names
    swapped, None where there are none."""
    y = np.array(labels, np.float32)

    def dense(found: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(found), len(chosen)), np.float32)
        for i, at in enumerate(found):
            out[i, at] = 1
        return out

    x, n1, n0 = dense(rows), y.sum(), len(y) - y.sum()
    of = [i for i, other in enumerate(others) if other is not None]
    gap = x[of] - dense([others[i] for i in of]) if of else None
    w, b = np.zeros(len(chosen), np.float32), float(np.log(n1 / n0))
    m, v, lead = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.where(y == 1, n0 / n1, 1.0).clip(max=8.0)
    lead = (lead / lead.mean()).astype(np.float32)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        error = (p - y) * lead
        slope = np.append(x.T @ error / len(y) + decay / len(y) * w, error.mean())
        if gap is not None:  # (score(x) - score(x'))^2 on the scale of log-odds
            slope[:-1] += 2 * swap_weight * (gap.T @ (gap @ w)) / len(of)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Model(b, {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4})


def constant(n1: int, n0: int) -> Model | None:
    """The model where there is nothing to tell apart."""
    if not n1 + n0:
        return Model()
    return None if n1 and n0 else Model(bias=float(np.log((n1 + 0.5) / (n0 + 0.5))))


def counted(texts: list[str], labels: list[int]):
    """Arrow table (f, a, b): in how many toxic and other texts each feature is."""
    import pyarrow as pa

    counts: dict[str, int] = {}  # without the label, and 2**32 times with it
    for text, label in zip(texts, labels, strict=True):
        for f in features_of(text):
            counts[f] = counts.get(f, 0) + (1 << 32 if label else 1)
    both = np.fromiter(counts.values(), np.int64, len(counts))
    return pa.table({"f": pa.array(counts, pa.string()), "a": both >> 32, "b": both & 0xFFFFFFFF})


def fit(texts: list[str], labels: list[int], *, n_features: int = FEATURES, **more: float) -> Model:
    """Of texts at hand; ``train`` does the same over tables."""
    n1 = sum(labels)
    if found := constant(n1, len(labels) - n1):
        return found
    counts = counted(texts, labels)
    counts = counts.filter(np.array(counts["a"]) + np.array(counts["b"]) >= LEAST_TEXTS)
    chosen = choose(counts, n1, len(labels) - n1, n_features)
    column = {f: i for i, f in enumerate(chosen)}
    others = [None if other is None else indices(other, column) for other in map(swapped, texts)]
    return fit_rows([indices(t, column) for t in texts], labels, others, chosen, **more)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, n_features: int = FEATURES, **more: float) -> Model:
    """Texts stay on the executors: the driver gets the counts of the sample's features, and then each text as the
    numbers of the features chosen."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    some = F.broadcast(least_hashed(marked, sample, "_y"))  # ``sample`` rows of two numbers
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(some, "_id").where("_t IS NOT NULL")
    picked = picked.withColumn("_h", F.xxhash64("_t")).dropDuplicates(["_id", "_h", "_y"]).orderBy(F.xxhash64("_id"), "_id", "_h", "_y").limit(sample)
    picked = cut(picked.repartition(TASKS).select("_id", "_h", "_t", "_y"), "toxicity-sample")
    sizes = {r["_y"]: r["count"] for r in picked.groupBy("_y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if found := constant(n1, n0):
        return found

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from counted(batch.column(0).to_pylist(), batch.column(1).to_pylist()).to_batches()

    counts = picked.select("_t", "_y").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chosen = choose(counts.where(F.col("a") + F.col("b") >= LEAST_TEXTS).toArrow(), n1, n0, n_features)
    column = {f: i for i, f in enumerate(chosen)}

    def numbers(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(3).to_pylist()
            others = [None if other is None else indices(other, column) for other in map(swapped, texts)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([indices(t, column) for t in texts], pa.list_(pa.int32())), pa.array(others, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_h", "_y", "x", "o"])

    id_type = picked.schema["_id"].dataType.simpleString()
    got = picked.select("_id", "_h", "_y", "_t").mapInArrow(numbers, f"_id {id_type}, _h long, _y int, x array<int>, o array<int>").toArrow().sort_by([("_h", "ascending"), ("_y", "ascending"), ("_id", "ascending")])
    return fit_rows(got["x"].to_pylist(), got["_y"].to_pylist(), got["o"].to_pylist(), chosen, **more)


def scorer(model: Model):
    """A column function: text to score."""

    import pandas as pd

    def score(parts):
        release()
        for texts in parts:
            yield texts.map(model.score, na_action=None).astype("float64")

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")
