"""Secret scans: fixed patterns, and beside them character Markov models of random strings and of ordinary
identifiers, whose log-likelihood ratio marks further strings.

The models are trained here from labelled samples: what the fixed patterns match is random, other long words of the
same texts are ordinary, and seeded random strings over common alphabets fill up the first kind. The sample is
bounded (``SAMPLE`` documents, those with the least hash of their id); every text is scanned whole.

Results in special cases: a null or empty text has no span; rows that repeat an id are scanned each for itself; a
null id is carried; other columns are not read; without any text the models know the seeded strings alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapsmith.llm.common import least_hashed

SAMPLE = 2_000
#: A word of so many characters is held against the models; it is a secret from so many nats a character.
LEAST_CHARS, LEAST_RATIO = 20, 0.5
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
#: What / = _ and - part in a word.
PIECE = re.compile(r"[A-Za-z0-9+]+")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
SIGNS = ALPHABETS[3] + "_=-"
#: Ordinary identifiers that any code has.
ORDINARY = "get_user_name set_default_value max_connection_count internationalization README-template config_file_path createElementById updateCustomerAddress application/json text/html src/main/resources __init__ is_valid_identifier numberOfElements totalAmountInCents org/apache/commons usr/local/share requestHeaderMap".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points. [0-9a-f]+ and AKIA[A-Z0-9]+ match whole runs, so a least length in the
    pattern drops just the short ones; an assignment with a short value is matched, then dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Markov:
    """First-order character model over SIGNS; pairs that were seldom seen fall back to how common the second
    character is."""

    index = {c: i for i, c in enumerate(SIGNS)}

    def __init__(self, words: list[str], fallback: float = 5.0):
        n = len(SIGNS)
        one, pairs = np.full(n, 0.2), np.zeros((n, n))
        for w in words:
            at = [self.index[c] for c in w]
            np.add.at(one, at, 1)
            np.add.at(pairs, (at[:-1], at[1:]), 1)
        one /= one.sum()
        self.first, self.pairs = np.log(one), np.log((pairs + fallback * one) / (pairs.sum(1, keepdims=True) + fallback))


class Ratio:
    def __init__(self, random_words: list[str], ordinary_words: list[str]):
        a, b = Markov(random_words), Markov(ordinary_words)
        self.first = dict(zip(SIGNS, (a.first - b.first).tolist(), strict=True))
        self.pairs = {x + y: float(v) for x, row in zip(SIGNS, a.pairs - b.pairs, strict=True) for y, v in zip(SIGNS, row, strict=True)}
        # a word without a digit has less to tell it by: it must beat all but one in a thousand of the ordinary ones
        plain = [self(w) for w in ordinary_words if len(w) >= LEAST_CHARS and not any(map(str.isdigit, w))]
        self.letters = max(LEAST_RATIO, float(np.quantile(plain, 0.999))) if plain else LEAST_RATIO

    def __call__(self, word: str) -> float:
        """Log-likelihood ratio for each character."""
        return (self.first[word[0]] + sum(map(self.pairs.__getitem__, map("".join, zip(word, word[1:], strict=False))))) / len(word)


def labelled(texts: list[str | None]) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers of a sample of texts."""
    rng, secret, plain = random.Random(11), [], list(ORDINARY)
    for alphabet in ALPHABETS:
        secret += ["".join(rng.choices(alphabet, k=rng.randint(20, 48))) for _ in range(400)]
    for text in texts:
        spans = base_spans(text or "")
        for a, kind, b in spans:
            value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
            secret += LONG.findall(value)
        plain += [m[0] for m in LONG.finditer(text or "") if not any(a < m.end() and m.start() < b for a, _, b in spans)]
    return secret, plain


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ratio:
    # the ids are picked first, so that only the texts of the sample move
    ids = least_hashed(docs.select(F.col(id_col).alias("_id")).distinct(), sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL")
    picked = rows.join(F.broadcast(ids), "_id", "left_semi")  # ``sample`` ids
    texts = picked.dropDuplicates(["_id", "_t"]).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_t")).limit(sample).select("_t").toArrow()
    return Ratio(*labelled(texts.column(0).to_pylist()))


def secret_parts(word: str, ratio: Ratio, least: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a word: all of it, or else stretches between separators."""

    def random_(w: str) -> bool:
        return len(w) >= LEAST_CHARS and ratio(w) >= (least if any(map(str.isdigit, w)) else max(least, ratio.letters))

    if random_(word):
        return [(0, len(word))]
    pieces = [(m.start(), m.end()) for m in PIECE.finditer(word)]
    if len(pieces) < 2 and (not pieces or pieces[0][1] - pieces[0][0] == len(word)):
        return []
    gain = [(ratio(word[a:b]) - least) * (b - a) for a, b in pieces]
    out, todo = [], [(0, len(pieces))]
    while todo:
        i, j = todo.pop()
        best, start, now, span = 0.0, i, 0.0, None
        for k in range(i, j):
            if now <= 0:
                now, start = 0.0, k
            now += gain[k]
            if now > best:
                best, span = now, (start, k + 1)
        if span is None:
            continue
        a, b = pieces[span[0]][0], pieces[span[1] - 1][1]
        if random_(word[a:b]):
            out.append((a, b))
        else:
            out += [pieces[k] for k in range(*span) if random_(word[slice(*pieces[k])])]
        todo += [(i, span[0]), (span[1], j)]
    return sorted(out)


def spans_of(text: str, ratio: Ratio, least: float = LEAST_RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind, end) by start and kind."""
    base = base_spans(text)
    more = []
    for m in WORD.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            more += [(m.start() + a, 3, m.start() + b) for a, b in secret_parts(m[0], ratio, least)]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ratio: Ratio, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_assign, n_access, n_hex, base (joined spans) and spans (all of them)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for cell in batch.column(1):
                base, every = spans_of(cell.as_py() or "", ratio)
                for k in range(3):
                    out[k].append(sum(1 for s in base if s[1] == k))
                out[3].append(joined(base))
                out[4].append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
