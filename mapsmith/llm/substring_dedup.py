"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are taken at anchors: of any ``length`` consecutive words, one shingle of ``ANCHOR`` words has the least
hash, so two equal windows hold an equal anchor at the same place. An anchor that only one document has cannot start
a repeat, and its suffix is dropped before anything long is moved.

The suffixes left are split by a prefix of variable length: the anchor itself where at most ``GROUP`` suffixes share
it; where more do, the whole window at each place of the anchor in it. Of a window each task hands on one row only
(those of the least id), so however many documents hold it, its group gets a row for each task. Prefixes are gathered
into groups of ``GROUP`` rows on average. In a group the suffixes are sorted, which with the lengths of their common
prefixes is their suffix tree; the words before each anchor make a second tree, read backwards. A node of the first at depth ``length`` - o and one of the second at depth o enclose
the documents that hold one window whose anchor lies o words in: the least id among them keeps it, the others lose
its words. Words are compared themselves (by a group's own dictionary), never by hash.

Of suffixes that agree in all words that matter, a task hands on only the one of the least id; the others are known
to repeat it at once. So a passage that a third of all documents hold is one row for each task.

Results in special cases: null and empty texts and texts shorter than a window keep all words; a row with a null id
takes no part; rows that repeat an id are one document (they do not remove each other's words); a window repeated
within one document alone stays; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapsmith.llm import wordhash
from mapsmith.llm.common import cut, release

ANCHOR = 5
#: Suffixes of a group; an anchor that more suffixes share is split by whole windows.
GROUP = 8_000
#: Tasks that the rows of such an anchor are dealt to when they get its count.
SALTS = 64


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` shingles, where the first of the least hash is."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def row_hash(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode()) - (1 << 31)


def packed_texts(rows: DataFrame) -> DataFrame:
    """(_id, _th, _z): texts compressed for the two shuffles that they take part in; _th tells apart rows that share
    an id."""
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_th", T.IntegerType()), T.StructField("_z", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        release()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(row_hash, texts), pa.int32()), pa.array((pack((t or "").encode()) for t in texts), pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(h, _id, _th, pos: its places) of each different anchor of each document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, stop in wordhash.chunks(texts):
                words = wordhash.Words(texts[first:stop])
                grams = wordhash.windows(words.hashes(), ANCHOR)
                at, places = words.at.tolist(), []
                for a, b in zip(at, at[1:], strict=False):
                    places.append(a + np.unique(anchors(grams[a : max(a, b - ANCHOR + 1)], length - ANCHOR + 1)))
                n = [len(p) for p in places]
                flat = np.concatenate(places) if places else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                # a shingle that a document repeats is one row with all its places
                order = np.lexsort((flat, grams[flat], owner))
                flat, owner = flat[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[flat[1:]] != grams[flat[:-1]])])) if len(flat) else np.zeros(0, np.int64)
                pos = pa.ListArray.from_arrays(pa.array(np.append(new, len(flat)).astype(np.int32)), pa.array((flat - words.at[owner]).astype(np.int32)))
                crc = np.array([row_hash(t) if k else 0 for t, k in zip(texts[first:stop], n, strict=True)], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grams[flat[new]].view(np.int64)), ids.take(pa.array(owner[new] + first)), pa.array(crc[owner[new]]), pos], names=["h", "_id", "_th", "pos"])

    return rows.mapInArrow(run, "h long, _id long, _th int, pos array<int>")


def suffixes(shared: DataFrame, length: int, groups: int) -> DataFrame:
    """From (_id, _th, _z, _at: [(pos, n)]) to rows of two kinds: suffixes to compare (grp, _id, _th, pos: where the
    document has them, left: words before the anchor, words, mask: of the windows to judge there) and, without words,
    those known to repeat a lesser id's (mask: these windows)."""
    before = length - ANCHOR

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        release()
        unpack = zstandard.ZstdDecompressor().decompress
        every = (1 << before + 1) - 1
        names = ["grp", "_id", "_th", "pos", "left", "words", "mask"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32()]
        least: dict[tuple[int, bytes], tuple] = {}
        also: dict[tuple[int, bytes], list[tuple]] = {}  # as the one kept, from another row of the same id

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def keep(held: dict, more: dict, key: tuple, mine: tuple, known: list) -> None:
            """One row of the least id for each key, with all its places; the others are known to repeat it."""
            other = held.setdefault(key, mine)
            if other is mine:
                return
            if other[0] < mine[0]:
                known.append(repeated(mine))
            elif other[0] > mine[0]:
                known.append(repeated(other))
                known += map(repeated, more.pop(key, ()))
                held[key] = mine
            elif same := next((x for x in (other, *more.get(key, ())) if x[1] == mine[1]), None):
                same[2].extend(mine[2])
            else:
                more.setdefault(key, []).append(mine)

        def together(known: list) -> list[tuple]:
            """A row for all places of a document that repeat alike."""
            places: dict[tuple, list[int]] = {}
            for _, doc, crc, pos, _, _, mask in known:
                places.setdefault((doc, crc, mask), []).extend(pos)
            return [(None, doc, crc, pos, None, None, mask) for (doc, crc, mask), pos in places.items()]

        def sent() -> Iterator:
            out, windows, twice = [], {}, {}

            def split() -> list[tuple]:
                found = (*windows.values(), *(x for rest in twice.values() for x in rest))
                windows.clear()
                twice.clear()
                return [(group_of(b"%d %b" % (o, w), groups), doc, crc, pos, o, w, 1 << o) for doc, crc, pos, o, _, _, w in found]

            for doc, crc, pos, left, n, right, context in (*least.values(), *(x for rest in also.values() for x in rest)):
                words = context.split(b" ")
                if n <= GROUP:
                    out.append((group_of(b" ".join(words[left : left + ANCHOR]), groups), doc, crc, pos, left, context, every))
                else:
                    for o in range(left + 1):
                        if length - o <= right:
                            window = b" ".join(words[left - o : left - o + length])
                            keep(windows, twice, (o, window), (doc, crc, list(pos), o, n, length - o, window), out)
                    if len(windows) > 200_000:
                        out += split()
                if len(out) >= 20_000:
                    yield rows(out)
                    out = []
            out += split()
            for i in range(0, len(out), 20_000):
                yield rows(out[i : i + 20_000])
            least.clear()
            also.clear()

        seen = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                known = []
                for doc, crc, z, places in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    words = unpack(z).split()
                    for place in places:
                        pos, left = place["pos"], min(place["pos"], before)
                        context = b" ".join(words[pos - left : pos + length])
                        mine = (doc, crc, [pos], left, place["n"], min(length, len(words) - pos), context)
                        keep(least, also, (left, context), mine, known)
                    seen += len(places)
                if known:
                    yield rows(together(known))
                if len(least) + sum(map(len, also.values())) > 400_000 or seen > 4_000_000:
                    yield from sent()
                    seen = 0
        yield from sent()

    def repeated(row: tuple) -> tuple:
        doc, crc, pos, left, _, right, _ = row
        return None, doc, crc, pos, None, None, sum(1 << o for o in range(left + 1) if length - o <= right)

    return shared.mapInArrow(run, "grp int, _id long, _th int, pos array<int>, left int, words binary, mask int")


def group_of(prefix: bytes, groups: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(prefix) % groups


def nodes(columns: np.ndarray) -> np.ndarray:
    """(depth + 1, rows): the tree node of each row at each depth, from sorting the rows and the lengths of the
    common prefixes of neighbours."""
    n, depth = columns.shape
    order = np.lexsort(columns.T[::-1])
    differ = columns[order[1:]] != columns[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    out = np.zeros((depth + 1, n), np.int64)
    for d in range(1, depth + 1):
        out[d, order] = np.concatenate([[0], np.cumsum(common < d)])
    return out


def repeats_in(ids: np.ndarray, left: np.ndarray, words: list[bytes], length: int) -> np.ndarray:
    """For each suffix of a group, bit o set: the window from o words before its anchor is held by a lesser id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    before, n = length - ANCHOR, len(ids)
    lists = pc.split_pattern(pa.array(words, pa.large_binary()), b" ")
    code = lists.flatten().dictionary_encode().indices.to_numpy()
    at = lists.offsets.to_numpy()
    ahead, back = np.full((n, length), -1, np.int64), np.full((n, before), -1, np.int64)
    for k in range(length):
        has = at[:-1] + left + k < at[1:]
        ahead[has, k] = code[(at[:-1] + left + k)[has]]
    for k in range(before):
        has = left > k
        back[has, k] = code[(at[:-1] + left - 1 - k)[has]]
    forward, backward = nodes(ahead), nodes(back)
    mask = np.zeros(n, np.int64)
    for o in range(before + 1):
        whole = (left >= o) & (ahead[:, length - o - 1] >= 0)
        _, node = np.unique(forward[length - o] * n + backward[o], return_inverse=True)
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node[whole], ids[whole])
        mask |= np.where(whole & (ids > least[node]), 1 << o, 0)
    return mask


def repeated_windows(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(_id, _th, _hits: [(places, mask)]) of the documents that have any."""
    found = anchor_rows(rows, length)
    # counted from what each task has counted; then an anchor of many rows is dealt to SALTS tasks
    count = found.groupBy("h").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"), F.sum(F.size("pos")).alias("n"))
    counts = cut(count.where("_a != _b").select("h", "n"), "counts")
    many = F.broadcast(counts.where(F.col("n") > GROUP).select("h", F.lit(True).alias("_many")))
    salted = found.join(many, "h", "left").withColumn("_salt", F.when(F.col("_many"), F.pmod(F.xxhash64("_id", "_th"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_many")
    dealt = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > GROUP, SALTS - 1).otherwise(0))))
    shared = cut(salted.join(dealt, ["h", "_salt"]).select("_id", "_th", F.explode("pos").alias("pos"), "n"), "anchors")
    expected = shared.agg(F.sum(F.when(F.col("n") > GROUP, length - ANCHOR + 1).otherwise(1))).head()[0] or 0
    groups = max(1, expected // GROUP)
    places = shared.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("_at"))
    joined = texts.dropDuplicates(["_id", "_th"]).join(places, ["_id", "_th"]).select("_id", "_th", "_z", "_at")
    tails = cut(suffixes(joined, length, groups), "suffixes")

    def judge(table):
        import pyarrow as pa

        t = table.combine_chunks()
        ids = t.column("_id").to_numpy()
        mask = repeats_in(ids, t.column("left").to_numpy().astype(np.int64), t.column("words").to_pylist(), length)
        mask &= t.column("mask").to_numpy()
        some = pa.array(mask > 0)
        return pa.table({"_id": t.column("_id"), "_th": t.column("_th"), "pos": t.column("pos"), "mask": pa.array(mask.astype(np.int32))}).filter(some)

    schema = "_id long, _th int, pos array<int>, mask int"
    new = tails.where("words IS NOT NULL").select("grp", "_id", "_th", "pos", "left", "words", "mask").groupBy("grp").applyInArrow(judge, schema)
    hits = new.unionByName(tails.where("words IS NULL").select("_id", "_th", "pos", "mask"))
    return hits.groupBy("_id", "_th").agg(F.collect_list(F.struct("pos", "mask")).alias("_hits"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    texts = packed_texts(rows)
    hits = repeated_windows(rows.where("_id IS NOT NULL AND _t IS NOT NULL"), texts.where("_id IS NOT NULL"), length)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        release()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out: list[list] = [[], [], []]
                for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = unpack(z).split()
                    n = len(words)
                    if found:
                        edge = [0] * (n + 1)
                        for x in found:
                            # windows about one anchor overlap, so those marked are one run of words
                            mask = x["mask"]
                            first, stop = mask.bit_length() - 1, length - (mask & -mask).bit_length() + 1
                            for p in x["pos"]:
                                edge[p - first] += 1
                                edge[p + stop] -= 1
                        words = [w for w, depth in zip(words, accumulate(edge), strict=False) if not depth]
                    for column, value in zip(out, (n, n - len(words), b" ".join(words).decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=schema.names)

    return texts.join(hits, ["_id", "_th"], "left").select("_id", "_z", "_hits").mapInArrow(run, schema)
