"""Token-ID files: fixed-width bit packing in blocks, with block and document offsets.

A file holds a run of whole documents in ascending id order. All numbers are little-endian:

    magic 4s "MSBP" | version u16 | bits u16 | block u32 | n_docs u64 | n_ids u64
    doc_end u64[n_docs]        ids up to the end of each document
    block_at u64[n_blocks + 1] byte offset of each block in the payload
    payload                    blocks of ``block`` ids, ``bits`` bits each, lowest bit first, each from a whole byte

``bits`` is the least that holds every id of the vocabulary. Any range of ids is read from its blocks alone.

Files are kept as rows of a table (one binary cell each), which Spark's writers commit and any store can hold;
``TokenFile`` reads the bytes of a cell, or of a file on disk through ``numpy.memmap``.

Results in special cases: a null or empty text has only the end id; rows that repeat an id stay apart (in order of
their text); a null id comes first; other columns are not read; an empty table gives no file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapsmith.llm.common import cut
from mapsmith.llm.tokens import encoder

HEAD = struct.Struct("<4sHHIQQ")
MAGIC, VERSION, BLOCK = b"MSBP", 1, 4096
#: A file is closed with the document that brings it to so many ids.
FILE_IDS = 1 << 20
#: Ids whose bits are spread out at once.
UNPACKED = 1 << 15


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids, as unsigned 32-bit integers."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    out, place = np.empty(n, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)
    for i in range(0, n, UNPACKED):  # a multiple of 8 ids starts on a whole byte
        m = min(UNPACKED, n - i)
        spread = np.unpackbits(raw[i * bits // 8 : -(-(i + m) * bits // 8)], count=m * bits, bitorder="little")
        out[i : i + m] = spread.reshape(m, bits) @ place
    return out


def file_bytes(docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x) for x in docs], dtype=np.uint64)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, VERSION, bits, block, len(docs), len(ids)), ends.astype("<u8").tobytes(), at.tobytes(), *blocks])


class TokenFile:
    """Random access to one file: ``ids(a, b)`` and ``document(k)``. ``data``: bytes, or a path."""

    def __init__(self, data: bytes | str):
        self.data = np.memmap(data, np.uint8, "r") if isinstance(data, str) else np.frombuffer(data, np.uint8)
        magic, version, self.bits, self.block, self.n_docs, self.n_ids = HEAD.unpack(self.data[: HEAD.size].tobytes())
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        n_blocks, at = -(-self.n_ids // self.block), HEAD.size
        self.ends = self.data[at : at + 8 * self.n_docs].view("<u8").astype(np.int64)
        at += 8 * self.n_docs
        self.block_at = self.data[at : at + 8 * (n_blocks + 1)].view("<u8").astype(np.int64)
        self.payload = self.data[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        if self.block * self.bits % 8 == 0:  # whole bytes: the blocks are one run of bits
            got = unpack(self.payload[self.block_at[first] : self.block_at[last + 1]], min((last + 1) * self.block, self.n_ids) - first * self.block, self.bits)
        else:
            got = np.concatenate([unpack(self.payload[self.block_at[k] : self.block_at[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def span(self, k: int) -> tuple[int, int]:
        return int(self.ends[k - 1]) if k else 0, int(self.ends[k])

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.span(k))


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 1, *, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """The table of files: shard and at (ids before it in its shard) put them in order; doc_ids, n_ids, data."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType())])

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, shard, at = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        bits, names, held, n = width(max(enc.vocabulary, end_id + 1)), [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([file_bytes(held, bits)], pa.binary())], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                for name, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    held.append(np.frombuffer(ids, enc.type))
                    names.append(name)
                    n += len(held[-1])
                    if n >= file_ids:
                        yield close()
                        at, names, held, n = at + n, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return cut(rows.repartitionByRange("_id").sortWithinPartitions("_id", "_t").mapInArrow(build, schema), "token-files", compression="none")


def read_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: its id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit)."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each writing task
    before, bases = 0, []
    for r in totals:
        bases.append((r["shard"], before))
        before += r["n"]
    base = F.broadcast(files.sparkSession.createDataFrame(bases, "shard int, _base long"))
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def open_all(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                names, data, start = row.column(0).flatten(), row.column(1)[0].as_py(), row.column(2)[0].as_py()
                f = TokenFile(data)
                for i in range(0, f.n_docs, 512):
                    spans = [f.span(j) for j in range(i, min(i + 512, f.n_docs))]
                    ids = f.ids(spans[0][0], spans[-1][1]).astype("<u4")
                    cells = [ids[a - spans[0][0] : b - spans[0][0]].tobytes() for a, b in spans]
                    yield pa.RecordBatch.from_arrays([names.slice(i, 512), pa.array([start + a for a, _ in spans], pa.int64()), pa.array(cells, pa.binary())], names=schema.names)

    placed = files.join(base, "shard").select("doc_ids", "data", (F.col("_base") + F.col("at")).alias("_start"))
    return placed.mapInArrow(open_all, schema)
