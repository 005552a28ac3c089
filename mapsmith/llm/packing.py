"""Packing by power-of-two decomposition: each document's ids are cut into pieces whose lengths are powers of two,
the longest that fit first; every piece is a sequence of its own and equal lengths make a bucket, so no sequence
crosses documents and none is padded.

Results in special cases: a null or empty text is its end id, one piece of length 1; rows that repeat an id are
packed each for itself; a null id is carried; other columns are not read; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapsmith.llm.tokens import as_u32, encoder


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, in order; ``longest`` is a power of two."""
    out, at = [], 0
    for _ in range(n // longest):
        out.append((at, longest))
        at += longest
    for k in range(longest.bit_length() - 2, -1, -1):
        if (n % longest) >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, *, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length (its bucket), doc_tokens, sequence_id, offset (always 0) and ids
    (little-endian unsigned 32-bit). No shuffle: a sequence_id is the task's number and a count within it."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    fields = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*f) for f in fields)])

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, serial = encoder(tokenizer, end_id), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                rows: list[list] = [[] for _ in range(7)]
                for k, packed in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids = as_u32(packed, enc.type)
                    n = len(ids) // 4
                    for start, length in binary_pieces(n, longest):
                        for column, value in zip(rows, (k, start, length, n, serial, 0, ids[4 * start : 4 * (start + length)]), strict=True):
                            column.append(value)
                        serial += 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:6]), pa.array(rows[6], pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(build, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, ready for a curriculum over lengths."""
    pieces.write.partitionBy("length").parquet(path)
