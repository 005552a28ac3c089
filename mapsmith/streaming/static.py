"""Row-local and stream-static operators over Structured Streaming: each batch of arriving features is joined with
tables that stand still, and needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mapsmith.algorithms.base import Algorithm
from mapsmith.operators.model import Features

#: Operators whose result for a row depends on that row and the references alone.
ROW_LOCAL = frozenset({"GeneralizePolygonsToPoints", "GeneralizeSlopeLines", "KeepIntersection", "RemoveOverlap", "GeneralizeCliffs"})


def each_batch(stream: DataFrame, operate: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """``operate`` on every micro-batch; ``sink`` gets the result and the batch's number, which repeats after a
    failure: a sink that overwrites by that number makes the whole exactly once."""
    def run(batch: DataFrame, number: int) -> None:
        sink(operate(batch), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"availableNow": True})).start()


def generalize_stream(stream: DataFrame, algorithm: Algorithm, references: dict[str, Features], sink: Callable[[DataFrame, int], None], checkpoint: str, **table: object) -> StreamingQuery:
    """An algorithm of ROW_LOCAL over a stream of features."""
    if type(algorithm).__name__ not in ROW_LOCAL:
        raise ValueError(f"{type(algorithm).__name__} looks at rows together")
    return each_batch(stream, lambda batch: algorithm.execute(Features(batch, **table), references).df, sink, checkpoint)
