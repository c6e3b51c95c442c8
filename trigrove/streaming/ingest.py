"""Structured Streaming into the catalog: every micro-batch of documents becomes a dataset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from trigrove.operators.engine import Engine


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, types: Iterable[str] = ("gram3",), taints: Iterable[str] = (), compact_every: int = 0, **trigger) -> StreamingQuery:
    """Indexes a stream of (path, content). A batch that is run again after a failure leaves out what it has indexed.

    ``compact_every`` merges small datasets after so many batches; ``trigger`` is passed to the stream writer.
    """
    kinds, tags = list(types), list(taints)

    def batch(found: DataFrame, number: int) -> None:
        found = found.persist()
        try:
            engine.index(found, kinds, tags, check=True)
        finally:
            found.unpersist()
        if compact_every and number % compact_every == compact_every - 1:
            engine.compact(smart=True)

    writer = stream.select("path", "content").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def matching(stream: DataFrame, condition: Column) -> DataFrame:
    """A stream's documents that a compiled scan condition lets through: standing queries over what arrives."""
    return stream.where(condition)
