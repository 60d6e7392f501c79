"""Structured Streaming sink: each micro-batch becomes one version of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream of (key, value, perhaps ttl_ns) into the store, exactly once.

    Of several rows of one key in a micro-batch the last by ``order`` counts (needed if keys repeat).
    A version carries the query's name and batch number, so a batch that is replayed after a
    failure is found in the log and not written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        if order is not None:
            fields = [c for c in batch.columns if c not in ("key", order)]
            batch = batch.groupBy("key").agg(F.max_by(F.struct(*fields), order).alias("_last")).select("key", "_last.*")
        store.write(batch, tag=f"{name}/{number}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
