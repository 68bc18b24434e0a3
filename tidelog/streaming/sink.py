"""Structured Streaming into the log: every micro-batch is one append, committed once even if it is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def write_stream(stream: DataFrame, store: Store, topic: str, partition_by: str, order_by: list[str], checkpoint: str, name: str, trigger: dict | None = None, drop_key: bool = False) -> StreamingQuery:
    """Start appending ``stream`` to ``topic``. ``name`` and the batch's number name the transaction."""

    def batch(df: DataFrame, number: int) -> None:
        store.ingest(topic, df, partition_by, order_by, drop_key=drop_key, txn=f"stream-{name}-{number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"processingTime": f"{store.config.checkpoint_interval_s} seconds"})).start()
