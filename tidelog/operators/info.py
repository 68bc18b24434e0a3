"""Figures about topics, partitions, segments and chunks, each a DataFrame over the manifest or chunk statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def segments(store: Store, topic: str | None = None, partition: str | None = None) -> DataFrame:
    store.manifest.refresh()
    df = store.manifest.frame()
    if topic is not None:
        df = df.where(F.col("topic") == topic)
    return df if partition is None else df.where(F.col("partition") == partition)


def spans(store: Store, topic: str) -> DataFrame:
    """First offset and the one after the last of each partition."""
    return segments(store, topic).groupBy("partition").agg(F.min("record_start").alias("start"), F.max("record_end").alias("end"))


def size(store: Store, topic: str | None = None, partition: str | None = None) -> int:
    """Bytes of segments; of the whole store with the manifest's own."""
    n = segments(store, topic, partition).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return n if topic is not None else n + store.manifest.bytes()


def topic_bytes(store: Store) -> DataFrame:
    return segments(store).groupBy("topic").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def oldest_segment(store: Store, topic: str | None = None) -> DataFrame:
    """The segment with the least first time."""
    return segments(store, topic).orderBy("time_start", "topic", "partition", "segment").limit(1)


def edge_segments(store: Store, topic: str) -> DataFrame:
    """Least and largest segment number of each partition."""
    return segments(store, topic).groupBy("partition").agg(F.min("segment").alias("min_segment"), F.max("segment").alias("max_segment"))


def info(store: Store) -> DataFrame:
    """By topic and partition: first time of the first segment and last time of the last one, bytes, offsets, and segment numbers (both included).

    The two times come from the outermost segments, as times need not be in order; ``min_time`` and ``max_time`` are the true bounds.
    """
    return segments(store).groupBy("topic", "partition").agg(
        F.min_by("time_start", "segment").alias("oldest"), F.max_by("time_end", "segment").alias("newest"), F.min("time_start").alias("min_time"), F.max("time_end").alias("max_time"),
        F.sum("size").alias("bytes"), F.min("record_start").alias("record_start"), F.max("record_end").alias("record_end"), F.min("segment").alias("segment_start"), F.max("segment").alias("segment_end"))


def row_count(store: Store, topic: str) -> DataFrame:
    return spans(store, topic).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("rows"))


def chunk_times(store: Store, topic: str) -> DataFrame:
    """Offsets, bytes and time range of each chunk."""
    return store.chunk_frame(topic)


def compacted(store: Store, topic: str, max_rows: int, max_bytes: int) -> DataFrame:
    """``partition, segment, group``, offsets, rows and bytes of chunks merged to at least ``max_rows`` rows or ``max_bytes`` bytes, the last of a segment less.

    Groups are cut at whole multiples of the limits within a segment's running sums.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("partition", "segment").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    c = store.chunk_frame(topic).withColumn("rows", F.col("end") - F.col("start"))
    c = c.withColumn("r", F.coalesce(F.sum("rows").over(w), F.lit(0))).withColumn("b", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    c = c.withColumn("group", F.greatest(F.floor(F.col("r") / max_rows), F.floor(F.col("b") / max_bytes)))
    return c.groupBy("partition", "segment", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def rechunk(df: DataFrame, index: str, rows: int) -> DataFrame:
    """``df`` with ``chunk``: its number when rows are cut at every ``rows`` offsets."""
    return df.withColumn("chunk", F.floor(F.col(index) / rows))


def latency(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """The usual percentiles of a column of durations."""
    at = F.percentile_approx(column, [0.5, 0.9, 0.99], accuracy)
    return df.agg(at.alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))
