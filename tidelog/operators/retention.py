"""What a store drops when it is over its limits: always the segments with the lowest numbers of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.manifest import Segment
from ..sources.store import Store


def expired(segments: DataFrame, max_bytes: int, max_segment_count: int) -> DataFrame:
    """Rows of ``segments(topic, partition, segment, size)`` beyond a partition's limits: all but the newest that fit in both.

    A partition counts its segments by their numbers, last minus first and one, gaps included.
    """
    w = Window.partitionBy("topic", "partition").orderBy(F.col("segment").desc())
    s = segments.withColumn("_bytes", F.sum("size").over(w)).withColumn("_count", F.max("segment").over(Window.partitionBy("topic", "partition")) - F.col("segment") + 1)
    return s.where((F.col("_bytes") > max_bytes) | (F.col("_count") > max_segment_count)).drop("_bytes", "_count")


def _drop(store: Store, gone: list[Segment]) -> None:
    """First from the manifest, then the files: a crash in between leaves orphans for ``repair``, never dangling rows."""
    while gone and not store.manifest.commit(remove=gone):
        gone[:] = [s for s in gone if s.segment in store.manifest.segments.get((s.topic, s.partition), {})]
    store.free(gone)
    for s in gone:
        store.metrics.add("partition_segments_destroyed", 1, topic=s.topic, partition=s.partition)


def retain_partitions(store: Store) -> list[Segment]:
    """Drop what is beyond every partition's own limits."""
    store.manifest.refresh()
    limit = store.config.retain
    rows = expired(store.manifest.frame(), limit.max_bytes, limit.max_segment_count).collect()  # only what is to be dropped
    gone = [store.manifest.segments[r["topic"], r["partition"]][r["segment"]] for r in rows]
    _drop(store, gone)
    return gone


def retain_store(store: Store, limit_bytes: int | None = None, headroom: int | None = None) -> list[Segment]:
    """While the whole store is over its limit less headroom, drop the lowest segment of the partition that has the oldest first time."""
    store.manifest.refresh()
    if limit_bytes is None:
        limit_bytes = store.config.retention_bytes if store.config.retention_bytes is not None else store.files.capacity()
    limit = limit_bytes - (store.config.headroom_bytes if headroom is None else headroom)
    left: dict[tuple[str, str], list[Segment]] = {}
    for s in store.manifest.all():
        left.setdefault((s.topic, s.partition), []).append(s)
    total = sum(s.size for v in left.values() for s in v) + store.manifest.bytes()
    gone: list[Segment] = []
    while total > limit and left:
        _, key = min((min(s.time_start for s in v), k) for k, v in left.items())
        victim = left[key].pop(0)
        if not left[key]:
            del left[key]
        total -= victim.size
        gone.append(victim)
    _drop(store, gone)
    return gone
