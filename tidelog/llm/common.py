"""Shared parts of the training-data operators: table access, lineage cuts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; set one only where none is."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidelog-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and go on from there.

    Every executor can read those files, so a lost executor costs no recomputation of what came before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sheltered(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` under names that no operator gives its own, and those names by the old ones."""
    kept = {c: f"__kept{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.toDF(*[kept.get(c, c) for c in docs.columns]), kept


def unsheltered(out: DataFrame, kept: dict[str, str]) -> DataFrame:
    """``out`` with the columns of ``kept`` under their old names again."""
    back = {v: k for k, v in kept.items()}
    return out.toDF(*[back.get(c, c) for c in out.columns])


def trim() -> None:
    """Give memory that this process no longer uses back to the system: an executor's workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Have the cleaner delete, now, shuffle files of plans that nothing refers to any more.

    It only learns of them when the driver's heap is collected, which can be long after many rounds have left theirs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """Number of partitions for explicit repartitioning, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of the undirected graph ``edges(a long, b long)``.

    Returns ``(node, comp)`` for every node of an edge, ``comp`` being the least node reachable.
    Alternates large-star and small-star steps: each is a map-side combined minimum by node and a
    shuffle join, so neither a node with very many neighbours nor the graph has to fit in one task.
    Self loops give a component of one node. Null ends are dropped.
    """
    e = cut(
        edges.where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a > b")
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a > b")
        )
        e = cut(small.unionByName(e.where("a = b")).distinct())
        after = _state(e)
        del both, low, large, small
        release(edges.sparkSession)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return (
        e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")))
        .distinct()
    )


def star(n: int, pairs) -> list[int]:
    """Union-find over ``pairs`` of positions below ``n``: the least position of each one's set."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
