"""Whether the manifest and the files say the same."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

_LOCATOR = re.compile(r"(?P<topic>.+)-(?P<partition>[^-]+)-(?P<segment>[0-9]+)\Z")
LOCATOR = r"^(.+)-([^-]+)-([0-9]+)$"


def parse_locator(name: str) -> tuple[str, str, int] | None:
    """Topic, partition and segment number in ``topic-partition-number``; the last dashes split."""
    m = _LOCATOR.match(name)
    return (m["topic"], m["partition"], int(m["segment"])) if m else None


def compare(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``expected(topic, partition, segment, size, sealed)`` against ``files(topic, partition, segment, bytes)``, a row for each of either with its ``state``.

    Sealed segments are ``ok``, ``missing`` or ``mismatch``; the last, open one of a partition may be ahead (``active``), behind is an alert
    (``active_behind``). Files that the manifest lacks are ``in_flight`` above the partition's largest number or for an unknown partition, else ``untracked``.
    """
    key = ["topic", "partition", "segment"]
    high = expected.groupBy("topic", "partition").agg(F.max("segment").alias("_high"))
    both = expected.select(*key, "size", "sealed").join(files.select(*key, "bytes"), key, "full_outer").join(high, ["topic", "partition"], "left")
    state = (
        F.when(F.col("size").isNull(), F.when(F.col("_high").isNull() | (F.col("segment") > F.col("_high")), "in_flight").otherwise("untracked"))
        .when(~F.col("sealed"), F.when(F.coalesce("bytes", F.lit(0)) < F.col("size"), "active_behind").otherwise("active"))
        .when(F.col("bytes").isNull(), "missing")
        .when(F.col("bytes") != F.col("size"), "mismatch")
        .otherwise("ok")
    )
    return both.select(*key, F.col("size").alias("expected"), F.col("bytes").alias("actual"), (F.coalesce("bytes", F.lit(0)) - F.coalesce("size", F.lit(0))).alias("delta"), state.alias("state"))


def untracked(names: DataFrame, expected: DataFrame) -> DataFrame:
    """``name, state`` of files that the manifest lacks: ``in_flight``, ``untracked``, or ``unparsed`` for names that are no locators."""
    parsed = names.select("name", F.regexp_extract("name", LOCATOR, 1).alias("topic"), F.regexp_extract("name", LOCATOR, 2).alias("partition"), F.expr(f"try_cast(regexp_extract(name, r'{LOCATOR}', 3) as bigint)").alias("segment"))
    missing = parsed.join(expected.select("topic", "partition", "segment"), ["topic", "partition", "segment"], "left_anti")
    high = expected.groupBy("topic", "partition").agg(F.max("segment").alias("_high"))
    state = F.when(F.col("segment").isNull(), "unparsed").when(F.col("_high").isNull() | (F.col("segment") > F.col("_high")), "in_flight").otherwise("untracked")
    return missing.join(high, ["topic", "partition"], "left").select("name", state.alias("state"))


@dataclass
class Report:
    expected_bytes: int = 0
    actual_bytes: int = 0
    missing: list[tuple] = field(default_factory=list)
    mismatched: list[tuple] = field(default_factory=list)
    untracked: list[str] = field(default_factory=list)
    #: Open segments, which may be ahead of the manifest: topic, partition, bytes expected, found, difference.
    active: list[tuple] = field(default_factory=list)
    checked: int = 0
    in_flight: int = 0
    fixed: int = 0
    fixing: bool = False
    reason: str | None = None
    at: float = 0.0


class Reconciler:
    """Passes over a store, one that fixes at a time: a second one meanwhile only reports."""

    def __init__(self, store: Store):
        self.store, self._fixing, self.last = store, threading.Lock(), None
        self.errors = 0

    def run(self, fix: bool = False) -> Report:
        out = Report(at=time.time())
        out.fixing = fix and self._fixing.acquire(blocking=False)
        if fix and not out.fixing:
            out.reason = "another pass is fixing"
        try:
            self._pass(out)
        finally:
            if out.fixing:
                self._fixing.release()
        self.last = out
        return out

    def _pass(self, out: Report) -> None:
        store = self.store
        store.manifest.refresh()
        segments = store.manifest.all()
        for s in segments:
            out.checked += len(s.paths)
            sizes = [store.files.size(p) for p in s.paths]
            found = sum(n for n in sizes if n >= 0)
            out.expected_bytes += s.file_bytes
            out.actual_bytes += found
            where = (s.topic, s.partition, s.segment)
            if not s.sealed:
                out.active.append((s.topic, s.partition, s.file_bytes, found, found - s.file_bytes))
            if any(n < 0 for n in sizes):
                out.missing.append(where)
            elif found != s.file_bytes:
                out.mismatched.append((*where, s.file_bytes, found))
                if out.fixing and update_size(store, where, s.file_bytes, found):
                    out.fixed += 1
        used = {p.split("/")[1] for s in segments for p in s.paths}
        for name in store.files.names("data"):
            if name not in used:
                if name in store.manifest.txns:
                    out.untracked.append(name)
                else:
                    out.in_flight += 1

    def run_forever(self, interval_s: float, fix: bool, stop: threading.Event, publish: Callable[[Report], None] = lambda r: None) -> None:
        """Passes until ``stop``; an error ends a pass, not the loop."""
        while not stop.is_set():
            try:
                publish(self.run(fix))
            except Exception:
                self.errors += 1
            stop.wait(interval_s)


def update_size(store: Store, where: tuple[str, str, int], old: int, new: int) -> bool:
    """Set a segment's file bytes if they still are ``old``; a segment removed meanwhile stays removed."""
    while True:
        s = store.manifest.segments.get(where[:2], {}).get(where[2])
        if s is None or s.file_bytes != old:
            return False
        if store.manifest.commit(add=[replace(s, file_bytes=new)]):
            return True
