"""Copies of partitions from one store to another, resumed at the copy's end."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from ..sources.store import Store
from ..types import INDEX, PARTITION, RowLimit, Span

# What a server writes into a reply's metadata, which is no part of the data.
REPLY_KEYS = ("status", "span")


class Replication:
    def __init__(self, source: Store, target: Store, topic: str, to: str | None = None, page_rows: int = 100_000, parallel: int | None = None):
        self.source, self.target, self.topic, self.to = source, target, topic, to or topic
        self.limit = RowLimit(page_rows, 2**62)
        self.parallel = parallel or target.config.replication_parallel

    def sync(self) -> dict[str, int]:
        """Offset to go on from of each partition of the source: the copy's end, or the beginning."""
        self.source.manifest.refresh()
        self.target.manifest.refresh()
        return {p: max(self.target.manifest.ends.get((self.to, p), 0), 0) for p in self.source.manifest.partitions(self.topic)}

    def page(self, partition: str, start: int) -> Span | None:
        """Copy the rows of one page; None where there are none. Under one transaction name, so a copy that is made again adds nothing."""
        page = self.source.records(self.topic, partition, start, limit=self.limit, keep=True)
        if not page.rows:
            return None
        meta = {k: v for k, v in page.metadata.items() if k not in REPLY_KEYS}
        txn = f"copy-{self.topic}-{self.to}-{partition}-{start}-{page.rows}".replace("/", "_")
        rows = page.df.drop(PARTITION).coalesce(1).sortWithinPartitions(INDEX).drop(INDEX)  # a page is bounded
        return self.target.append(self.to, partition, rows, metadata=meta, txn=txn)

    def pump(self) -> int:
        """Copy until the copy has caught up; returns rows copied."""
        done, lock = 0, threading.Lock()

        def job(partition: str, start: int) -> None:
            nonlocal done
            while (span := self.page(partition, start)) is not None and len(span):
                start = span.end
                with lock:
                    done += len(span)

        with ThreadPoolExecutor(self.parallel) as pool:
            for f in [pool.submit(job, p, start) for p, start in self.sync().items()]:
                f.result()
        return done

    def run_forever(self, period_s: float, stop: threading.Event, longest_s: float = 60.0) -> None:
        """Pump every ``period_s``, waiting twice as long after each failure in a row."""
        wait = period_s
        while not stop.is_set():
            try:
                self.pump()
                wait = period_s
            except Exception:
                wait = min(longest_s, 2 * wait)
            stop.wait(wait)
