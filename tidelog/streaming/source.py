"""A stream of a topic's rows as they are appended: file streams over the committed folders cannot see a commit, so batches follow cursors.

``tail`` polls the manifest; ``micro_batches`` hands each new stretch of rows to a function with a number and a stored cursor, so that a restart goes on where it ended.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

from ..sources.store import Store
from ..types import Cursor, EmptyStream, Order, Page, Status


def tail(store: Store, topic: str, cursor: Cursor | None = None, page_size: int | None = None, partition_filter: list[str] | None = None) -> Iterator[Page]:
    """Pages from ``cursor`` on until nothing is left; go on later from the last page's ``next``. New partitions join in."""
    cursor = dict(cursor or {})
    while True:
        page = store.iterate(topic, cursor, page_size, Order.ASC, partition_filter, keep=True)
        if not page.rows:
            return
        yield page
        cursor = page.next


class MicroBatches:
    """Runs ``handle(df, number)`` over what is new, at least once for each number, from a cursor kept in the store."""

    def __init__(self, store: Store, topic: str, name: str, handle: Callable):
        self.store, self.topic, self.folder, self.handle = store, topic, f"_cursors/{name}", handle

    def _state(self) -> tuple[int, Cursor]:
        done = self.store.files.names(self.folder)
        if not done:
            return 0, {}
        return int(done[-1][:20]) + 1, json.loads(self.store.files.read(f"{self.folder}/{done[-1]}"))

    def available(self) -> int:
        """Handle all there is; returns batches handled."""
        n = 0
        while True:
            number, cursor = self._state()
            try:
                page = self.store.iterate_all(self.topic, cursor, keep=True, ordered=False)
            except EmptyStream:
                return n
            self.handle(page.df, number)
            self.store.files.create(f"{self.folder}/{number:020d}.json", json.dumps(page.next))
            n += 1
            if page.status is Status.ALL:
                return n

    def run_forever(self, interval_s: float, stop: threading.Event) -> None:
        while not stop.is_set():
            self.available()
            stop.wait(interval_s)
