"""Batches on their way to a store: split to fit, gathered by key, queued within bounds."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..sources.formats import arrow_file
from ..types import CannotReshape, PayloadTooLarge, QueueFull


def reshape(table: pa.Table, max_bytes: int, prune: Callable[[pa.Table], pa.Table | None] | None = None) -> list[pa.Table]:
    """``table`` in parts of fewer bytes: cut evenly into size / limit + 1; a single row too large is pruned, or dropped if it cannot be."""
    size = table.nbytes
    if size <= max_bytes:
        return [table]
    if table.num_rows <= 1:
        less = prune(table) if prune else None
        return [less] if less is not None and less.nbytes <= max_bytes else []
    n = min(size // max_bytes + 1, table.num_rows)
    step = -(-table.num_rows // n)
    return [p for at in range(0, table.num_rows, step) for p in reshape(table.slice(at, step).combine_chunks(), max_bytes, prune)]


class Upload:
    """Sends tables in requests that the receiver accepts, learning its limit from refusals."""

    def __init__(self, send: Callable[[bytes], object], max_bytes: int = 10_240_000):
        self.send, self.max_bytes, self.max_rows = send, max_bytes, 2**31

    def _requests(self, table: pa.Table) -> Iterator[bytes]:
        at = 0
        while at < table.num_rows:
            n = min(self.max_rows, table.num_rows - at)
            while len(body := arrow_file(table.slice(at, n).combine_chunks())) > self.max_bytes:
                if n == 1:
                    raise CannotReshape(f"a single row exceeds {self.max_bytes} bytes")
                n = max(1, n // 2)
                self.max_rows = n
            try:
                yield body
            except PayloadTooLarge:
                continue
            at += n

    def upload(self, table: pa.Table) -> list:
        out, requests = [], self._requests(table)
        body = next(requests, None)
        while body is not None:
            try:
                out.append(self.send(body))
            except PayloadTooLarge as e:
                if e.limit >= self.max_bytes:
                    raise
                self.max_bytes = e.limit
                body = requests.throw(e)
                continue
            body = next(requests, None)
        return out


class Collator:
    """A bounded queue of (key, table), gathered by a worker into larger ones of one schema for each key."""

    def __init__(self, send: Callable[[str, pa.Table], object], max_bytes: int = 102_400, depth: int = 64):
        self.queue: queue.Queue = queue.Queue(depth)
        self.sender, self.max_bytes = send, max_bytes
        self.errors: list[Exception] = []
        self.thread = threading.Thread(target=self._work, daemon=True)
        self.thread.start()

    def send(self, key: str, table: pa.Table) -> None:
        try:
            self.queue.put_nowait((key, table))
        except queue.Full:
            raise QueueFull("the batch queue is full") from None

    def close(self) -> None:
        self.queue.put(None)
        self.thread.join()

    def _flush(self, key: str, held: list[pa.Table]) -> None:
        for part in reshape(pa.concat_tables(held).combine_chunks(), self.max_bytes):
            try:
                self.sender(key, part)
            except Exception as e:
                self.errors.append(e)

    def _work(self) -> None:
        held: dict[str, list[pa.Table]] = {}
        while True:
            item = self.queue.get()
            if item is not None:
                key, table = item
                own = held.setdefault(key, [])
                if own and own[0].schema != table.schema:
                    self._flush(key, held.pop(key))
                    own = held.setdefault(key, [])
                own.append(table)
                if sum(t.nbytes for t in own) >= self.max_bytes:
                    self._flush(key, held.pop(key))
            if item is None or self.queue.empty():
                for key in list(held):
                    self._flush(key, held.pop(key))
            if item is None:
                return
