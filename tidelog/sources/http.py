"""A thin HTTP front over a store, on the standard library's server."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from ..operators import info, reconcile, retention
from ..operators.upkeep import Upkeep
from ..types import EventLogError, Focus, InvalidQuery, NoHeartbeat, PayloadTooLarge, TimeRange
from . import formats
from .store import Store

#: Checkpoint intervals without a heartbeat after which the server is unwell.
SILENT_INTERVALS = 10


class Api:
    """Routes and their parameters, without a socket: ``call`` answers a request."""

    def __init__(self, store: Store):
        self.store, self.heartbeat = store, time.monotonic()
        self.reconciler = reconcile.Reconciler(store)

    def beat(self) -> None:
        self.heartbeat = time.monotonic()

    def call(self, method: str, target: str, body: bytes = b"", headers: dict[str, str] | None = None) -> tuple[int, bytes, dict[str, str]]:
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        url = urlsplit(target)
        path, query = [unquote(p) for p in url.path.split("/") if p], {k: v for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        try:
            return self._route(method, path, query, body, headers)
        except PayloadTooLarge as e:
            return e.status, str(e).encode(), {"x-max-request-size": str(e.limit), "content-type": "text/plain"}
        except EventLogError as e:
            return e.status, json.dumps(e.reply()).encode(), {"content-type": formats.JSON}
        except Exception as e:
            return 500, json.dumps({"message": f"{type(e).__name__}: {e}", "code": 500}).encode(), {"content-type": formats.JSON}

    def _route(self, method: str, path: list[str], query: dict, body: bytes, headers: dict) -> tuple[int, bytes, dict[str, str]]:
        as_json = lambda x: (200, json.dumps(x).encode(), {"content-type": formats.JSON})
        match method, path:
            case "GET", ["ok"]:
                if time.monotonic() - self.heartbeat > SILENT_INTERVALS * self.store.config.checkpoint_interval_s:
                    raise NoHeartbeat("no checkpoint of late")
                return as_json({"status": "ok"})
            case "GET", ["topics"]:
                return as_json({"topics": [{"name": t} for t in self.store.topics()]})
            case "GET", ["info"]:
                retention.retain_partitions(self.store)
                retention.retain_store(self.store)
                return as_json(self._info())
            case "GET", ["metrics"]:
                return 200, self.store.metrics.text().encode(), {"content-type": "text/plain; version=0.0.4"}
            case "GET", ["topic", topic]:
                spans = {p: {"start": s.start, "end": s.end} for p, s in self.store.partitions(topic).items()}
                return as_json({"partitions": spans, "bytes": info.size(self.store, topic)})
            case "POST", ["topic", topic, "partition", partition]:
                table = formats.read_body(body, headers.get("content-type"), self.store.config.max_append_bytes)
                span = self.store.append(topic, partition, table)
                return as_json({"span": {"start": span.start, "end": span.end}})
            case "POST", ["topic", topic, "records"]:
                page = self.store.iterate(topic, self._cursor(body), self._int(query, "page_size"), self._one(query, "order"), query.get("partition_filter") or query.get("partition_filter[]"), self._time(query), self._focus(query))
            case "GET", ["topic", topic, "partition", partition, "records"]:
                start = self._int(query, "start")
                if start is None:
                    raise InvalidQuery("start is missing")
                page = self.store.records(topic, partition, start, self._int(query, "page_size"), self._time(query), self._focus(query))
            case _:
                return 404, b"", {}
        data, kind, more = formats.reply(page, headers.get("accept"))
        return 200, data, {"content-type": kind} | more

    def _info(self) -> dict:
        """Figures of all partitions, and what the latest reconciliation found, without waiting for one."""
        topics: dict[str, list] = {t: [] for t in self.store.topics()}
        for r in info.info(self.store).orderBy("topic", "partition").collect():
            topics[r["topic"]].append({
                "name": r["partition"], "oldest_time": r["oldest"], "newest_time": r["newest"], "total_byte_size": r["bytes"],
                "records": {"start": r["record_start"], "end": r["record_end"]}, "segments": {"start": r["segment_start"], "end": r["segment_end"]}})
        last = self.reconciler.last or reconcile.Report()
        stats = {
            "files_checked": last.checked, "untracked_files": len(last.untracked), "size_mismatches": len(last.mismatched), "missing_files": len(last.missing),
            "expected_size": last.expected_bytes, "actual_size": last.actual_bytes, "active_tail_skipped": len(last.active)}
        active = [dict(zip(("topic", "partition", "manifest_size", "disk_size", "delta"), a)) for a in last.active]
        return {
            "topics": [{"name": t, "partitions": p} for t, p in topics.items()], "retention_stats": stats, "active_segments": active,
            "last_reconcile_pass_completed_at": last.at or None, "pending": self.reconciler.last is None}

    @staticmethod
    def _cursor(body: bytes) -> dict[str, int]:
        try:
            cursor = json.loads(body) if body else {}
        except ValueError:
            raise InvalidQuery("the cursor is no JSON") from None
        if not isinstance(cursor, dict) or any(type(n) is not int or n < 0 for n in cursor.values()):
            raise InvalidQuery("a cursor maps partitions to offsets")
        return cursor

    @staticmethod
    def _one(query: dict, name: str) -> str | None:
        return query[name][-1] if name in query else None

    def _int(self, query: dict, name: str) -> int | None:
        text = self._one(query, name)
        try:
            return None if text is None else int(text)
        except ValueError:
            raise InvalidQuery(f"{name} is no number: {text!r}") from None

    def _time(self, query: dict) -> TimeRange | None:
        start = self._one(query, "time.start")
        return None if start is None else TimeRange.parse(start, self._one(query, "time.end"))

    def _focus(self, query: dict) -> Focus:
        many = lambda n: tuple(query.get(n, query.get(f"{n}[]", ())))
        return Focus(many("dataset"), many("dataset.exclude"), self._one(query, "dataset.separator"), self._int(query, "dataset.max_bytes"))


class Server(ThreadingHTTPServer):
    """With threads that keep the store up and reconcile it, from the start of ``serve_forever`` to ``server_close``."""

    api: Api

    def serve_forever(self, poll_interval: float = 0.5) -> None:
        self.stop = threading.Event()
        config, put = self.api.store.config, self.api.store.metrics.set
        loops = [
            (Upkeep(self.api.store, self.api.beat).run_forever, (self.stop,)),
            (self.api.reconciler.run_forever, (config.reconcile_interval_s, config.reconcile_fix, self.stop, lambda r: put("reconcile_last_pass", r.at)))]
        for run, args in loops:
            threading.Thread(target=run, args=args, daemon=True).start()
        super().serve_forever(poll_interval)

    def server_close(self) -> None:
        if hasattr(self, "stop"):
            self.stop.set()
        super().server_close()


def serve(store: Store, bind: str | None = None) -> Server:
    """A server on ``bind`` (host:port); call ``serve_forever`` on it."""
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            length = self.headers.get("content-length") or "0"
            if not length.isdecimal():
                self.send_error(400)
                return
            body = self.rfile.read(int(length))
            status, data, headers = api.call(self.command, self.path, body, dict(self.headers))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    host, port = (bind or store.config.bind).rsplit(":", 1)
    server = Server((host, int(port)), Handler)
    server.api = api
    return server
