"""Counters and gauges of a store, in the text form that monitoring systems scrape."""

from __future__ import annotations

import threading

#: The names that are counters; all others are gauges.
COUNTERS = ("partition_schema_change", "partition_segments_destroyed", "slog_roll", "slog_thread_records_written")


class Metrics:
    def __init__(self):
        self._values: dict[str, dict[tuple, float]] = {}
        self._lock = threading.Lock()

    def add(self, name: str, n: float, **labels: str) -> None:
        with self._lock:
            own = self._values.setdefault(name, {})
            key = tuple(sorted(labels.items()))
            own[key] = own.get(key, 0) + n

    def set(self, name: str, rows: dict[tuple, float] | float) -> None:
        """A gauge's values, by labels as sorted pairs; those it had before are gone."""
        with self._lock:
            self._values[name] = dict(rows) if isinstance(rows, dict) else {(): rows}

    def get(self, name: str, **labels: str) -> float | None:
        with self._lock:
            return self._values.get(name, {}).get(tuple(sorted(labels.items())))

    def text(self) -> str:
        out = []
        with self._lock:
            for name, own in sorted(self._values.items()):
                out.append(f"# TYPE {name} {'counter' if name in COUNTERS else 'gauge'}")
                for labels, value in sorted(own.items()):
                    inner = ",".join(f'{k}="{_escaped(v)}"' for k, v in labels)
                    out.append(f"{name}{{{inner}}} {value}" if inner else f"{name} {value}")
        return "\n".join(out) + "\n"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
