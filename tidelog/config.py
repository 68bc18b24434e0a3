"""Settings with their defaults, from files and the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib
from dataclasses import dataclass, field

from .types import RowLimit

MIB = 1 << 20


def _yaml(f) -> dict:
    import yaml

    return yaml.safe_load(f) or {}


@dataclass
class Roll:
    """When a new segment begins before an append."""

    max_rows: int = 100_000
    max_bytes: int = 100 * MIB
    max_duration_ms: int | None = None


@dataclass
class Retain:
    """What a partition keeps."""

    max_bytes: int = 1024 * MIB
    max_segment_count: int = 10_000


@dataclass
class Config:
    data_path: str = "./data"
    bind: str = "0.0.0.0:3030"
    max_append_bytes: int = 10_240_000
    max_page: RowLimit = field(default_factory=RowLimit)
    checkpoint_interval_s: float = 1.0
    headroom_bytes: int = 500 * MIB
    #: Bytes the whole store may take; None: all of its file system.
    retention_bytes: int | None = 99 * 1024 * MIB
    roll: Roll = field(default_factory=Roll)
    retain: Retain = field(default_factory=Retain)
    chunk_rows: int = 1000
    chunk_bytes: int = MIB
    write_queue: int = 1
    write_timeout_s: float = 0.1
    monitor_min_free: int = 1_000_000_000
    monitor: bool = True
    reconcile_fix: bool = True
    reconcile_interval_s: float = 300.0
    replication_parallel: int = 8

    @classmethod
    def load(cls, *paths: str, env: dict[str, str] | None = None, prefix: str = "TIDELOG") -> Config:
        """Defaults, then TOML, JSON or (where a parser is installed) YAML files in order, then variables such as ``TIDELOG__ROLL__MAX_ROWS``."""
        out = cls()
        for p in paths:
            with open(p, "rb") as f:
                out._merge(_yaml(f) if p.endswith((".yaml", ".yml")) else json.load(f) if p.endswith(".json") else tomllib.load(f))
        for name, value in sorted((os.environ if env is None else env).items()):
            at = name.lower().split("__")
            if at[0] == prefix.lower() and len(at) > 1:
                try:
                    value = json.loads(value)
                except ValueError:
                    pass
                tree: dict = {at[-1]: value}
                for k in at[-2:0:-1]:
                    tree = {k: tree}
                out._merge(tree)
        return out

    def _merge(self, values: dict) -> None:
        for k, v in values.items():
            if not hasattr(self, k):
                raise ValueError(f"no such setting: {k}")
            own = getattr(self, k)
            if dataclasses.is_dataclass(own) and isinstance(v, dict):
                setattr(self, k, dataclasses.replace(own, **v))
            else:
                setattr(self, k, v)
