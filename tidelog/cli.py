"""Command line: ``python -m tidelog.cli --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import focus as focusing
from .operators import info
from .sources.formats import arrow_file, json_records
from .sources.store import Store
from .types import Focus, TimeRange


def write(df: DataFrame, to: str) -> None:
    """``text``, ``json`` or ``arrow``, to standard output or, as ``format=path``, to a file."""
    kind, _, path = to.partition("=")
    if kind == "arrow":
        data = arrow_file(df.toArrow())
    elif kind == "json":
        data = "".join(r["record"] + "\n" for r in json_records(df).toLocalIterator()).encode()
    elif kind == "text":
        data = (df.toPandas().to_string() + "\n").encode()
    else:
        raise SystemExit(f"unknown output: {kind}")
    if path:
        with open(path, "wb") as f:
            f.write(data)
    else:
        sys.stdout.buffer.write(data)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidelog")
    out.add_argument("--root", default=None)
    out.add_argument("--config", action="append", default=[])
    out.add_argument("--output", default="text")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("topics")
    sub.add_parser("info")
    sub.add_parser("serve")
    p = sub.add_parser("partitions")
    p.add_argument("topic")
    for name in ("records", "iterate", "iterate-unnested", "iterate-unlimited"):
        p = sub.add_parser(name)
        p.add_argument("topic")
        if name == "records":
            p.add_argument("partition")
            p.add_argument("--start", type=int, default=0)
        else:
            p.add_argument("--cursor", type=json.loads, default={})
            p.add_argument("--order", default="asc")
            p.add_argument("--partition-filter", action="append", default=None)
        p.add_argument("--page-size", type=int)
        p.add_argument("--from", dest="since")
        p.add_argument("--to", dest="until")
        p.add_argument("--dataset", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--separator")
        p.add_argument("--max-bytes", type=int)
    p = sub.add_parser("append")
    p.add_argument("topic")
    p.add_argument("partition")
    p.add_argument("file", help="an Arrow file")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = Config.load(*a.config)
    spark = spark or SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.root or config.data_path, config)
    if a.command == "topics":
        print("\n".join(store.topics()))
        return 0
    if a.command == "partitions":
        print(json.dumps({p: [s.start, s.end] for p, s in store.partitions(a.topic).items()}))
        return 0
    if a.command == "info":
        write(info.info(store), a.output)
        return 0
    if a.command == "serve":
        from .sources.http import serve

        serve(store).serve_forever()
    if a.command == "append":
        with pa.memory_map(a.file) as f:
            span = store.append(a.topic, a.partition, pa.ipc.open_file(f).read_all())
        print(json.dumps([span.start, span.end]))
        return 0
    focus = Focus(tuple(a.dataset), tuple(a.exclude), a.separator, a.max_bytes)
    time = TimeRange.parse(a.since, a.until) if a.since else None
    if a.command == "records":
        page = store.records(a.topic, a.partition, a.start, a.page_size, time, focus)
    elif a.command == "iterate-unlimited":
        page = store.iterate_all(a.topic, a.cursor, a.partition_filter, time, focus)
    else:
        page = store.iterate(a.topic, a.cursor, a.page_size, a.order, a.partition_filter, time, focus)
    df = focusing.unnest(page.df, "in", "out", "metadata") if a.command == "iterate-unnested" else page.df
    write(df, a.output)
    print(json.dumps(page.header()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
