"""Headline timings as one JSON line: appends, pages, scans and statistics of the event log over $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tidelog.config import Config
from tidelog.operators import info, retention
from tidelog.queries import DAY, SEGMENT, _fill_events, _fill_orders
from tidelog.sources.store import Store
from tidelog.types import Focus, RowLimit


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, f, again: int = 1):
        best, out = None, None
        for _ in range(again):
            t = time.perf_counter()
            out = f()
            best = min(best or 1e9, time.perf_counter() - t)
        seconds[name] = round(best, 4)
        return out

    with tempfile.TemporaryDirectory(prefix="bench-") as root:
        store = Store(spark, root, Config(monitor=False))
        spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start is not timed
        timed("append_events", lambda: _fill_events(store, spark, sf_dir))
        timed("append_orders", lambda: _fill_orders(store, spark, sf_dir))
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
        drain = lambda df: df.write.format("noop").mode("overwrite").save()
        first = store.iterate("events", page_size=10_000)
        timed("page_1000_first", lambda: store.iterate("events", page_size=1000).df.toArrow(), 3)
        timed("page_10000_first", lambda: store.iterate("events", page_size=10_000).df.toArrow(), 3)
        timed("page_1000_middle", lambda: store.iterate("events", first.next, page_size=1000).df.toArrow(), 3)
        timed("page_1000_reverse", lambda: store.iterate("events", page_size=1000, order="desc").df.toArrow(), 3)
        timed("page_bytes", lambda: store.iterate("events", limit=RowLimit(10**9, 200_000)).df.toArrow(), 3)
        timed("page_day", lambda: store.iterate("events", page_size=10_000, time=DAY).df.toArrow(), 3)
        timed("page_focus", lambda: store.iterate("orders", page_size=10_000, focus=Focus(("*",), separator=".")).df.toArrow(), 3)
        timed("drain_events", lambda: drain(store.iterate_all("events").df), 3)
        timed("drain_orders_flat", lambda: drain(store.iterate_all("orders", focus=Focus(("*",), separator=".")).df), 3)
        timed("info", lambda: info.info(store).collect(), 3)
        timed("retain_plan", lambda: retention.expired(store.manifest.frame(), 10**6, 10**4).collect(), 3)
    out = {
        "metric": "event log headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "append_rows_per_s": round(rows / seconds["append_events"]), "drain_rows_per_s": round(rows / seconds["drain_events"]), "segment_rows": SEGMENT,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    sys.exit(main())
