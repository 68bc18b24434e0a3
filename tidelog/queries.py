"""Named queries over the test tables through the event log, and DuckDB SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import sizes
from .operators import focus as focusing
from .operators import info, reconcile, replicate, retention
from .sources import formats
from .sources.store import Store
from .types import INDEX, PARTITION, Cursor, Focus, Page, RowLimit, TimeRange

#: Rows of a segment and of a chunk in the stores below.
SEGMENT, CHUNK = 1000, 250
#: A day of ``events``, in milliseconds.
DAY = TimeRange(1_704_153_600_000, 1_704_239_999_999)

_stores: dict[tuple, Store] = {}


def _root(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidelog-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _fill_events(store: Store, spark: SparkSession, sf_dir: str) -> None:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(_millis("ts").alias("time"), "event_id", "user_id", "value", "props", "event_type")
    store.ingest("events", e, "event_type", ["event_id"], SEGMENT, drop_key=True)


def _fill_orders(store: Store, spark: SparkSession, sf_dir: str) -> None:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    meta = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    order = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("totalprice"), meta.alias("meta"))
    o = o.select(_millis("o_orderdate").alias("time"), "o_orderkey", order.alias("order"), "o_orderpriority")
    store.ingest("orders", o, "o_orderpriority", ["o_orderkey"], SEGMENT, drop_key=True)


def _fill_documents(store: Store, spark: SparkSession, sf_dir: str) -> None:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("time"), "text", "n_chars", "lang")
    store.ingest("documents", d, "lang", ["time"], SEGMENT, drop_key=True)


def _fill_embeddings(store: Store, spark: SparkSession, sf_dir: str) -> None:
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("time"), "embedding", "label")
    store.ingest("embeddings", d, "label", ["time"], SEGMENT, drop_key=True)


def _fill_conversations(store: Store, spark: SparkSession, sf_dir: str) -> None:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("time"), F.col("text").alias("message"), "role")
    store.ingest("conversations", c, "role", ["time", "message"], SEGMENT, drop_key=True)


#: Schemas of the appends of 5 rows each, by partition.
MIXED = {"p1": "aaabb", "p2": "ababb", "p3": "aaaab"}


def _fill_mixed(store: Store, spark: SparkSession, sf_dir: str) -> None:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    for name, kinds in MIXED.items():
        for k, kind in enumerate(kinds):
            own = n.where(F.col("n_nationkey").between(5 * k, 5 * k + 4)).select(F.col("n_nationkey").cast("long").alias("time"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
            store.append("mixed", name, own.drop("n_regionkey" if kind == "a" else "n_name"), order_by=["time"])


FILL = {"events": _fill_events, "orders": _fill_orders, "documents": _fill_documents, "embeddings": _fill_embeddings, "conversations": _fill_conversations, "mixed": _fill_mixed}


def store(spark: SparkSession, sf_dir: str, topic: str) -> Store:
    """The store that holds ``topic`` as made from the tables in ``sf_dir``, once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, topic)
    if key not in _stores:
        own = Store(spark, _root(spark), Config(chunk_rows=CHUNK, monitor=False))
        FILL[topic](own, spark, sf_dir)
        _stores[key] = own
    return _stores[key]


def _millis(name: str):
    """Whole milliseconds, rounded down, of a timestamp without zone read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) div 1000 - if(pmod(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}), 1000) <> 0 and {name} < timestamp_ntz'1970-01-01 00:00:00', 1, 0)")


def _rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col(PARTITION).alias("part"), F.col(INDEX).alias("idx"), *columns)


def _cursor(spark: SparkSession, c: Cursor) -> DataFrame:
    return spark.createDataFrame(sorted(c.items()), "part string, next long")


def _events(f: Callable[[Store], Page], *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(f(store(spark, sf_dir, "events")).df, *(columns or ("event_id",)))

    return query


def _events_cursor(f: Callable[[Store], Page]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cursor(spark, f(store(spark, sf_dir, "events")).next)

    return query


def _status(*pages: Callable[[Store], Page], topic: str = "events"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = store(spark, sf_dir, topic)
        got = [p(s) for p in pages]
        return spark.createDataFrame([(k, p.status.value, p.rows) for k, p in enumerate(got)], "page long, status string, n_rows long")

    return query


def _first(s: Store, n: int = 300, **more) -> Page:
    return s.iterate("events", page_size=n, keep=True, **more)


def _second(s: Store, n: int = 300, **more) -> Page:
    return s.iterate("events", _first(s, n, **more).next, page_size=n, keep=True, **more)


def _filtered(*selectors: str):
    return _events(lambda s: s.iterate_all("events", partition_filter=list(selectors), keep=True, ordered=False))


R = """WITH r AS (
  SELECT event_type AS part, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
         epoch_us(ts) // 1000 AS time, event_id, user_id, value, props FROM events
), c AS (SELECT part, count(*) AS n FROM r GROUP BY part)
"""
O = """WITH r AS (
  SELECT o_orderpriority AS part, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS idx,
         epoch_us(o_orderdate) // 1000 AS time, o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
)
"""
#: Positions after a first page of 300 rows, ascending and descending.
POS = "p AS (SELECT part, CAST(greatest(least(300 - (sum(n) OVER (ORDER BY part) - n), n), 0) AS BIGINT) AS pos FROM c)"
#: Descending, the longest partition comes first, and of equals the last by name.
NEG = "p AS (SELECT part, CAST(n - greatest(least(300 - (sum(n) OVER (ORDER BY n DESC, part DESC) - n), n), 0) AS BIGINT) AS pos FROM c)"


def _with(extra: str) -> str:
    return f"{R}, {extra}\n"


def focus_orders(focus: Focus):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return store(spark, sf_dir, "orders").iterate_all("orders", focus=focus).df

    return query


def _frame(f: Callable[[Store], DataFrame], topic: str = "events"):
    return lambda spark, sf_dir: f(store(spark, sf_dir, topic))


def partition_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = info.spans(store(spark, sf_dir, "events"), "events")
    return s.select(F.col("partition").alias("part"), F.col("start").alias("first"), F.col("end").alias("past"))


def segment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.segments(store(spark, sf_dir, "events"), "events").select(F.col("partition").alias("part"), "segment", "record_start", "record_end", "time_start", "time_end", "size")


def topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.info(store(spark, sf_dir, "orders")).select(F.col("partition").alias("part"), "oldest", "newest", "min_time", "max_time", "record_end", "segment_end")


def retained(max_bytes: int, max_count: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = info.segments(store(spark, sf_dir, "events"), "events")
        return s.join(retention.expired(s, max_bytes, max_count), ["topic", "partition", "segment"], "left_anti").select(F.col("partition").alias("part"), "segment")

    return query


def retain_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that are left of a copy of the store cut down to about half."""
    own = Store(spark, _root(spark), Config(chunk_rows=CHUNK, monitor=False))
    _fill_events(own, spark, sf_dir)
    rows = sum(s.size for s in own.manifest.all())
    retention.retain_store(own, rows // 2 + own.manifest.bytes(), 0)
    return info.segments(own, "events").select(F.col("partition").alias("part"), "segment")


_EXPECTED = [("t", "a", 0, 100, True), ("t", "a", 1, 200, True), ("t", "a", 2, 300, True), ("t", "a", 3, 50, False), ("t", "b", 0, 70, True), ("t", "b", 1, 80, False)]
_FILES = [("t", "a", 0, 100), ("t", "a", 1, 190), ("t", "a", 3, 90), ("t", "a", 4, 10), ("t", "b", 1, 60), ("u", "x", 0, 5)]


def reconcile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(_EXPECTED, "topic string, partition string, segment long, size long, sealed boolean")
    f = spark.createDataFrame(_FILES, "topic string, partition string, segment long, bytes long")
    return reconcile.compare(e, f).fillna(-1, ["expected", "actual"])


def reconcile_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(_EXPECTED, "topic string, partition string, segment long, size long, sealed boolean").where("segment <> 1")
    return reconcile.untracked(spark.createDataFrame([("t-a-0",), ("t-a-1",), ("t-a-9",), ("t-c-0",), ("my-t-a-2",), ("junk",)], "name string"), e)


def replicate_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition's copy, made in pages."""
    source = store(spark, sf_dir, "events")
    target = Store(spark, _root(spark), Config(chunk_rows=CHUNK, monitor=False))
    copy = replicate.Replication(source, target, "events", page_rows=100_000)
    start = 0
    while (span := copy.page("view", start)) is not None:
        start = span.end
    return _rows(target.iterate_all("events", keep=True).df, "event_id", "time")


def schema_pages(n: int):
    """The n-th page of the topic whose schema changes, with the row limits 100, 5, 100, 100."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, cursor, page = store(spark, sf_dir, "mixed"), {}, None
        for k in range(n):
            page = s.iterate("mixed", cursor, limit=RowLimit((100, 5, 100, 100)[k]), keep=True)
            cursor = page.next
        out = _rows(page.df, "time")
        return out.withColumn("status", F.lit(page.status.value))

    return query


def schema_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = info.segments(store(spark, sf_dir, "mixed"), "mixed")
    return s.select(F.col("partition").alias("part"), "segment", "record_start", "record_end")


def struct_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir, "orders")
    kinds = s.schema(s.manifest.all()[0].schema)
    rows = [("table", ".".join(p)) for p in focusing.tables(kinds)] + [("array", ".".join(p)) for p in focusing.arrays(kinds)]
    return spark.createDataFrame(rows, "kind string, path string")


def estimate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for topic in ("events", "orders", "documents", "embeddings"):
        s = store(spark, sf_dir, topic)
        one = s.iterate_all(topic, ordered=False).df
        one = one.agg(F.lit(topic).alias("topic"), F.sum(sizes.row_size(one.schema, index=False)).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def null_large(max_bytes: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = store(spark, sf_dir, "events")
        page = s.iterate_all("events", focus=Focus(("event_id", "props"), max_bytes=max_bytes), keep=True)
        return page.df.select(F.col(PARTITION).alias("part"), F.col(INDEX).alias("idx"), "event_id", "props")

    return query


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = store(spark, sf_dir, "orders").iterate_all("orders", focus=Focus(("o_orderkey", "order.meta"), separator="."))
    return formats.json_records(page.df)


def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.legacy_records(store(spark, sf_dir, "conversations").iterate_all("conversations").df)


def list_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {t for t in ("events", "orders") for t in store(spark, sf_dir, t).topics()}
    return spark.createDataFrame([(t,) for t in sorted(names)], "topic string")


def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = store(spark, sf_dir, "events").iterate_all("events", keep=True, ordered=False)
    c = info.rechunk(page.df, INDEX, 700)
    return c.groupBy(F.col(PARTITION).alias("part"), "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as the tailing micro-batches hand them on, written and read again."""
    from .streaming.source import MicroBatches

    s, to = store(spark, sf_dir, "events"), _root(spark)
    MicroBatches(s, "events", uuid.uuid4().hex, lambda df, n: df.write.parquet(f"{to}/{n}")).available()
    return _rows(spark.read.parquet(f"{to}/*"), "event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_all": _events(lambda s: s.iterate_all("events", keep=True, ordered=False), "time", "event_id", "user_id", "value", "props"),
    "assign_offsets": _events(lambda s: s.iterate_all("events", keep=True, ordered=False)),
    "partition_from_offset": _events(lambda s: s.records("events", "click", 50, 100, keep=True)),
    "partition_time_range": _events(lambda s: s.records("events", "view", 0, 10_000, DAY, keep=True), "time", "event_id"),
    "partition_time_from_offset": _events(lambda s: s.records("events", "view", 80, 20, DAY, keep=True), "time", "event_id"),
    "page_forward_first": _events(_first),
    "page_forward_second": _events(_second),
    "page_reverse_first": _events(lambda s: _first(s, order="desc")),
    "page_reverse_second": _events(lambda s: _second(s, order="desc")),
    "cursor_after_page": _events_cursor(_first),
    "cursor_after_reverse": _events_cursor(lambda s: _first(s, order="desc")),
    "page_status": _status(_first, lambda s: s.iterate("events", limit=RowLimit(10_000_000, 2**60)), lambda s: _first(s, 10_000, partition_filter=["none"])),
    "page_exact_boundary": _status(lambda s: s.records("events", "click", 0, limit=RowLimit(len(s.partitions("events")["click"]), 2**60)), lambda s: s.records("events", "click", 0, limit=RowLimit(len(s.partitions("events")["click"]) + 1, 2**60))),
    "page_byte_limited": _events(lambda s: s.iterate("events", limit=RowLimit(10_000_000, 30_000), keep=True)),
    "page_clamped": _events(lambda s: s.iterate("events", page_size=1_000_000, keep=True)),
    "filter_exact": _filtered("click"),
    "filter_multi": _filtered("click", "regex:^v", "absent"),
    "filter_regex": _filtered("regex:i.*u|rr"),
    "filter_bad_regex": _status(lambda s: s.iterate("events", partition_filter=["regex:("])),
    "filter_empty": _status(lambda s: s.iterate("events", partition_filter=[])),
    "topic_time_page": _events(lambda s: s.iterate("events", page_size=100, time=DAY, keep=True), "time", "event_id"),
    "topic_time_cursor": _events_cursor(lambda s: s.iterate("events", page_size=100, time=DAY)),
    "focus_select": focus_orders(Focus(("o_orderkey", "time"))),
    "focus_exclude": focus_orders(Focus(("*",), ("order",))),
    "focus_flatten": focus_orders(Focus(("*",), separator="_")),
    "focus_nested_path": focus_orders(Focus(("order/meta/status", "o_orderkey"), separator="/")),
    "focus_exclude_nested": focus_orders(Focus(("*",), ("order_meta", "time"), separator="_")),
    "focus_single_struct": lambda spark, sf_dir: store(spark, sf_dir, "orders").iterate_all("orders", focus=Focus(("order",))).df.drop("meta"),
    "focus_max_bytes": null_large(2_200),
    "struct_tables": struct_tables,
    "json_records": json_records,
    "legacy_records": legacy_records,
    "estimate_sizes": estimate_sizes,
    "partition_spans": partition_spans,
    "topic_bytes": _frame(info.topic_bytes),
    "list_topics": list_topics,
    "oldest_segment": _frame(lambda s: info.oldest_segment(s, "orders").select(F.col("partition").alias("part"), "segment", "time_start"), "orders"),
    "minmax_segment": _frame(lambda s: info.edge_segments(s, "events").withColumnRenamed("partition", "part")),
    "segment_manifest": segment_manifest,
    "time_range_per_chunk": _frame(lambda s: info.chunk_times(s, "events").select(F.col("partition").alias("part"), "chunk", "start", F.col("end").alias("past"), "bytes", "time_min", "time_max")),
    "topic_info": topic_info,
    "compact_chunks": _frame(lambda s: info.compacted(s, "events", 500, 10**9).select(F.col("partition").alias("part"), F.col("start").alias("first"), F.col("end").alias("past"), "rows").withColumnRenamed("rows", "n")),
    "rechunk": rechunk,
    "retain_by_bytes": retained(60_000, 10_000),
    "retain_by_count": retained(10**12, 2),
    "retain_catalog": retain_store,
    "reconcile_states": reconcile_states,
    "reconcile_untracked": reconcile_untracked,
    "replicate_partition": replicate_partition,
    "schema_change_page1": schema_pages(1),
    "schema_change_page2": schema_pages(2),
    "schema_change_page3": schema_pages(3),
    "schema_change_page4": schema_pages(4),
    "schema_roll_segments": schema_segments,
    "stream_tail": stream_tail,
    "bench_rowcount": _frame(lambda s: info.row_count(s, "events").select(F.col("rows").alias("n"))),
    "latency_percentiles": lambda spark, sf_dir: info.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value"),
}

_MIXED = """WITH m(part, app, kind) AS (VALUES ('p1',0,'a'),('p1',1,'a'),('p1',2,'a'),('p1',3,'b'),('p1',4,'b'),('p2',0,'a'),('p2',1,'b'),('p2',2,'a'),('p2',3,'b'),('p2',4,'b'),
  ('p3',0,'a'),('p3',1,'a'),('p3',2,'a'),('p3',3,'a'),('p3',4,'b')
), r AS (SELECT part, CAST(n_nationkey AS BIGINT) AS idx, CAST(n_nationkey AS BIGINT) AS time FROM m JOIN nation ON n_nationkey // 5 = app)
"""
_SIZE = "32 + strlen(props)"

SQL: dict[str, str] = {
    "scan_all": R + "SELECT part, idx, time, event_id, user_id, value, props FROM r",
    "assign_offsets": R + "SELECT part, idx, event_id FROM r",
    "partition_from_offset": R + "SELECT part, idx, event_id FROM r WHERE part = 'click' AND idx >= 50 ORDER BY idx LIMIT 100",
    "partition_time_range": R + f"SELECT part, idx, time, event_id FROM r WHERE part = 'view' AND time BETWEEN {DAY.start} AND {DAY.end} ORDER BY idx LIMIT 10000",
    "partition_time_from_offset": R + f"SELECT part, idx, time, event_id FROM r WHERE part = 'view' AND idx >= 80 AND time BETWEEN {DAY.start} AND {DAY.end} ORDER BY idx LIMIT 20",
    "page_forward_first": R + "SELECT part, idx, event_id FROM r ORDER BY part, idx LIMIT 300",
    "page_forward_second": _with(POS) + "SELECT r.part, idx, event_id FROM r JOIN p ON r.part = p.part WHERE idx >= pos ORDER BY pos, r.part, idx LIMIT 300",
    "page_reverse_first": R + "SELECT r.part, idx, event_id FROM r JOIN c ON r.part = c.part ORDER BY n DESC, r.part DESC, idx DESC LIMIT 300",
    "page_reverse_second": _with(NEG) + "SELECT r.part, idx, event_id FROM r JOIN p ON r.part = p.part WHERE idx < pos ORDER BY pos DESC, r.part DESC, idx DESC LIMIT 300",
    "cursor_after_page": _with(POS) + "SELECT part, pos AS next FROM p",
    "cursor_after_reverse": _with(NEG) + "SELECT part, pos AS next FROM p",
    "page_status": R + "SELECT CAST(0 AS BIGINT) AS page, 'RecordLimited' AS status, CAST(300 AS BIGINT) AS n_rows UNION ALL SELECT 1, 'All', count(*) FROM r UNION ALL SELECT 2, 'All', 0",
    "page_exact_boundary": R + "SELECT CAST(0 AS BIGINT) AS page, 'RecordLimited' AS status, n AS n_rows FROM c WHERE part = 'click' UNION ALL SELECT 1, 'All', n FROM c WHERE part = 'click'",
    "page_byte_limited": R + f"""SELECT part, idx, event_id FROM (
      SELECT *, min(CASE WHEN cb >= 30000 THEN seq END) OVER () AS stop FROM (
        SELECT *, dense_rank() OVER (ORDER BY part, ch) AS seq, sum(w) OVER (ORDER BY part, ch RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb
        FROM (SELECT r.*, idx // {CHUNK} AS ch, 4 + {_SIZE} AS w FROM r))) WHERE seq <= stop OR stop IS NULL""",
    "page_clamped": R + f"""SELECT part, idx, event_id FROM (
      SELECT *, min(CASE WHEN cb >= 10240000 THEN seq END) OVER () AS stop FROM (
        SELECT *, row_number() OVER (ORDER BY part, idx) AS rn, dense_rank() OVER (ORDER BY part, ch) AS seq, sum(w) OVER (ORDER BY part, ch RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb
        FROM (SELECT r.*, idx // {CHUNK} AS ch, 4 + {_SIZE} AS w FROM r))) WHERE (seq <= stop OR stop IS NULL) AND rn <= 10000""",
    "filter_exact": R + "SELECT part, idx, event_id FROM r WHERE part = 'click'",
    "filter_multi": R + "SELECT part, idx, event_id FROM r WHERE part = 'click' OR regexp_matches(part, '^v') OR part = 'absent'",
    "filter_regex": R + "SELECT part, idx, event_id FROM r WHERE regexp_matches(part, 'i.*u|rr')",
    "filter_bad_regex": "SELECT CAST(0 AS BIGINT) AS page, 'All' AS status, CAST(0 AS BIGINT) AS n_rows",
    "filter_empty": "SELECT CAST(0 AS BIGINT) AS page, 'All' AS status, CAST(0 AS BIGINT) AS n_rows",
    "topic_time_page": R + f"SELECT part, idx, time, event_id FROM r WHERE time BETWEEN {DAY.start} AND {DAY.end} ORDER BY part, idx LIMIT 100",
    "topic_time_cursor": R + f"""SELECT c.part, CAST(coalesce(max(t.idx) + 1, 0) AS BIGINT) AS next FROM c LEFT JOIN (
      SELECT * FROM r WHERE time BETWEEN {DAY.start} AND {DAY.end} ORDER BY part, idx LIMIT 100) t ON t.part = c.part GROUP BY c.part""",
    "focus_select": O + "SELECT o_orderkey, time FROM r",
    "focus_exclude": O + "SELECT time, o_orderkey FROM r",
    "focus_flatten": O + "SELECT time, o_orderkey, o_custkey AS order_custkey, o_totalprice AS order_totalprice, o_orderstatus AS order_meta_status, o_orderpriority AS order_meta_priority FROM r",
    "focus_nested_path": O + 'SELECT o_orderstatus AS "order/meta/status", o_orderkey FROM r',
    "focus_exclude_nested": O + "SELECT o_orderkey, o_custkey AS order_custkey, o_totalprice AS order_totalprice FROM r",
    "focus_single_struct": O + "SELECT o_custkey AS custkey, o_totalprice AS totalprice FROM r",
    "focus_max_bytes": R + f"SELECT part, idx, event_id, CASE WHEN sum(strlen(props)) OVER (PARTITION BY part, idx // {CHUNK}) <= 2200 THEN props END AS props FROM r",
    "struct_tables": "SELECT * FROM (VALUES ('table','order'),('table','order.meta'),('array','time'),('array','o_orderkey'),('array','order.custkey'),('array','order.totalprice'),('array','order.meta.status'),('array','order.meta.priority')) t(kind, path)",
    "json_records": O + """SELECT '{"o_orderkey":' || o_orderkey || ',"order.meta.status":"' || o_orderstatus || '","order.meta.priority":"' || o_orderpriority || '"}' AS record FROM r""",
    "legacy_records": "SELECT conv_id * 1000 + turn AS time, text AS message FROM conversations WHERE text IS NOT NULL",
    "estimate_sizes": """SELECT 'events' AS topic, CAST(sum(32 + strlen(props)) AS BIGINT) AS bytes FROM events
      UNION ALL SELECT 'orders', CAST(sum(32 + strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT) FROM orders
      UNION ALL SELECT 'documents', CAST(sum(16 + strlen(text)) AS BIGINT) FROM documents
      UNION ALL SELECT 'embeddings', CAST(sum(8 + 4 * len(embedding)) AS BIGINT) FROM embeddings""",
    "partition_spans": R + "SELECT part, CAST(0 AS BIGINT) AS first, n AS past FROM c",
    "topic_bytes": R + f"SELECT 'events' AS topic, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM r",
    "list_topics": "SELECT * FROM (VALUES ('events'), ('orders')) t(topic)",
    "oldest_segment": O + f"SELECT part, idx // {SEGMENT} AS segment, min(time) AS time_start FROM r GROUP BY ALL ORDER BY 3, 1, 2 LIMIT 1",
    "minmax_segment": R + f"SELECT part, CAST(0 AS BIGINT) AS min_segment, (n - 1) // {SEGMENT} AS max_segment FROM c",
    "segment_manifest": R + f"SELECT part, idx // {SEGMENT} AS segment, min(idx) AS record_start, max(idx) + 1 AS record_end, min(time) AS time_start, max(time) AS time_end, CAST(sum({_SIZE}) AS BIGINT) AS size FROM r GROUP BY ALL",
    "time_range_per_chunk": R + f"SELECT part, idx // {CHUNK} * {CHUNK} AS chunk, min(idx) AS start, max(idx) + 1 AS past, CAST(sum(4 + {_SIZE}) AS BIGINT) AS bytes, min(time) AS time_min, max(time) AS time_max FROM r GROUP BY part, idx // {CHUNK}",
    "topic_info": O + f"""SELECT part, arg_min(t0, s) AS oldest, arg_max(t1, s) AS newest, min(t0) AS min_time, max(t1) AS max_time, CAST(sum(n) AS BIGINT) AS record_end, max(s) AS segment_end
      FROM (SELECT part, idx // {SEGMENT} AS s, min(time) AS t0, max(time) AS t1, count(*) AS n FROM r GROUP BY ALL) GROUP BY part""",
    "compact_chunks": R + "SELECT part, min(idx) AS first, max(idx) + 1 AS past, count(*) AS n FROM r GROUP BY part, idx // 500",
    "rechunk": R + "SELECT part, idx // 700 AS chunk, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY part, idx // 700",
    "retain_by_bytes": R + f"""SELECT part, s AS segment FROM (SELECT part, s, sum(b) OVER (PARTITION BY part ORDER BY s DESC) AS run
      FROM (SELECT part, idx // {SEGMENT} AS s, sum({_SIZE}) AS b FROM r GROUP BY ALL)) WHERE run <= 60000""",
    "retain_by_count": R + f"SELECT DISTINCT r.part, idx // {SEGMENT} AS segment FROM r JOIN c ON c.part = r.part WHERE idx // {SEGMENT} > (n - 1) // {SEGMENT} - 2",
    "reconcile_states": """SELECT topic, partition, CAST(segment AS BIGINT) AS segment, CAST(coalesce(expected, -1) AS BIGINT) AS expected, CAST(coalesce(actual, -1) AS BIGINT) AS actual, CAST(coalesce(actual, 0) - coalesce(expected, 0) AS BIGINT) AS delta, state FROM (VALUES
      ('t','a',0,100,100,'ok'),('t','a',1,200,190,'mismatch'),('t','a',2,300,NULL,'missing'),('t','a',3,50,90,'active'),('t','a',4,NULL,10,'in_flight'),
      ('t','b',0,70,NULL,'missing'),('t','b',1,80,60,'active_behind'),('u','x',0,NULL,5,'in_flight')) t(topic, partition, segment, expected, actual, state)""",
    "reconcile_untracked": "SELECT * FROM (VALUES ('t-a-1','untracked'),('t-a-9','in_flight'),('t-c-0','in_flight'),('my-t-a-2','in_flight'),('junk','unparsed')) t(name, state)",
    "replicate_partition": R + "SELECT part, idx, event_id, time FROM r WHERE part = 'view'",
    "schema_change_page1": _MIXED + "SELECT part, idx, time, 'SchemaChange' AS status FROM r WHERE (part = 'p1' AND idx < 15) OR (part = 'p2' AND idx < 5) OR (part = 'p3' AND idx < 20)",
    "schema_change_page2": _MIXED + "SELECT part, idx, time, 'RecordLimited' AS status FROM r WHERE part = 'p2' AND idx BETWEEN 5 AND 9",
    "schema_change_page3": _MIXED + "SELECT part, idx, time, 'SchemaChange' AS status FROM r WHERE part = 'p2' AND idx BETWEEN 10 AND 14",
    "schema_change_page4": _MIXED + "SELECT part, idx, time, 'All' AS status FROM r WHERE (part = 'p1' AND idx >= 15) OR (part = 'p2' AND idx >= 15) OR (part = 'p3' AND idx >= 20)",
    "schema_roll_segments": "SELECT part, CAST(segment AS BIGINT) AS segment, CAST(a AS BIGINT) AS record_start, CAST(b AS BIGINT) AS record_end FROM (VALUES ('p1',0,0,15),('p1',1,15,25),('p2',0,0,5),('p2',1,5,10),('p2',2,10,15),('p2',3,15,25),('p3',0,0,20),('p3',1,20,25)) t(part, segment, a, b)",
    "stream_tail": R + "SELECT part, idx, event_id FROM r",
    "bench_rowcount": "SELECT count(*) AS n FROM events",
}
