"""The event log: topics of partitions of segments, appended to and read by offset, time and cursor.

Data lie in Parquet, sorted by offset, with the columns ``__index`` (offset), ``__partition`` and ``__chunk`` (offset of the chunk's first
row) added. The manifest says which folders belong to which segment; a scan is an explicit list of the folders that can hold rows of the page, and
filters on offset and time that reach the Parquet reader.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import schema as schemas
from ..functions import sizes
from ..operators import focus as focusing
from ..plans.paging import Chunk, Part, Plan, plan_page, visiting_order
from ..types import CHUNK, DEFAULT_PAGE, INDEX, PARTITION, BadRequest, Cursor, DiskFull, EmptyBody, EmptyStream, Focus, InvalidQuery, Order, Page, PayloadTooLarge, RowLimit, Span, TimeRange, WriterBusy, selected
from .files import Files
from .manifest import Manifest, Segment
from .metrics import Metrics

#: Segments whose matching rows are counted in one job, the first time and at most.
SEGMENTS_FIRST, SEGMENTS_MOST = 4, 256
#: Segments of an append and partition whose chunks' statistics are fetched at once.
SEGMENTS_FETCHED = 64
#: Bytes of a range of an ordered append, each row with ``ROW_BYTES`` besides its estimate, and rows below which it is not split for the sake of more tasks.
RANGE_BYTES, ROW_BYTES, RANGE_ROWS = 32 << 20, 64, 10_000
#: A page with this limit takes whole segments and needs no statistics of chunks.
UNLIMITED = RowLimit(2**62, 2**62)

EXTRA = [T.StructField(INDEX, T.LongType()), T.StructField(PARTITION, T.StringType()), T.StructField(CHUNK, T.LongType())]


def _nullable(schema: T.StructType) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.files = Files(spark, root)
        self.manifest = Manifest(spark, self.files)
        self._chunk_cache: dict[str, dict] = {}
        self.busy: set[tuple[str, str]] = set()
        self.metrics = Metrics()

    # ---- writing

    def append(self, topic: str, partition: str, rows: DataFrame | pa.Table, order_by: list[str] | None = None, metadata: dict[str, str] | None = None, txn: str | None = None) -> Span:
        """Append ``rows`` to a partition, in their order or that of ``order_by``; returns their offsets once they are committed.

        A new segment begins before the append where the schema differs or the last segment is over a limit of ``config.roll``, so a
        segment may exceed it by one append. An append under a ``txn`` that was committed before changes nothing.
        """
        if isinstance(rows, pa.Table):
            if rows.nbytes > self.config.max_append_bytes:
                raise PayloadTooLarge(rows.nbytes, self.config.max_append_bytes)
            if rows.num_rows == 0 and rows.num_columns == 0:
                raise EmptyBody("no body provided")
            rows, metadata = self.from_arrow(rows, metadata)
        df = rows.withColumn(PARTITION, F.lit(partition))
        out = self._write(topic, df, rows.schema, order_by or [], metadata or {}, txn, None)
        at = self.manifest.ends.get((topic, partition), 0)
        return out.get(partition, Span(at, at))

    def ingest(self, topic: str, rows: DataFrame, partition_by: str, order_by: list[str], segment_rows: int | None = None, metadata: dict[str, str] | None = None, drop_key: bool = False, txn: str | None = None) -> dict[str, Span]:
        """Append to many partitions at once: each row to the one that ``partition_by`` names, in order of ``order_by``.

        Segments are cut at every ``segment_rows`` (default: ``config.roll.max_rows``). Offsets come from a sort by range and one count for each range,
        so neither a partition nor the whole goes through one task.
        """
        df = rows.withColumn(PARTITION, F.col(partition_by).cast("string"))
        schema = rows.schema
        if drop_key:
            df, schema = df.drop(partition_by), rows.drop(partition_by).schema
        return self._write(topic, df, schema, order_by, metadata or {}, txn, segment_rows or self.config.roll.max_rows)

    def from_arrow(self, table: pa.Table, metadata: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        table, fields, own = schemas.from_arrow(table)
        df = self.spark.createDataFrame(table)
        kinds = T.StructType([T.StructField(f.name, f.dataType, table.schema.field(f.name).nullable, fields[f.name]) for f in df.schema.fields])
        return self.spark.createDataFrame(table, schema=kinds), own | (metadata or {})

    def _write(self, topic: str, df: DataFrame, schema: T.StructType, order_by: list[str], metadata: dict, txn: str | None, segment_rows: int | None) -> dict[str, Span]:
        if self.config.monitor and self.files.exists("") and self.files.free() < self.config.monitor_min_free:
            raise DiskFull("too little free space: the store is read-only")
        schemas.check(schema)
        txn = txn or uuid.uuid4().hex
        self.manifest.refresh()
        if txn in self.manifest.txns:
            return {}
        print_ = schemas.fingerprint(schema, metadata)
        # ranges in order, and the place within each
        order = [F.col(PARTITION), *[F.col(c) for c in order_by]]
        if order_by:
            df = df.repartitionByRange(self._ranges(df, schema), *order).sortWithinPartitions(*order)
        df = df.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")).persist()
        try:
            # rows of a partition in a range stand together; those before it in the range and in earlier ranges come first
            counts = df.groupBy(PARTITION, "__range").agg(F.count("*").alias("n"), F.min("__row").alias("first")).collect()
            held = {(topic, r[PARTITION]) for r in counts}
            with self.manifest.lock:
                if taken := sorted(held & self.busy, key=str):
                    raise WriterBusy(f"an append to {taken[0][0]}/{taken[0][1]} is under way")
                self.busy |= held
            try:
                return self._store(topic, df, schema, print_, metadata, txn, segment_rows, counts)
            finally:
                with self.manifest.lock:
                    self.busy -= held
        finally:
            df.unpersist()

    def _ranges(self, df: DataFrame, schema: T.StructType) -> int:
        """How many ranges ``df`` is sorted by: a task sorts one, so their number grows with the bytes and is at least that of shuffle partitions where there are rows for it."""
        known = [sizes.size_of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields if sizes.is_sized(f.dataType)]
        rows, size = df.agg(F.count("*"), F.coalesce(F.sum(reduce(lambda a, b: a + b, known)), F.lit(0))).first()
        few = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
        return max(1, few, -(-(size + ROW_BYTES * rows) // RANGE_BYTES))

    def _store(self, topic: str, df: DataFrame, schema: T.StructType, print_: str, metadata: dict, txn: str, segment_rows: int | None, counts: list) -> dict[str, Span]:
        totals: dict[str, int] = {}
        bases = []
        for r in sorted(counts, key=lambda r: (r[PARTITION] or "", r["__range"])):
            p = r[PARTITION] or ""
            bases.append((r[PARTITION], r["__range"], totals.get(p, 0) - r["first"]))
            totals[p] = totals.get(p, 0) + r["n"]
        if not totals:
            return {}
        starts = {p: self.manifest.ends.get((topic, p), 0) for p in totals}
        heads = {p: self._head(topic, p, print_) for p in totals}
        bases = [(p, k, base, starts[p or ""], heads[p or ""][0]) for p, k, base in bases]
        # broadcast, so that rows stay in their ranges: a shuffle by partition would put each into one task
        base = F.broadcast(self.spark.createDataFrame(bases, "__of string, __in int, __base long, __start long, __segment0 long"))
        df = df.join(base, F.col(PARTITION).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__in"))).withColumn("__p", F.coalesce(PARTITION, F.lit("")))
        nth = F.col("__row") + F.col("__base")
        segment = F.col("__segment0") + (F.floor(nth / segment_rows) if segment_rows else F.lit(0))
        per = self.config.chunk_rows
        user = [F.col(f"`{c}`") for c in schema.fieldNames()]
        df = df.select(*user, (F.col("__start") + nth).alias(INDEX), F.col("__p").alias(PARTITION), (F.col("__start") + F.floor(nth / per) * per).cast("long").alias(CHUNK), segment.cast("long").alias("__segment"))
        folder = f"data/{txn}"
        names = {p: f"p{k}" for k, p in enumerate(sorted(totals))}
        place = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(PARTITION)] if len(names) > 1 else F.lit(next(iter(names.values())))
        df.withColumn("__place", F.concat(place, F.lit("-"), F.col("__segment").cast("string"))).sortWithinPartitions("__place", INDEX).write.partitionBy("__place").parquet(self.files.full(f"{folder}/rows"))
        # from what was written: a lost executor may have had ties in another order
        written = self.spark.read.schema(T.StructType([*_nullable(schema), *EXTRA, T.StructField("__place", T.StringType())])).parquet(self.files.full(f"{folder}/rows"))
        number = F.substring_index("__place", "-", -1).cast("long")
        stats = written.groupBy(F.col(PARTITION).alias("partition"), number.alias("segment"), F.col(CHUNK).alias("chunk")).agg(
            F.min(INDEX).alias("start"), (F.max(INDEX) + 1).alias("end"), F.sum(sizes.row_size(schema)).alias("bytes"), F.min(schemas.TIME).alias("time_min"), F.max(schemas.TIME).alias("time_max"))
        stats.write.parquet(self.files.full(f"{folder}/chunks"))
        chunks = self.spark.read.parquet(self.files.full(f"{folder}/chunks"))
        rows = chunks.groupBy("partition", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("bytes").alias("bytes"), F.min("time_min").alias("t0"), F.max("time_max").alias("t1")).collect()
        last = {p: max(r["segment"] for r in rows if r["partition"] == p) for p in totals}
        unsized = not all(sizes.is_sized(f.dataType) for f in schema.fields)
        add, extend, seal = [], [], []
        for r in rows:
            p = r["partition"]
            n = r["end"] - r["start"]
            path = f"{folder}/rows/__place={names[p]}-{r['segment']}"
            # without an estimate a row counts as a byte; the page's offset column is no part of a segment
            size = n if unsized else r["bytes"] - n * sizes.INDEX_WIDTH
            new = Segment(topic, p, r["segment"], print_, r["t0"] if r["t0"] is not None else 0, r["t1"] if r["t1"] is not None else 0, r["start"], r["end"], size, 1, r["segment"] < last[p], [path], [f"{folder}/chunks"], max(0, self.files.size(path)))
            old = heads[p][1]
            if old is not None and old.segment == new.segment:
                extend.append(new)
                continue
            if old is not None and not old.sealed and r["segment"] == heads[p][0]:
                seal.append(old)
                self.metrics.add("slog_roll", 1, topic=topic, partition=p)
                if old.schema != print_:
                    self.metrics.add("partition_schema_change", 1, topic=topic, partition=p)
            add.append(new)
        commit = functools.partial(self.manifest.commit, add=add, extend=extend, seal=seal, schemas={print_: {"fields": schema.json(), "metadata": metadata}}, topics=[topic], txn=txn)
        while not commit():
            if any(self.manifest.ends.get((topic, p), 0) != starts[p] for p in totals):
                self.files.delete(folder)
                raise WriterBusy("another append took these offsets")
        for p, n in totals.items():
            self.metrics.add("slog_thread_records_written", n, topic=topic, partition=p)
        return {p: Span(starts[p], starts[p] + n) for p, n in totals.items()}

    def _head(self, topic: str, partition: str, print_: str) -> tuple[int, Segment | None]:
        """Number of the segment that the next append goes to, and the last one there is."""
        own = self.manifest.of(topic, partition)
        if not own:
            return self.manifest.high.get((topic, partition), -1) + 1, None
        last, roll = own[-1], self.config.roll
        full = last.sealed or last.schema != print_ or last.rows > roll.max_rows or last.size > roll.max_bytes or (roll.max_duration_ms is not None and last.time_end - last.time_start > roll.max_duration_ms)
        return last.segment + full, last

    # ---- what there is

    def topics(self) -> list[str]:
        self.manifest.refresh()
        return sorted(self.manifest.topics)

    def partitions(self, topic: str) -> dict[str, Span]:
        self.manifest.refresh()
        return self.manifest.spans(topic)

    def schema(self, print_: str) -> T.StructType:

        return T.StructType.fromJson(json.loads(self.manifest.schemas[print_]["fields"]))

    def metadata(self, print_: str) -> dict[str, str]:
        return self.manifest.schemas[print_]["metadata"]

    def chunk_frame(self, topic: str) -> DataFrame:
        """Statistics of all chunks of a topic: ``partition, segment, chunk, start, end, bytes, time_min, time_max``."""
        folders = sorted({c for s in self.manifest.all() if s.topic == topic for c in s.chunks})
        kept = self.manifest.frame().where(F.col("topic") == topic).select("partition", "segment")
        return self.spark.read.parquet(*[self.files.full(c) for c in folders]).join(kept, ["partition", "segment"], "left_semi")

    def _chunks(self, s: Segment) -> list:
        """Chunk statistics of a segment, in order; read once a folder, partition and run of ``SEGMENTS_FETCHED`` segments."""
        out = []
        first = s.segment // SEGMENTS_FETCHED * SEGMENTS_FETCHED
        for c in s.chunks:
            key = f"{c}|{s.partition}|{first}"
            if key not in self._chunk_cache:
                if len(self._chunk_cache) > 256:
                    self._chunk_cache.clear()
                by: dict[int, list] = {}
                for r in self.spark.read.parquet(self.files.full(c)).where((F.col("partition") == s.partition) & F.col("segment").between(first, first + SEGMENTS_FETCHED - 1)).collect():
                    by.setdefault(r["segment"], []).append(r)
                self._chunk_cache[key] = by
            out += self._chunk_cache[key].get(s.segment, [])
        return sorted(out, key=lambda r: r["start"])

    # ---- reading

    def scan(self, segments: Iterable[Segment], print_: str) -> DataFrame:
        """All rows of segments of one schema, with the store's columns; folders that are gone give no rows."""
        full = T.StructType([*self.schema(print_).fields, *EXTRA])
        named = [p for s in segments for p in s.paths]
        # one listing an append, not one call a segment
        there = {f"{rows}/{n}" for rows in {p.rsplit("/", 1)[0] for p in named} for n in self.files.names(rows)}
        paths = [self.files.full(p) for p in named if p in there]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*paths)

    def records(self, topic: str, partition: str, start: int, page_size: int | None = None, time: TimeRange | None = None, focus: Focus | None = None, keep: bool = False, limit: RowLimit | None = None) -> Page:
        """A page of one partition, forward from offset ``start``; ``span`` holds its first offset and the one after its last."""
        self.manifest.refresh()
        page = self._page(topic, [(start, partition)] if self.manifest.span(topic, partition) else [], limit or self._limit(page_size), Order.ASC, time, focus, keep)
        return page

    def iterate(self, topic: str, cursor: Cursor | None = None, page_size: int | None = None, order: Order | str | None = None, partition_filter: list[str] | None = None, time: TimeRange | None = None, focus: Focus | None = None, keep: bool = False, limit: RowLimit | None = None, ordered: bool = True) -> Page:
        """A page of all partitions of a topic from ``cursor`` on; ``next`` is the cursor after it."""
        order, cursor = Order.parse(order), dict(cursor or {})
        if order is Order.DESC and time is not None:
            raise InvalidQuery("time ranges are read forward only")
        self.manifest.refresh()
        visits = visiting_order(self.manifest.spans(topic), cursor, order, lambda p: selected(p, partition_filter))
        page = self._page(topic, visits, limit or self._limit(page_size), order, time, focus, keep, ordered)
        page.next = cursor | {p: pos for pos, p in visits} | page.next
        return page

    def iterate_all(self, topic: str, cursor: Cursor | None = None, partition_filter: list[str] | None = None, time: TimeRange | None = None, focus: Focus | None = None, keep: bool = False, ordered: bool = True) -> Page:
        """All rows from ``cursor`` on that pages would give before the first change of schema, as one scan without limits.

        Without ``ordered`` rows come as they are read, by partition and offset only within a file, and nothing is shuffled.
        """
        page = self.iterate(topic, cursor, None, Order.ASC, partition_filter, time, focus, keep, limit=UNLIMITED, ordered=ordered)
        if not page.rows:
            raise EmptyStream(f"nothing to read in {topic}")
        return page

    def _limit(self, page_size: int | None) -> RowLimit:
        n = DEFAULT_PAGE if page_size is None else page_size
        if n < 0:
            raise BadRequest("a page cannot have fewer than no rows")
        return replace(self.config.max_page, max_records=n).min(self.config.max_page)

    def _page(self, topic: str, visits: list[tuple[int, str]], limit: RowLimit, order: Order, time: TimeRange | None, focus: Focus | None, keep: bool, ordered: bool = True) -> Page:
        visits = [v for v in visits if self.manifest.span(topic, v[1])]
        if time is not None:
            plan, moved = plan_page(visits, functools.partial(self._timed, topic, time, limit is UNLIMITED), limit, order)
        elif limit is UNLIMITED:
            plan, moved = plan_page(visits, functools.partial(self._whole, topic), limit, order)
        else:
            # the bytes of part of a chunk are only counted where the byte limit may be reached
            plan, moved = plan_page(visits, functools.partial(self._between, topic, order, False), limit, order)
            if plan.bytes >= limit.max_bytes:
                plan, moved = plan_page(visits, functools.partial(self._between, topic, order, True), limit, order)
        span = None
        if plan.parts and len(visits) == 1:
            span = Span(plan.parts[0].lo, plan.parts[0].hi + 1)
        df = self._frame(topic, plan, order, time, focus, keep, ordered)
        meta = self.metadata(plan.schema) if plan.schema else {}
        return Page(df, plan.status, moved, span, plan.rows, meta)

    def _whole(self, topic: str, partition: str, position: int) -> Iterator[Chunk]:
        """Segments from an offset on, each as one chunk: offsets are dense, so the manifest alone tells their rows."""
        for s in self.manifest.by_offset(topic, partition, position):
            lo = max(s.record_start, position)
            yield Chunk(s.schema, lo, s.record_end - 1, s.record_end - lo, s.size, s.segment)

    def _between(self, topic: str, order: Order, exact: bool, partition: str, position: int) -> Iterator[Chunk]:
        """Chunks from an offset on, or before it in reverse."""
        back = order is Order.DESC
        for s in self.manifest.by_offset(topic, partition, position, back):
            own = self._chunks(s)
            for c in own[::-1] if back else own:
                lo, hi = (c["start"], min(c["end"], position)) if back else (max(c["start"], position), c["end"])
                if lo >= hi:
                    continue
                size = c["bytes"]
                if exact and hi - lo < c["end"] - c["start"] and size:
                    part = self.scan([s], s.schema).where(F.col(INDEX).between(lo, hi - 1))
                    size = part.agg(F.sum(sizes.row_size(self.schema(s.schema)))).first()[0] or 0
                first, last = (hi - 1, lo) if back else (lo, hi - 1)
                yield Chunk(s.schema, first, last, hi - lo, size, s.segment)

    def _timed(self, topic: str, time: TimeRange, whole: bool, partition: str, position: int) -> Iterator[Chunk]:
        """Chunks, or ``whole`` segments, of rows from an offset on within a time range, counted some segments at a time, so that a page reads few of them."""
        left, step = self.manifest.by_time(topic, partition, position, time.start, time.end), SEGMENTS_FIRST
        while left:
            few = [left[0]]
            while len(few) < min(step, len(left)) and left[len(few)].schema == left[0].schema:
                few.append(left[len(few)])
            left, step = left[len(few) :], min(4 * step, SEGMENTS_MOST)
            hit = self.scan(few, few[0].schema).where((F.col(INDEX) >= position) & F.col(schemas.TIME).between(time.start, time.end))
            if whole:
                starts = F.array(*[F.lit(s.record_start) for s in few])
                nth = F.size(F.filter(starts, lambda x: x <= F.col(INDEX))).alias("nth")
                for r in hit.groupBy(nth).agg(F.count("*").alias("n"), F.min(INDEX).alias("lo"), F.max(INDEX).alias("hi")).orderBy("nth").collect():
                    yield Chunk(few[0].schema, r["lo"], r["hi"], r["n"], 0, few[r["nth"] - 1].segment)
                continue
            got = hit.groupBy(CHUNK).agg(F.count("*").alias("n"), F.sum(sizes.row_size(self.schema(few[0].schema))).alias("bytes"), F.min(INDEX).alias("lo"), F.max(INDEX).alias("hi")).orderBy(CHUNK).collect()
            for r in got:
                chunk = r[CHUNK]

                @functools.cache
                def places(chunk=chunk, hit=hit) -> list[int]:
                    return sorted(x[0] for x in hit.where(F.col(CHUNK) == chunk).select(INDEX).collect())

                segment = next((s.segment for s in few if s.record_start <= r["lo"] < s.record_end), few[0].segment)
                yield Chunk(few[0].schema, r["lo"], r["hi"], r["n"], r["bytes"] or 0, segment, lambda n, at=places: at()[n])

    def _frame(self, topic: str, plan: Plan, order: Order, time: TimeRange | None, focus: Focus | None, keep: bool, ordered: bool) -> DataFrame:
        if not plan.parts or plan.schema is None:
            return self.spark.createDataFrame([], T.StructType([]))
        segments = [s for p in plan.parts for s in self.manifest.of(topic, p.partition) if s.segment in set(p.segments)]
        df = self.scan(segments, plan.schema)
        where = reduce(lambda a, b: a | b, [self._inside(p) for p in plan.parts])
        if time is not None:
            where = where & F.col(schemas.TIME).between(time.start, time.end)
        names = [p.partition for p in plan.parts]
        rank = [F.array_position(F.array(*[F.lit(n) for n in names]), F.col(PARTITION))] if len(names) > 1 else []
        index = F.col(INDEX) if order is Order.ASC else F.col(INDEX).desc()
        df = df.where(where)
        if focus:
            df = focusing.apply(df, self.schema(plan.schema), focus)
        df = df.drop(CHUNK).orderBy(*rank, index) if ordered else df.drop(CHUNK)
        return df if keep else df.drop(PARTITION, INDEX)

    @staticmethod
    def _inside(p: Part):
        return (F.col(PARTITION) == p.partition) & F.col(INDEX).between(p.lo, p.hi)

    def free(self, removed: Iterable[Segment]) -> None:
        """Delete what only ``removed`` segments held, and an append's whole folder with its statistics after its last segment."""
        live = {p for s in self.manifest.all() for p in s.paths}
        used = {p.split("/")[1] for p in live}
        for n in {p.split("/")[1] for s in removed for p in s.paths} - used:
            self.files.delete(f"data/{n}")
        for p in {p for s in removed for p in s.paths}:
            if p not in live and p.split("/")[1] in used:
                self.files.delete(p)

    def repair(self) -> list[str]:
        """Delete data that no segment names: of appends that were never committed, and of segments removed before a crash; returns the folders."""
        self.manifest.refresh()
        live = {path for s in self.manifest.all() for path in s.paths}
        used = {path.split("/")[1] for path in live}
        gone = []
        for n in self.files.names("data"):
            if n not in used:
                gone.append(f"data/{n}")
            else:
                gone += [p for x in self.files.names(f"data/{n}/rows") if x.startswith("__place=") and (p := f"data/{n}/rows/{x}") not in live]
        for n in gone:
            self.files.delete(n)
        return gone
