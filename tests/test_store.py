"""The event log end to end, on the situations its semantics are made of."""

import itertools
import json
import threading
import time
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.config import Config, Retain, Roll
from tidelog.functions import schema as schemas
from tidelog.operators import batch, focus, info, reconcile, replicate, retention
from tidelog.operators.upkeep import Upkeep
from tidelog.sources import formats
from tidelog.sources.http import Api, serve
from tidelog.sources.store import Store
from tidelog.streaming.sink import write_stream
from tidelog.streaming.source import MicroBatches, tail
from tidelog.types import CannotReshape, DiskFull, EmptyStream, Focus, InvalidQuery, InvalidSchema, NullTypes, PathError, PayloadTooLarge, RowLimit, Span, Status, TimeRange


@pytest.fixture
def make(spark, tmp_path):
    n = itertools.count()

    def new(**config):
        return Store(spark, str(tmp_path / f"store{next(n)}"), Config(monitor=False, **config))

    return new


def legacy(spark, *records):
    return formats.from_legacy(spark, [(t, m) for t, m in records]).coalesce(1)


def five(spark, kind, start=0):
    """Five rows of one of two schemas."""
    if kind == "a":
        return spark.createDataFrame([(start + i, float(i), {"mul": 2.0, "tensor": [2.0 * i] * 2}) for i in range(5)], "time long not null, inputs float, outputs struct<mul float, tensor array<double>>").coalesce(1)
    return spark.createDataFrame([(start + i, str(i), float(i)) for i in range(5)], "time long not null, inputs string, outputs float").coalesce(1)


def messages(page):
    return [r["message"] for r in page.df.collect()]


def test_head_and_tail(spark, make):
    s = make()
    assert s.append("t", "p", legacy(spark, *[(i, f"m{i}") for i in range(6)])) == Span(0, 6)
    assert s.append("t", "p", legacy(spark, *[(i, f"m{i}") for i in range(6, 10)])) == Span(6, 10)
    assert messages(s.records("t", "p", 0, 3)) == ["m0", "m1", "m2"]
    page = s.records("t", "p", 7, 3)
    assert messages(page) == ["m7", "m8", "m9"] and page.span == Span(7, 10) and page.status is Status.RECORD_LIMITED
    assert messages(s.iterate("t", {"p": 3}, 3, "desc")) == ["m2", "m1", "m0"]
    back = s.iterate("t", {"p": 10}, 3, "desc")
    assert messages(back) == ["m9", "m8", "m7"] and back.next == {"p": 7}
    assert s.records("t", "p", 10, 3).rows == 0 and s.records("t", "none", 0).rows == 0
    assert s.records("t", "p", 0, 0).status is Status.RECORD_LIMITED
    again = Store(spark, s.files.root)
    assert again.partitions("t") == {"p": Span(0, 10)} and again.topics() == ["t"]


def test_times_out_of_order(spark, make):
    s = make(roll=Roll(max_rows=1))
    rows = list(zip([5, 6, 0, 10, 4, 3, 12, 2], "abc def ghi jkl mno p q r".split(), strict=True))
    for k in range(0, 8, 2):
        s.append("t", "p", legacy(spark, *[(1000 * t, m) for t, m in rows[k : k + 2]]))
    assert info.segments(s, "t").count() == 4
    for start, limit, (a, b) in itertools.product((0, 1, 5), (1, 3, 10), ((0, 12), (3, 6), (11, 11), (2, 4))):
        want = [m for i, (t, m) in enumerate(rows) if i >= start and a <= t <= b][:limit]
        page = s.records("t", "p", start, limit, TimeRange(1000 * a, 1000 * b))
        assert (messages(page) if page.rows else []) == want


def test_byte_limit_keeps_the_chunk(spark, make):
    s = make()
    for n in (6, 4, 10):
        s.append("t", "p", legacy(spark, *[(i, "x" * 50) for i in range(n)]))
    for most in (250, 1):
        page = s.records("t", "p", 0, limit=RowLimit(10, most))
        assert page.rows == 6 and page.status is Status.BYTE_LIMITED
    assert s.records("t", "p", 4, limit=RowLimit(10, 130)).rows == 6


def test_topic_time_pages(spark, make):
    s = make()
    for k, t in enumerate((0, 10, 12, 13, 14, 15)):
        s.append("t", f"p{k % 3}", legacy(spark, (1000 * t, str(t))))
    window, cursor, seen = TimeRange(5000, 18000), {}, []
    for limit in (2, 1, 5, 1):
        page = s.iterate("t", cursor, limit, time=window)
        cursor = page.next
        seen.append(tuple(cursor[p] for p in ("p0", "p1", "p2")))
    assert seen == [(2, 1, 0), (2, 1, 1), (2, 2, 2), (2, 2, 2)]
    with pytest.raises(InvalidQuery):
        s.iterate("t", {}, 1, "desc", time=window)


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("mixed")), Config(monitor=False))
    for p, kinds in (("p1", "aaabb"), ("p2", "ababb"), ("p3", "aaaab")):
        for k, kind in enumerate(kinds):
            s.append("t", p, five(spark, kind, 5 * k))
    return s


def walk(s, limits, order):
    cursor, out = {}, []
    for n in limits:
        page = s.iterate("t", cursor, order=order, limit=RowLimit.records(n))
        cursor = page.next
        out.append((tuple(cursor[p] for p in ("p1", "p2", "p3")), page.status))
    return out


def test_schema_changes(mixed):
    change, limited, done = Status.SCHEMA_CHANGE, Status.RECORD_LIMITED, Status.ALL
    assert walk(mixed, (100, 5, 100, 100), "asc") == [((15, 5, 20), change), ((15, 10, 20), limited), ((15, 15, 20), change), ((25, 25, 25), done)]
    assert walk(mixed, (100, 100, 100, 100), "desc") == [((15, 15, 20), change), ((0, 10, 0), change), ((0, 5, 0), change), ((0, 0, 0), done)]
    assert mixed.records("t", "p1", 0).rows == 15 and mixed.records("t", "p1", 0).status is change
    assert len(info.segments(mixed, "t", "p2").collect()) == 4


def test_reverse_order_and_isolation(spark, make):
    s = make()
    for k in range(4):
        s.append("t", f"p{k}", legacy(spark, *[(i, f"r{i}") for i in range(5 * k, 5 * k + 5)]))
    page = s.iterate("t", page_size=5, order="desc")
    assert messages(page) == ["r19", "r18", "r17", "r16", "r15"]
    assert page.next == {"p0": 5, "p1": 5, "p2": 5, "p3": 0}
    s.append("t", "p3", legacy(spark, (20, "r20")))
    s.append("t", "p4", legacy(spark, (21, "r21")))
    cursor, rest = page.next, []
    while (page := s.iterate("t", cursor, 4, "desc", partition_filter=["p9"])).rows:
        rest += messages(page)
        cursor = page.next
    assert sorted(rest) == sorted(f"r{i}" for i in range(15))
    assert s.iterate("t", page_size=100, order="desc").rows == 22
    assert s.iterate("t", page_size=100, partition_filter=["regex:p[12]", "p4"]).rows == 11
    pages = list(tail(s, "t", page_size=7))
    assert sum(p.rows for p in pages) == 22 and s.iterate_all("t").rows == 22
    with pytest.raises(EmptyStream):
        s.iterate_all("t", pages[-1].next)


def test_focus(spark, make):
    s = make(chunk_rows=1000)
    inner = "struct<index long>"
    df = spark.createDataFrame([(i, ((i,), i)) for i in range(5)], f"time long not null, child struct<grandchild {inner}, index long>").coalesce(1)
    s.append("t", "p", df)
    get = lambda *a, **k: s.iterate("t", focus=Focus(*a, **k)).df
    assert get(("*",), separator=".").columns == ["time", "child.grandchild.index", "child.index"]
    assert get(("child.index", "time", "time"), separator=".").columns == ["child.index", "time", "time"]
    assert get(("child",)).columns == ["grandchild", "index"]
    assert get(("*",), ("child.grandchild",), separator=".").columns == ["time", "child.index"]
    assert get(("*",), ("child.index",)).columns == ["time", "child"]
    assert [r[0] for r in get(("child.grandchild.index",), separator=".").collect()] == list(range(5))
    for f, kind in ((Focus(("nope",)), "KeyMissing"), (Focus(("time.x",), separator="."), "NotStruct"), (Focus((), ("time",)), "Empty"), (Focus(("time",), ("time",)), "Empty"), (Focus(max_bytes=3), "Empty")):
        with pytest.raises(PathError) as e:
            s.iterate("t", focus=f)
        assert e.value.kind == kind
    big = spark.createDataFrame([(i, "x" * 10_000) for i in range(5)], "time long not null, large_text string").coalesce(1)
    s.append("big", "p", big)
    rows = s.iterate("big", focus=Focus(("*",), max_bytes=100)).df.collect()
    assert [r["large_text"] for r in rows] == [None] * 5 and [r["time"] for r in rows] == list(range(5))
    assert s.iterate("big", focus=Focus(("*",), max_bytes=50_000)).df.first()["large_text"] is not None
    kinds = df.schema
    assert focus.tables(kinds) == [("child",), ("child", "grandchild")] and focus.arrays(kinds)[-1] == ("child", "index")
    assert focus.table(df, ("child", "grandchild")).columns == ["index"] and focus.unnest(df, "child", "time").columns == ["time", "grandchild", "index"]
    assert focus.to_struct(df, "s").select("s.*").columns == df.columns


def test_schemas_and_arrow(spark, make):
    s = make()
    for df, error in (
        (spark.createDataFrame([(1, 2)], "x long, time long"), InvalidSchema),
        (spark.createDataFrame([("1",)], "time string"), InvalidSchema),
        (spark.range(1).select(F.col("id").alias("time"), F.array().alias("x")), NullTypes),
        (spark.range(1).select(F.col("id").alias("time"), F.lit(None).alias("x")), NullTypes),
    ):
        with pytest.raises(error):
            s.append("t", "p", df)
    fields = [pa.field("time", pa.int64(), False), pa.field("u", pa.uint32()), pa.field("d", pa.dictionary(pa.int8(), pa.string())), pa.field("f", pa.list_(pa.int64(), 2), metadata={"ARROW:extension:name": "arrow.fixed_shape_tensor"}), pa.field("h", pa.float16())]
    table = pa.table([pa.array([0, 1]), pa.array([1, 2**32 - 1], pa.uint32()), pa.array(["a", None]).dictionary_encode().cast(pa.dictionary(pa.int8(), pa.string())), pa.array([[1, 2], [3, 4]], pa.list_(pa.int64(), 2)), pa.array([1.5, 2.5], pa.float32()).cast(pa.float16())], schema=pa.schema(fields, {"pipeline.name": "x"}))
    assert s.append("t", "p", table) == Span(0, 2)
    page = s.records("t", "p", 0)
    assert page.metadata == {"pipeline.name": "x"}
    assert [tuple(r) for r in page.df.collect()] == [(0, 1, "a", [1, 2], 1.5), (1, 2**32 - 1, None, [3, 4], 2.5)]
    kept = s.schema(s.manifest.of("t", "p")[0].schema)
    assert kept["f"].metadata["ARROW:extension:name"] == "arrow.fixed_shape_tensor" and kept["u"].metadata[schemas.ORIGIN] == "uint32"
    with pytest.raises(NullTypes):
        s.append("t", "p", pa.table({"time": pa.array([1]), "n": pa.nulls(1)}))
    with pytest.raises(PayloadTooLarge):
        make(max_append_bytes=8).append("t", "p", table)
    assert schemas.compatible(None, kept) and not schemas.compatible(kept, kept, {"a": "1"})
    with pytest.raises(DiskFull):
        full = make()
        full.files.create("x", "")
        full.config.monitor, full.config.monitor_min_free = True, 2**62
        full.append("t", "p", legacy(spark, (1, "a")))


def test_rolling_and_retention(spark, make):
    s = make(roll=Roll(max_rows=3))
    for k in range(6):
        s.append("t", "p", legacy(spark, (2 * k, "x" * 10), (2 * k + 1, "y" * 10)))
    # an append may take a segment over its limit: 4 rows each
    assert [(r["record_start"], r["record_end"]) for r in info.segments(s, "t").orderBy("segment").collect()] == [(0, 4), (4, 8), (8, 12)]
    s.config.retain = Retain(max_bytes=150, max_segment_count=10)
    assert [g.segment for g in retention.retain_partitions(s)] == [0]
    assert s.partitions("t") == {"p": Span(4, 12)} and messages(s.records("t", "p", 0, 1)) == ["x" * 10]
    s.config.retain = Retain(max_segment_count=1)
    assert [g.segment for g in retention.retain_partitions(s)] == [1]
    assert s.append("t", "p", legacy(spark, (99, "z"))) == Span(12, 13)
    o = make()
    o.append("oldest", "p", legacy(spark, (0, "x" * 500)))
    for k in range(3):
        o.append(f"t{k}", "p", legacy(spark, (100_000, "x" * 500)))
    gone = retention.retain_store(o, 508 * 3 + o.manifest.bytes(), 0)
    assert [g.topic for g in gone] == ["oldest"]
    assert o.repair() == []


def test_transactions_and_repair(spark, make):
    s = make()
    assert s.append("t", "p", legacy(spark, (1, "a")), txn="one") == Span(0, 1)
    s.append("t", "p", legacy(spark, (1, "a")), txn="one")
    assert s.partitions("t") == {"p": Span(0, 1)}
    s.files.create("data/orphan/rows/x", "junk")
    assert s.repair() == ["data/orphan"] and s.records("t", "p", 0).rows == 1
    other = Store(spark, s.files.root)
    s.append("t", "p", legacy(spark, (2, "b")))
    assert other.append("t", "p", legacy(spark, (3, "c"))) == Span(2, 3)


def test_reconcile(spark, make):
    s = make(roll=Roll(max_rows=1))
    for k in range(3):
        s.append("t", "p", legacy(spark, (k, "a"), (k, "b")))
    r = reconcile.Reconciler(s)
    assert r.run().missing == [] and r.run().expected_bytes == r.run().actual_bytes
    first, second, _ = s.manifest.of("t", "p")
    s.files.delete(first.paths[0])
    s.files.create(second.paths[0] + "/_more", "x")
    out = r.run(fix=True)
    assert out.missing == [("t", "p", 0)] and out.mismatched[0][2] == 1 and out.fixed == 1
    assert r.run().mismatched == []
    r._fixing.acquire()
    assert r.run(fix=True).reason == "another pass is fixing"
    assert [x["message"] for x in s.iterate_all("t").df.collect()] == ["a", "b"] * 2  # a lost segment gives no rows
    assert reconcile.parse_locator("a-b-c-12") == ("a-b", "c", 12) and reconcile.parse_locator("junk") is None
    assert not reconcile.update_size(s, ("t", "p", 9), 1, 2)


def test_replication(spark, make):
    a, b = make(), make()
    for k in range(3):
        a.append("t", f"p{k % 2}", legacy(spark, *[(i, f"{k}.{i}") for i in range(5)]))
    copy = replicate.Replication(a, b, "t", page_rows=4)
    assert copy.pump() == 15 and copy.pump() == 0
    for p in ("p0", "p1"):
        assert messages(b.records("t", p, 0)) == messages(a.records("t", p, 0))
    a.append("t", "p0", legacy(spark, (9, "new")))
    assert copy.sync() == {"p0": 10, "p1": 5} and copy.pump() == 1


def test_streams(spark, make, tmp_path):
    s = make()
    spark.createDataFrame([(i, f"k{i % 2}", f"m{i}") for i in range(10)], "time long, k string, message string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time long, k string, message string").parquet(str(tmp_path / "in"))
    q = write_stream(stream, s, "t", "k", ["time"], str(tmp_path / "cp"), "q", {"availableNow": True}, drop_key=True)
    q.awaitTermination()
    assert s.partitions("t") == {"k0": Span(0, 5), "k1": Span(0, 5)}
    assert sorted(messages(s.records("t", "k0", 0))) == ["m0", "m2", "m4", "m6", "m8"]
    got = []
    batches = MicroBatches(s, "t", "reader", lambda df, n: got.append((n, df.count())))
    assert batches.available() == 1 and got == [(0, 10)]
    s.append("t", "k9", spark.createDataFrame([(1, "z")], "time long, message string"))
    assert MicroBatches(s, "t", "reader", lambda df, n: got.append((n, df.count()))).available() == 1 and got[-1] == (1, 1)


def test_http(spark, make):
    api = Api(make())
    table = pa.table({"time": pa.array([1, 2, 3]), "inputs": pa.array(["a", None, "c"])})
    head = {"Content-Type": formats.ARROW}
    assert api.call("POST", "/topic/t/partition/p", formats.arrow_file(table), head)[1] == b'{"span": {"start": 0, "end": 3}}'
    status, body, headers = api.call("POST", "/topic/t/records?page_size=2&dataset=inputs", b"{}")
    assert status == 200 and json.loads(body) == [{"inputs": "a"}, {"inputs": None}]
    assert json.loads(headers["x-iteration-status"]) == {"status": "RecordLimited", "next": {"p": 2}}
    status, body, _ = api.call("GET", "/topic/t/partition/p/records?start=1", headers={"accept": formats.ARROW})
    got = pa.ipc.open_file(body).read_all()
    assert got["time"].to_pylist() == [2, 3] and json.loads(got.schema.metadata[b"span"]) == {"start": 1, "end": 3}
    assert api.call("POST", "/topic/t/records", b'{"p":3}')[1:] == (b"[]", {"content-type": formats.JSON})
    assert json.loads(api.call("GET", "/topics")[1]) == {"topics": [{"name": "t"}]}
    assert json.loads(api.call("GET", "/topic/t")[1])["partitions"] == {"p": {"start": 0, "end": 3}}
    assert json.loads(api.call("GET", "/info")[1])["topics"][0]["partitions"][0]["records"] == {"start": 0, "end": 3} and api.call("GET", "/ok")[0] == 200
    for method, path, body, h, want in (
        ("GET", "/topic/t/partition/p/records", b"", {}, 400), ("POST", "/topic/t/records?order=desc&time.start=1970-01-01T00:00:00Z&time.end=1970-01-01T00:00:00Z", b"", {}, 400),
        ("POST", "/topic/t/partition/p", b"", {}, 400), ("POST", "/topic/t/partition/p", b"junk", head, 400), ("POST", "/topic/t/records", b"", {"accept": "text/html"}, 400), ("GET", "/nope", b"", {}, 404),
        *(("POST", "/topic/t/records", c, {}, 400) for c in (b"{", b"[1]", b'{"p":"x"}', b'{"p":true}', b'{"p":-1}', b"\xff")),
    ):
        assert api.call(method, path, body, h)[0] == want
    api.store.config.max_append_bytes = 10
    refused = api.call("POST", "/topic/t/partition/p", formats.arrow_file(table), head)
    assert refused[0] == 413 and refused[2]["x-max-request-size"] == "10"
    api.heartbeat -= 100
    assert api.call("GET", "/ok")[0] == 500
    Upkeep(api.store, api.beat).once()
    assert api.call("GET", "/ok")[0] == 200
    text = api.call("GET", "/metrics")[1].decode()
    assert 'slog_thread_records_written{partition="p",topic="t"} 3' in text and "# TYPE stored_size_bytes gauge" in text
    info_ = json.loads(api.call("GET", "/info")[1])
    assert info_["pending"] and info_["retention_stats"]["files_checked"] == 0
    api.reconciler.run()
    info_ = json.loads(api.call("GET", "/info")[1])
    assert not info_["pending"] and info_["retention_stats"]["files_checked"] == 1 and info_["active_segments"][0]["delta"] == 0
    api.store.iterate = None
    assert api.call("POST", "/topic/t/records", b"{}")[0] == 500


def test_server_beats_and_closes(spark, make):
    s = make()
    s.config.checkpoint_interval_s = 0.05
    s.append("t", "p", legacy(spark, (1, "a")))
    server = serve(s, "127.0.0.1:0")
    server.api.heartbeat -= 100
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        end = time.monotonic() + 20
        while time.monotonic() < end and (server.api.call("GET", "/ok")[0] != 200 or server.api.reconciler.last is None):
            time.sleep(0.05)
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/topics") as r:
            assert json.load(r) == {"topics": [{"name": "t"}]}
        assert server.api.call("GET", "/ok")[0] == 200 and s.metrics.get("partition_segments", partition="p", topic="t") == 1
        assert s.metrics.get("reconcile_last_pass") > 0
    finally:
        server.shutdown()
        server.server_close()
    thread.join(5)
    assert not thread.is_alive()


def test_drains_plan_from_the_manifest_alone(spark, make):
    s = make()
    rows = spark.range(40).selectExpr("id as time", "concat('m', id) as message", "cast(id % 2 as string) as k")
    s.ingest("t", rows, "k", ["time"], 5, drop_key=True)
    s._chunks = None
    page = s.iterate_all("t", {"0": 7}, keep=True, ordered=False)
    plan = page.df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters" in plan
    assert page.rows == page.df.count() == 33 and page.next == {"0": 20, "1": 20}
    when = TimeRange(10, 29)
    part = s.iterate_all("t", {"0": 7}, time=when)
    assert part.rows == 18 and sorted(messages(part)) == sorted(f"m{i}" for i in range(10, 30) if i % 2 or i >= 14)


def test_log_holds_changes_and_snapshots(spark, make, monkeypatch):
    monkeypatch.setattr("tidelog.sources.manifest.SNAPSHOT", 3)
    s = make()
    for k in range(7):
        s.append("t", "p", legacy(spark, (k, "a")))
    logged = [json.loads(s.files.read(f"_log/{n}")) for n in s.files.names("_log")]
    assert [len(x["extend"]) + len(x["add"]) for x in logged] == [1] * 7 and all(len(g["paths"]) == 1 for x in logged for g in x["extend"] + x["add"])
    assert s.files.names("_snapshots") == [f"{3:020d}.json", f"{6:020d}.json"]
    for n in range(6):
        s.files.delete(f"_log/{n:020d}.json")
    again = Store(spark, s.files.root)
    assert again.manifest.all() == s.manifest.all() and again.manifest.txns == s.manifest.txns and again.manifest.ends == s.manifest.ends
    assert again.append("t", "p", legacy(spark, (9, "b"))) == Span(7, 8)


def test_removed_segments_leave_no_files(spark, make):
    s = make()
    s.ingest("t", spark.range(20).selectExpr("id as time", "'x' as message", "'p' as k"), "k", ["time"], 5, drop_key=True)
    gone = s.manifest.of("t", "p")[:2]
    s.manifest.commit(remove=gone)  # a crash before the files go
    assert s.repair() == sorted(p for g in gone for p in g.paths)
    s.config.retain = Retain(max_segment_count=0)
    retention.retain_partitions(s)
    assert s.files.names("data") == []


def test_batches():
    table = pa.table({"time": list(range(100)), "x": ["y" * 20] * 100})
    parts = batch.reshape(table, 1000)
    assert pa.concat_tables(parts).equals(table) and all(p.nbytes <= 1000 for p in parts)
    assert batch.reshape(table.slice(0, 1).combine_chunks(), 5) == []
    sent = []

    def send(body):
        if len(body) > 2500:
            raise PayloadTooLarge(len(body), 2500)
        sent.append(pa.ipc.open_file(body).read_all())

    batch.Upload(send, 1 << 20).upload(table)
    assert pa.concat_tables(sent).equals(table) and len(sent) > 1
    with pytest.raises(CannotReshape):
        batch.Upload(send, 10).upload(table)
    got = []
    c = batch.Collator(lambda k, t: got.append((k, t.num_rows)), max_bytes=1 << 20)
    for k in "aab":
        c.send(k, table)
    c.close()
    assert sum(n for _, n in got) == 300 and not c.errors


def test_estimates(spark):
    from tidelog.functions import sizes

    df = spark.createDataFrame([(1, 2.0, "abc", [1.0, 2.0], (3, "é"))], "time long, d double, s string, a array<float>, t struct<x int, y string>")
    assert df.select(sizes.row_size(df.schema, index=False)).first()[0] == 8 + 8 + 3 + 8 + 4 + 2
    assert df.select(sizes.row_size(T.StructType([*df.schema.fields, T.StructField("b", T.BooleanType())]))).first()[0] == 0
    assert sizes.is_variable(T.StringType()) and not sizes.is_variable(T.LongType())


def test_cli(spark, make, tmp_path, capsys):
    from tidelog.cli import main

    s = make()
    with open(tmp_path / "f.arrow", "wb") as f:
        f.write(formats.arrow_file(pa.table({"time": [1, 2], "v": [3, 4]})))
    run = lambda *a: main(["--root", s.files.root, *a], spark)
    run("append", "t", "p", str(tmp_path / "f.arrow"))
    run("topics")
    run("partitions", "t")
    assert capsys.readouterr().out.split("\n")[:3] == ["[0, 2]", "t", '{"p": [0, 2]}']
    main(["--root", s.files.root, "--output", f"arrow={tmp_path / 'out'}", "records", "t", "p", "--start", "1"], spark)
    assert pa.ipc.open_file(open(tmp_path / "out", "rb")).read_all()["v"].to_pylist() == [4]


def test_no_partition_is_gathered(spark, make):
    s = make()
    rows = spark.range(60_000).selectExpr("id as time", "repeat('x', 20) as message", "'p' as k")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert s.ingest("t", rows, "k", ["time"], 50_000, drop_key=True) == {"p": Span(0, 60_000)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # a task writes at most one file of a segment, so the largest file tells how many rows went through one
    files = spark.read.parquet(*[s.files.full(x.paths[0]) for x in s.manifest.of("t", "p")]).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] <= 30_000
    assert s.iterate_all("t", keep=True).df.where("time <> __index").count() == 0


def test_nulls_and_blanks_share_a_partition(spark, make):
    s = make()
    rows = spark.range(40).selectExpr("id as time", "'x' as message", "nullif(if(id % 3 = 0, '', 'n'), 'n') as k")
    assert s.ingest("t", rows, "k", ["time"], 7, drop_key=True) == {"": Span(0, 40)}
    got = s.iterate_all("t", keep=True).df.select("__index", "time").collect()
    assert [r[0] for r in got] == list(range(40)) and sorted(r[1] for r in got) == list(range(40))


def test_ranges_grow_with_the_rows(spark, make, monkeypatch):
    from tidelog.sources import store as stores

    monkeypatch.setattr(stores, "RANGE_BYTES", 1 << 16, raising=False)
    s = make()
    rows = spark.range(30_000).selectExpr("id as time", "repeat('x', 20) as message", "'p' as k")
    s.ingest("t", rows, "k", ["time"], 50_000, drop_key=True)
    # 92 bytes a row make 43 ranges, though the session has 4 shuffle partitions
    files = spark.read.parquet(s.files.full(s.manifest.of("t", "p")[0].paths[0])).groupBy(F.input_file_name()).count()
    assert files.count() > 30 and files.agg(F.max("count")).first()[0] < 3000
    s.ingest("few", rows.limit(100), "k", ["time"], 50_000, drop_key=True)
    assert len([n for n in s.files.names(s.manifest.of("few", "p")[0].paths[0]) if n.endswith(".parquet")]) == 1
    assert s.iterate_all("t", keep=True).df.where("time <> __index").count() == 0
