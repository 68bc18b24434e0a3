"""The page planner against a row-by-row model, and the types around it. No Spark."""

import random

import pytest

from tidelog.config import Config
from tidelog.plans.paging import Chunk, plan_page, visiting_order
from tidelog.types import InvalidQuery, Order, RowLimit, Selector, Span, Status, TimeRange, selected


def model(topic, cursor, order, max_rows, max_bytes):
    """One chunk at a time, as the log is described: returns rows, status and the moved cursor. ``topic``: by partition chunks (schema, first offset, row sizes)."""
    desc = order is Order.DESC
    spans = {p: (c[0][1], c[-1][1] + len(c[-1][2])) for p, c in topic.items() if c}
    visits = sorted(((cursor.get(p, s[1] if desc else s[0]), p) for p, s in spans.items() if not (desc and cursor) or p in cursor), reverse=desc)
    rows, schema, stop, broke, moved = [], None, None, False, {}
    for pos, p in visits:
        if stop:
            break
        for kind, first, sizes in topic[p][::-1] if desc else topic[p]:
            own = [(o, b) for o, b in zip(range(first, first + len(sizes)), sizes, strict=True) if (o < pos if desc else o >= pos)]
            if desc:
                own = own[::-1]
            if not own:
                continue
            if schema is None:
                schema = kind
            if kind != schema:
                broke = True
                break
            total = sum(b for _, b in own)
            if len(own) >= max_rows:
                own, stop = own[:max_rows], Status.RECORD_LIMITED
            elif total >= max_bytes:
                stop = Status.BYTE_LIMITED
            max_rows, max_bytes = max_rows - len(own), max_bytes - total
            rows += [(p, o) for o, _ in own]
            if own:
                moved[p] = own[-1][0] if desc else own[-1][0] + 1
            if stop:
                break
    return rows, Status.SCHEMA_CHANGE if broke else stop or Status.ALL, moved


def chunks_of(topic, order):
    def chunks(p, pos):
        for kind, first, sizes in topic[p][::-1] if order is Order.DESC else topic[p]:
            end = first + len(sizes)
            lo, hi = (first, min(end, pos)) if order is Order.DESC else (max(first, pos), end)
            if lo < hi:
                total = sum(sizes[lo - first : hi - first])
                yield Chunk(kind, *((hi - 1, lo) if order is Order.DESC else (lo, hi - 1)), hi - lo, total)

    return chunks


@pytest.mark.parametrize("order", list(Order))
def test_pages_match_the_model_and_lose_nothing(order):
    rng = random.Random(1)
    for _ in range(400):
        topic = {}
        for p in range(rng.randint(1, 4)):
            at, own = 0, []
            for _ in range(rng.randint(0, 5)):
                sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 6))]
                own.append((rng.choice("aab"), at, sizes))
                at += len(sizes)
            topic[f"p{p}"] = own
        spans = {p: Span(c[0][1], c[-1][1] + len(c[-1][2])) for p, c in topic.items() if c}
        cursor, seen = {}, []
        limit = RowLimit(rng.randint(1, 12), rng.randint(1, 200))
        for _ in range(200):
            visits = visiting_order(spans, cursor, order, lambda p: True)
            plan, moved = plan_page(visits, chunks_of(topic, order), limit, order)
            rows, status, want = model(topic, cursor, order, limit.max_records, limit.max_bytes)
            assert (plan.status, plan.rows, moved) == (status, len(rows), want)
            got = [(part.partition, o) for part in plan.parts for o in (range(part.hi, part.lo - 1, -1) if order is Order.DESC else range(part.lo, part.hi + 1))]
            assert got == rows
            if not rows:
                break
            seen += rows
            cursor = cursor | {p: pos for pos, p in visits} | moved
        assert sorted(seen) == sorted((p, o) for p, s in spans.items() for o in range(s.start, s.end))


def test_empty_page_of_no_rows():
    plan, moved = plan_page([(0, "p")], lambda p, s: [Chunk("a", 0, 4, 5, 50)], RowLimit(0, 10))
    assert (plan.status, plan.rows, moved) == (Status.RECORD_LIMITED, 0, {})


def test_selectors():
    assert selected("click", None) and not selected("click", [])
    assert selected("click", ["regex:li"]) and not selected("click", ["regex:^li", "clic"])
    assert not selected("click", ["regex:("]) and Selector("regex:(").matches("regex:(")
    assert Selector("regex:(?=c)").pattern is None and Selector("regex:" + "a" * 9000).pattern is None
    assert not selected("uncaptured-partition", ["regex:partition-.*"])


def test_time_ranges():
    r = TimeRange.parse("1970-01-01T00:00:00.0004Z", "1970-01-01T00:00:01.9999+00:00")
    assert (r.start, r.end) == (1, 1999)
    for a, b in (("yesterday", "1970-01-01T00:00:00Z"), ("1970-01-01T00:00:00Z", None), ("1970-01-01T00:00:00", "1970-01-01T00:00:00Z")):
        with pytest.raises(InvalidQuery):
            TimeRange.parse(a, b)
    with pytest.raises(InvalidQuery):
        Order.parse("up")
    assert Order.parse("DESC") is Order.DESC and Order.parse(None) is Order.ASC


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("chunk_rows = 7\n[roll]\nmax_rows = 5\n")
    c = Config.load(str(tmp_path / "c.toml"), env={"TIDELOG__ROLL__MAX_BYTES": "9", "OTHER": "1"})
    assert (c.chunk_rows, c.roll.max_rows, c.roll.max_bytes) == (7, 5, 9)
    with pytest.raises(ValueError):
        Config.load(env={"TIDELOG__NOPE": "1"})
