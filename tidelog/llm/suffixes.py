"""Removal of byte strings that repeat across documents, by suffix arrays.

Every ``length``-byte string of a document is filed under one of its inner strings of ``ANCHOR`` bytes, the one with the least hash, so equal
strings are filed alike wherever they stand. Neighbouring strings under one anchor are kept as one piece of text.

1. Each block of documents lists its anchors' hashes; buckets of hashes tell which occur in two documents or more.
2. Pieces under such an anchor go to the shard of their anchor, each different one once for a block, with the
   least document it stands in.
3. A shard holds all strings that may be equal. It sorts the suffixes of its different pieces by external induction
   (``induced``): neighbours with a common prefix of ``length`` are equal strings, and the least document of such a run is the first that has the string.
4. Back in its block, each document drops the bytes covered by strings whose first document is a smaller one.

Nothing here grows beyond a block, bucket or shard, whose numbers grow with the data; texts are shuffled once. A passage that very many documents
share is one piece of each block, and an anchor that very many share is one hash of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sheltered, tasks, trim, unsheltered
from .induced import descending

ANCHOR = 24
#: Text of a block and of a bucket or shard, in bytes, on average.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
#: Text handled at a time, small enough for a core's cache.
STEP = 1 << 17
#: Memory for the queues of a shard's sort.
QUEUE_BYTES = 1 << 27
LAST = 2**63 - 1

_M = np.uint64(0x9E3779B97F4A7C15)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_M), k, 2**64))


_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, np.uint64)


def anchor_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` (24) bytes from each place."""
    h = _BYTES[b]
    sizes = {1: h}
    for k in (1, 2, 4, 8):
        h = h[:-k] * _power(k) + h[k:]
        sizes[2 * k] = h
    h = sizes[16][:-8] * _power(8) + sizes[8][16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Runs:
    """Pieces of documents laid end to end: of each the place of its first string, how many strings, its anchor's hash and place, its document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        window = length - ANCHOR + 1
        parts: list[tuple] = []
        begins = np.concatenate(([0], ends[:-1]))
        # documents together up to STEP bytes, longer ones in overlapping steps
        d, n = 0, len(ends)
        while d < n:
            e = int(np.searchsorted(ends, begins[d] + STEP, "right"))
            e = max(e, d + 1)
            lo, hi = int(begins[d]), int(ends[e - 1])
            for at in range(lo, max(hi - length + 1, lo + 1), STEP):
                stop = min(hi, at + STEP + length - 1)
                if stop - at < length:
                    break
                parts.append(self._some(data[at:stop], at, begins[d:e], ends[d:e], d, length, window))
            d = e
        self.first, self.count, self.hash, self.anchor, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))

    def _some(self, b: np.ndarray, at: int, begins: np.ndarray, ends: np.ndarray, d0: int, length: int, window: int) -> tuple:
        h = anchor_hashes(b)
        m = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
        sizes = {1: m}
        k = 1
        while 2 * k <= window:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < window:
            m = np.minimum(m[: len(m) - (window - k)], m[window - k :])
        del sizes
        a = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        place = np.arange(len(a)) + at
        doc = np.searchsorted(ends, place, "right")
        ok = place + length <= ends[np.minimum(doc, len(ends) - 1)]
        a, place, doc = a[ok], place[ok], doc[ok]
        if not len(a):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (place[1:] != place[:-1] + 1))))
        count = np.diff(np.append(new, len(a)))
        return place[new], count, h[a[new]], a[new] + at, doc[new] + d0


class Block:
    """A block's documents in order of (id, hash), their runs, and the distinct hashes by bucket."""

    def __init__(self, t: pa.Table, length: int, buckets: int):
        ids, sha = t.column("ord").to_numpy(), np.array(t.column("sha").to_pylist(), object)
        order = np.lexsort((sha, ids)) if len(ids) else np.zeros(0, np.int64)
        texts = t.column("text").to_pylist()
        self.ids, self.sha = ids[order], sha[order]
        self.texts = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in self.texts]).astype(np.int64)
        self.runs = Runs(self.data, self.ends, length)
        # distinct (hash, document), then distinct hashes and whether two documents here have them
        pair = np.lexsort((self.runs.doc, self.runs.hash))
        h, d = self.runs.hash[pair], self.runs.doc[pair]
        fresh = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        other = np.concatenate(([False], (h[1:] == h[:-1]) & (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
        number = np.cumsum(fresh) - 1
        self.hashes = h[fresh]
        self.shared = np.bincount(number, other, minlength=len(self.hashes)) > 0
        self.hash_of = np.empty(len(h), np.int64)
        self.hash_of[pair] = number
        bucket = (self.hashes % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.bucket_ends = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))

    def bucket(self, k: int) -> np.ndarray:
        return self.by_bucket[self.bucket_ends[k] : self.bucket_ends[k + 1]]


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    types = [{"blob": pa.binary(), "kind": pa.bool_()}.get(n, pa.int32()) for n in names]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _zip(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a.tobytes()) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unzip(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


class Pieces:
    """The distinct pieces under shared anchors of a block: by run its piece, of each piece a first run and the least and largest document."""

    def __init__(self, block: Block, shared: np.ndarray, length: int):
        r = block.runs
        self.run = np.flatnonzero(shared[block.hash_of]) if len(r.hash) else np.zeros(0, np.int64)
        size = r.count[self.run] + length - 1
        # equal pieces: same anchor, same place of it, same length and the same bytes
        code = _spans_hash(block.data, r.first[self.run], size)
        order = np.lexsort((self.run, code, size, r.anchor[self.run] - r.first[self.run], r.hash[self.run]))
        s = self.run[order]
        keys = [r.hash[s], (r.anchor - r.first)[s], size[order], code[order]]
        fresh = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(s) else np.zeros(0, bool)
        number = np.cumsum(fresh) - 1
        self.of_run = np.empty(len(s), np.int64)
        self.of_run[order] = number
        self.first = s[fresh]
        at = np.flatnonzero(fresh)
        ids = block.ids[r.doc[s]] if len(s) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(ids, at) if len(at) else ids
        self.most = np.maximum.reduceat(ids, at) if len(at) else ids


def _spans_hash(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[first : first + size]``, by sums of powers."""
    out = np.zeros(len(first), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        live = size > k
        out[live] = out[live] * np.uint64(0xC2B2AE3D27D4EB4F) + _BYTES[data[first[live] + k]]
    return out


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``data[first : first + size]`` for each of the spans, end to end."""
    if not len(first):
        return np.zeros(0, data.dtype)
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))]


def first_documents(text: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each string of each piece (pieces end to end in ``text``) the least document that has it.

    ``owner`` is the least document of each piece. Runs of the suffix array of the pieces with a common prefix of ``length`` are equal strings.
    """
    ends = np.cumsum(size)
    # a zero ends each piece, so that no string runs on into the next
    apart = np.zeros(len(text) + len(size), np.uint16)
    place = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)
    apart[place] = text.astype(np.uint16) + 1
    starts = ends - size + np.arange(len(size))
    piece = np.repeat(np.arange(len(size)), size + 1)
    first = np.full(len(apart), LAST)
    run_at, run_least = np.zeros(0, np.int64), LAST
    for suffix, lcp in descending(apart, 257, length, QUEUE_BYTES):
        ids = owner[piece[suffix]]
        new = np.flatnonzero(lcp < length)
        # strings before the first new run belong to the run that is open
        head = int(new[0]) if len(new) else len(suffix)
        run_at, run_least = np.concatenate([run_at, suffix[:head]]), min(run_least, int(ids[:head].min()) if head else LAST)
        if len(new):
            first[run_at] = run_least
            least = np.minimum.reduceat(ids[head:], new - head)
            first[suffix[head:]] = np.repeat(least, np.diff(np.append(new, len(suffix))))
            run_at, run_least = suffix[new[-1] :], int(least[-1])
    first[run_at] = run_least
    count = size - length + 1
    return first[gather(np.arange(len(apart)), starts, count)]


def deduplicate(docs: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """Drop from each text every byte covered by a ``length``-byte string that also starts in a document with a smaller ``doc_id``.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``; with ``texts`` all columns of ``docs`` instead, ``text`` being
    what is left (broken characters at the edges of removed spans are dropped) and ``n_chars``, if there is one, its length.

    Texts are compared as UTF-8 bytes, as given: what one document loses still counts as occurring in it. Texts alike are looked at once, in their
    smallest document; the others lose all, if they have ``length`` bytes.

    Defined cases: null text is empty, and stays null with ``texts``; texts shorter than ``length`` lose nothing; a null ``doc_id`` counts as the
    largest; rows with equal ids do not precede each other, so repeated rows all keep what the first keeps; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs, names = sheltered(docs, ("doc_id", "text", "n_chars"))
    d = docs.withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    heads = d.groupBy("_sha").agg(F.min("_ord").alias("_first"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = tasks(spark)
    blocks, buckets = max(n, -(-size // BLOCK_BYTES)), max(n, -(-size // SHARD_BYTES))
    one = d.where(F.octet_length("text") >= length).select(F.pmod(F.xxhash64("_ord", "_sha"), F.lit(blocks)).cast("int").alias("block"), F.col("_ord").alias("ord"), F.col("_sha").alias("sha"), "text")
    one = one.repartition(n, "block")

    def block_of(t: pa.Table) -> tuple[pa.Table, Block]:
        trim()  # what the block before took
        # of copies in a block the smallest
        order = t.sort_by([("sha", "ascending"), ("ord", "ascending")])
        sha = order.column("sha").to_pylist()
        keep = [i for i in range(len(sha)) if i == 0 or sha[i] != sha[i - 1]]
        t = order.take(pa.array(keep, pa.int64()))
        return t, Block(t, length, buckets)

    def hashes(t: pa.Table) -> pa.Table:
        number = t.column("block")[0].as_py() if t.num_rows else 0
        _, b = block_of(t)
        rows = []
        for k in range(buckets):
            at = b.bucket(k)
            if len(at):
                rows.append((k, number, ((b.hashes[at] >> np.uint64(32)).astype("<u4")).tobytes() + np.packbits(b.shared[at]).tobytes()))
        return _rows(rows, ["bucket", "block", "blob"])

    def shared(t: pa.Table) -> pa.Table:
        trim()
        bucket, who = t.column("bucket")[0].as_py(), t.column("block").to_pylist()
        blobs = t.column("blob").to_pylist()
        # four bytes and a bit for each hash
        sizes = np.array([8 * len(x) // 33 for x in blobs])
        h = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(blobs, sizes, strict=True)])
        seen = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * n), count=n) for x, n in zip(blobs, sizes, strict=True)]).astype(bool)
        order = np.argsort(h, kind="stable")
        s = h[order]
        again = np.zeros(len(s), bool)
        again[1:] |= s[1:] == s[:-1]
        again[:-1] |= s[1:] == s[:-1]
        seen[order] |= again
        parts = np.split(seen, np.cumsum(sizes)[:-1])
        return _rows([(k, bucket, np.packbits(p).tobytes()) for k, p in zip(who, parts, strict=True) if p.any()], ["block", "bucket", "blob"])

    def known(b: Block, flags: pa.Table) -> np.ndarray:
        out = b.shared.copy()
        for k, blob in zip(flags.column("bucket").to_pylist(), flags.column("blob").to_pylist(), strict=True):
            at = b.bucket(k)
            out[at] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=len(at)).astype(bool)
        return out

    def pieces(left: pa.Table, flags: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([], ["bucket", "block", "kind", "blob"])
        number = left.column("block")[0].as_py()
        _, b = block_of(left)
        marks = known(b, flags)
        # what is shared goes along, for the block's last step
        p, rows = Pieces(b, marks, length), [(number % buckets, number, False, np.packbits(marks).tobytes())]
        r, size = b.runs, b.runs.count[p.first] + length - 1
        bucket = (r.hash[p.first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(at):
                f = p.first[at]
                rows.append((int(bucket[at[0]]), number, True, _zip(r.hash[f], (r.anchor - r.first)[f].astype(np.uint8), size[at].astype(np.uint8), p.least[at], p.most[at], gather(b.data, r.first[f], size[at]))))
        return _rows(rows, ["bucket", "block", "kind", "blob"])

    def sorted_out(t: pa.Table) -> pa.Table:
        trim()
        bucket = t.column("bucket")[0].as_py()
        rows = [(r["block"], bucket, False, r["blob"]) for r in t.filter(pa.compute.invert(t.column("kind"))).to_pylist()]
        t = t.filter(t.column("kind"))
        who = t.column("block").to_pylist()
        if not who:
            return _rows(rows, ["block", "bucket", "kind", "blob"])
        got = [_unzip(x, np.uint64, np.uint8, np.uint8, np.int64, np.int64, np.uint8) for x in t.column("blob").to_pylist()]
        number = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        h, anchor, size, least, most = (np.concatenate([g[i] for g in got]).astype(k) for i, k in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64)))
        text = np.concatenate([g[5] for g in got])
        begin = np.cumsum(size) - size
        code = _spans_hash(text, begin, size)
        order = np.lexsort((code, size, anchor, h))
        same = np.concatenate(([False], np.all([k[order][1:] == k[order][:-1] for k in (h, anchor, size, code)], axis=0)))
        at = np.flatnonzero(~same)
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(~same) - 1
        head, owner = order[at], np.minimum.reduceat(least[order], at)
        # strings of different pieces can only be equal under one anchor
        hh = h[head]
        among = np.zeros(len(hh), bool)
        among[1:] |= hh[1:] == hh[:-1]
        among[:-1] |= hh[1:] == hh[:-1]
        count = size[head] - length + 1
        ends = np.cumsum(count)
        first = np.repeat(owner, count)
        pick = np.flatnonzero(among)
        if len(pick):
            first[gather(np.arange(len(first)), (ends - count)[pick], count[pick])] = first_documents(gather(text, begin[head[pick]], size[head[pick]]), size[head[pick]], owner[pick], length)
        # ranges of strings with one first document, by piece
        cut = np.concatenate(([True], first[1:] != first[:-1]))
        cut[(ends - count)] = True
        lo = np.flatnonzero(cut)
        of = np.searchsorted(ends, lo, "right")
        span, value = np.diff(np.append(lo, len(first))), first[lo]
        offset = lo - (ends - count)[of]
        by_kind = np.searchsorted(of, np.arange(len(head) + 1))
        for k, block in enumerate(who):
            mine = np.flatnonzero(number == k)
            n = by_kind[kind[mine] + 1] - by_kind[kind[mine]]
            at = gather(np.arange(len(of)), by_kind[kind[mine]], n)
            index = np.repeat(np.arange(len(mine)), n)
            use = value[at] < most[mine][index]
            at, index = at[use], index[use]
            if len(at):
                rows.append((block, bucket, True, _zip(index.astype(np.int32), offset[at].astype(np.uint8), span[at].astype(np.uint8), value[at])))
        return _rows(rows, ["block", "bucket", "kind", "blob"])

    def removed(left: pa.Table, flags: pa.Table, found: pa.Table) -> Iterator[tuple]:
        t, b = block_of(left)
        marks = np.unpackbits(np.frombuffer(flags.column("blob")[0].as_py(), np.uint8), count=len(b.hashes)).astype(bool)
        p = Pieces(b, marks, length)
        r = b.runs
        bucket = (r.hash[p.first] % np.uint64(buckets)).astype(np.int64) if len(p.first) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        mark = np.zeros(len(b.data) + 1, np.int32)
        by_piece = np.argsort(p.of_run, kind="stable")
        run_ends = np.searchsorted(p.of_run[by_piece], np.arange(len(p.first) + 1))
        for k, blob in zip(found.column("bucket").to_pylist(), found.column("blob").to_pylist(), strict=True):
            index, offset, span, value = _unzip(blob, np.int32, np.uint8, np.uint8, np.int64)
            piece = order[edges[k] : edges[k + 1]][index]
            n = run_ends[piece + 1] - run_ends[piece]
            run = p.run[by_piece[gather(np.arange(len(by_piece)), run_ends[piece], n)]]
            line = np.repeat(np.arange(len(piece)), n)
            later = value[line] < b.ids[r.doc[run]]
            start = (r.first[run] + offset[line])[later]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + span[line][later].astype(np.int64) + length - 1, -1)
        gone = np.cumsum(mark[:-1]) > 0
        begin = 0
        for i, end in enumerate(b.ends.tolist()):
            yield int(b.ids[i]), b.sha[i], b.texts[i], gone[begin:end]
            begin = end

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(6)]
        if left.num_rows:
            flags, found = right.filter(pa.compute.invert(right.column("kind"))), right.filter(right.column("kind"))
            for ord_, sha, text, gone in removed(left, flags, found):
                keep = np.frombuffer(text, np.uint8)[~gone].tobytes()
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)
                row = (ord_, sha, int(gone.sum()), len(edge), hashlib.sha256(keep).hexdigest(), keep.decode("utf-8", "ignore") if texts else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["ord", "sha", "n_removed", "n_spans", "kept", "left"])

    by_block = one.groupBy("block")
    blob, kinds = "bucket int, block int, blob binary", "bucket int, block int, kind boolean, blob binary"
    flags = by_block.applyInArrow(hashes, blob).groupBy("bucket").applyInArrow(shared, "block int, bucket int, blob binary")
    out = by_block.cogroup(flags.groupBy("block")).applyInArrow(pieces, kinds)
    found = out.groupBy("bucket").applyInArrow(sorted_out, "block int, bucket int, kind boolean, blob binary")
    done = by_block.cogroup(found.groupBy("block")).applyInArrow(finish, "ord long, sha string, n_removed long, n_spans long, kept string, left string")

    # copies of a smaller document lose all; texts that are not short come back from their blocks
    whole = F.octet_length("text") >= length
    light = d.select(*[F.when(whole, None).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in d.columns], whole.alias("_whole"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_bytes"))
    out = light.join(heads.withColumnRenamed("_sha", "_h"), F.col("_sha") == F.col("_h"))
    done = done.toDF("_d_ord", "_d_sha", "_d_removed", "_d_spans", "_d_kept", "_d_left")
    out = out.join(done, (out["_sha"] == done["_d_sha"]) & (out["_ord"] == done["_d_ord"]), "left")
    copy = (F.col("_ord") > F.col("_first")) & (F.col("_bytes") >= length)
    if texts:
        out = out.withColumn("text", F.when(copy, "").when(F.col("_whole"), F.col("_d_left")).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
        return unsheltered(out.select(*docs.columns), names)
    return out.select(
        "doc_id", F.col("_bytes").alias("n_bytes"),
        F.when(copy, F.col("_bytes")).otherwise(F.coalesce("_d_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("_d_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_d_kept", "_sha")).alias("kept_sha256"))
