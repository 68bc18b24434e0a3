"""Embedding near-duplicates by sorted projection passes, with an exact check of what they leave apart.

Each pass sorts all vectors lexicographically by concatenated random hashes, cuts the order into blocks and compares every vector with those of its own and
of the neighbouring blocks. A hash is the axis, with sign, nearest to the randomly turned vector, taken from the centre of all vectors of its length.
Pairs that really are as near as asked are links; links of all passes are united into components.

Passes may miss pairs, so an exact check follows: the order is cut into tiles, and vectors of any two tiles are compared, if they are of different components, unless
the angles to the balls round a tile's vectors rule a link out. What is found unites the components. Nothing is taken from a sample: centres and balls come from
all vectors, and centres steer the order alone. Within a component all links are counted exactly. Vectors within half the angle of the component's
centre are all linked and counted at once; only the rest is compared, in blocks.

Scale: vectors alike are one; a pass is a shuffle by range, so a hash that very many share is spread over tasks; blocks and tiles are cut by place in the whole order,
so the partitioning makes no difference to what meets; no task emits more than one edge for each row and block. The check grows as the square of the
vectors that no ball rules out: each goes to every tile it may reach, of which there are about the root of eight times the tasks until memory bounds a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import components, cut, star, tasks

#: Passes, hashes of a pass, vectors of the blocks.
PASSES, HASHES, WINDOW = 6, 6, 256
#: Vectors of a ball, least number of a tile, bytes of a tile at most, and products of a step of the exact check.
BALL, TILE, TILE_BYTES, STEP = 512, 1024, 1 << 25, 1 << 22
#: Vectors of a component compared together.
BLOCK = 1024


def unit(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors in double precision at length 1; None for those that cannot link."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = v.as_py()
        if x and None not in x:
            a = np.array(x, float)
            top = np.abs(a).max() if np.isfinite(a).all() else 0.0
            if top > 0:
                a = a / top  # against overflow
                out.append(a / np.sqrt(a @ a))
                continue
        out.append(None)
    return out


class Order:
    """The hashes of a pass for vectors of one length, taken from their ``centre``."""

    def __init__(self, which: int, centre: np.ndarray):
        dim = len(centre)
        self.turns = [np.linalg.qr(np.random.default_rng([which, k, dim]).normal(size=(dim, dim)))[0] for k in range(HASHES + 1)]
        self.centre = centre

    def keys(self, x: np.ndarray) -> list[bytes]:
        """Concatenated hashes, two bytes each, then a finer place."""
        x, cols = x - self.centre, []
        for level in range(HASHES):
            y = x @ self.turns[level]
            at = np.abs(y).argmax(1)
            cols.append(2 * at + (y[np.arange(len(y)), at] > 0))
        fine = np.clip((x @ self.turns[HASHES][:, 0] + 1) * 32767, 0, 65535).astype(np.int64)
        return [r.tobytes() for r in np.stack([*cols, fine], 1).astype(">u2")]


def near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def met(head: np.ndarray, x: np.ndarray, ids: np.ndarray, group: list[bytes], least: float) -> list[tuple[int, int]]:
    """Stars of links between rows ``head`` and all rows; rows of different ``group`` don't meet."""
    pairs = []
    g = np.array(group)
    for name in set(group):
        some = np.flatnonzero(g == name)
        if head[some].any():
            v = np.stack([np.frombuffer(x[i], float) for i in some])
            i, j = np.nonzero(near(v[head[some]], v, least))
            i = np.flatnonzero(head[some])[i]
            apart = i != j
            if apart.any():
                root = star(len(some), zip(i[apart].tolist(), j[apart].tolist(), strict=True))
                pairs += [(int(ids[some[a]]), int(ids[some[r]])) for a, r in enumerate(root) if a != r]
    return pairs


def _sums(rows: DataFrame) -> DataFrame:
    """``comp, n, s``: number and sum of the vectors of ``rows(comp, x)``; those of a ``comp`` are of one length."""
    schema = "comp long, n long, s binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, v = held.get(c, (0, 0.0))
                held[c] = n + 1, v + np.frombuffer(x, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([v.tobytes() for _, v in held.values()], pa.binary())], ["comp", "n", "s"])

    def total(t: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, float) for x in t.column("s").to_pylist()], axis=0)
        return pa.table([t.column("comp")[:1], pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["comp", "n", "s"])

    return rows.mapInArrow(partial, schema).groupBy("comp").applyInArrow(total, schema)


def _ordered(rows: DataFrame, orders: dict[int, list[Order]], n: int) -> tuple[DataFrame, dict[int, int], dict[int, int], int]:
    """``rows(id, x, ...)`` plus ``key, part``, once for each pass, in the order of the keys; where each partition begins, its size, and the number of all."""
    shared = rows.sparkSession.sparkContext.broadcast(orders)  # some matrices for each length
    passes, names = max((len(o) for o in orders.values()), default=0), rows.columns

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).to_pylist()
            sizes = np.array([len(v) // 8 for v in raw])
            for k in range(passes):
                key = [b""] * len(raw)
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    for i, r in zip(at.tolist(), shared.value[dim][k].keys(np.stack([np.frombuffer(raw[i], float) for i in at])), strict=True):
                        key[i] = k.to_bytes(2, "big") + dim.to_bytes(4, "big") + r
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.binary())], [*names, "key"])

    schema = StructType(list(rows.schema.fields)).add("key", BinaryType())
    h = rows.mapInArrow(hashed, schema)
    h = cut(h.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")).withColumn("part", F.spark_partition_id())
    sizes = {r["part"]: r["c"] for r in h.groupBy("part").agg(F.count("*").alias("c")).collect()}  # one row a partition
    begin, total = {}, 0
    for p in sorted(sizes):
        begin[p], total = total, total + sizes[p]
    return h, begin, sizes, total


def links(classes: DataFrame, orders: dict[int, list[Order]], least: float, n: int) -> DataFrame:
    """Links ``(a, b)`` between the distinct unit vectors ``classes(id, x)`` that the passes find: a star for each set found connected."""
    block = WINDOW
    h, begin, sizes, total = _ordered(classes.select("id", "x"), orders, n)

    def out(pairs: list, edge: list[tuple]) -> pa.RecordBatch:
        none = [None] * len(pairs)
        cols = [[p[0] for p in pairs] + [e[1] for e in edge], [p[1] for p in pairs] + [None] * len(edge), none + [e[0] for e in edge], none + [e[2] for e in edge], none + [e[3] for e in edge]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["a", "b", "pair", "x", "key"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks that lie in this partition, and the rows of those that don't."""
        held: list[tuple] = []  # of ranks from `at` on
        at = start = end = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                part = b.column(3)[0].as_py()
                at = start = begin[part]
                end = start + sizes[part]
            held += zip(*[c.to_pylist() for c in b.columns[:3]], strict=True)
            last = at + len(held) == end
            while held:
                lo = at // block * block
                hi = min(lo + 2 * block, total)
                mid = min(lo + block, end)
                if not last and at + len(held) < min(hi, end):
                    break
                if lo >= start and hi <= end:
                    some = held[: hi - at]
                    yield out(met(np.arange(len(some)) < block, [r[1] for r in some], np.array([r[0] for r in some]), [r[2][:6] for r in some], least), [])
                else:
                    yield out([], [(lo // block, *r) for r in held[: min(hi, end) - at]])
                if at == start and lo > 0:  # the pair with the block before
                    yield out([], [(lo // block - 1, *r) for r in held[: mid - at]])
                held, at = held[mid - at :], mid

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, lambda r: r[2]):
            yield out(met(np.ones(len(held), bool), [r[3] for r in held], np.array([r[0] for r in held]), [r[4][:6] for r in held], least), [])

    schema = "a long, b long, pair long, x binary, key binary"
    got = cut(h.mapInArrow(compared, schema))
    edge = got.where("pair is not null").repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(joined, schema)
    every = got.where("pair is null").select("a", "b").unionByName(edge.select("a", "b"))
    return cut(every.distinct())


def _runs(batches: Iterator[pa.RecordBatch], key) -> Iterator[list[tuple]]:
    """Lists of the rows that follow each other with the same ``key``."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and key(held[0]) != key(r):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def missed(vectors: DataFrame, order: dict[int, list[Order]], least: float, n: int) -> DataFrame:
    """``a, b``: components of ``vectors(id, x, comp)`` between which there is a link; a star for each set found connected. No pair is left out.

    A vector and its partner lie within the angle of ``least`` of each other, so the vector lies within that angle and a ball's own of the centre
    of any ball that holds a partner. It goes to the tiles of all such balls, and the partner, as well, to the vector's.
    """
    h, begin, _, total = _ordered(vectors, order, n)
    most = TILE_BYTES // (8 * max(order, default=1))
    tile = max(TILE, min(most, -(-total // int(np.ceil(np.sqrt(8 * n))))))
    tile = -(-tile // BALL) * BALL
    angle = np.arccos(min(1.0, max(-1.0, least))) + 1e-6

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        at = None
        for b in batches:
            if b.num_rows:
                at = begin[b.column(4)[0].as_py()] if at is None else at
                yield at, b
                at += b.num_rows

    def ball(where: int, held: list[bytes]) -> pa.RecordBatch:
        v = np.frombuffer(b"".join(held), float).reshape(len(held), -1)
        c = v.sum(0)
        c /= max(np.linalg.norm(c), 1e-300)
        # a centre of zeros reaches all: its bound is below zero
        bound = np.cos(min(np.pi, np.arccos(np.clip((v @ c).min(), -1, 1)) + angle))
        return pa.RecordBatch.from_arrays([pa.array([where * BALL // tile], pa.int64()), pa.array([c.tobytes()], pa.binary()), pa.array([bound], pa.float64())], ["tile", "c", "bound"])

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], -1
        for at, b in places(batches):
            for k, x in enumerate(b.column(1).to_pylist(), at):
                if held and (k // BALL != now or len(x) != len(held[0])):
                    yield ball(now, held)
                    held = []
                now = k // BALL
                held.append(x)
        if held:
            yield ball(now, held)

    by: dict[tuple[int, int], list] = {}
    for r in h.mapInArrow(balls, "tile long, c binary, bound double").collect():  # one row for BALL vectors
        by.setdefault((len(r["c"]) // 8, r["tile"]), []).append(r)
    shared = vectors.sparkSession.sparkContext.broadcast({k: (np.stack([np.frombuffer(r["c"], float) for r in rs]), np.array([r["bound"] for r in rs])) for k, rs in by.items()})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in places(batches):
            raw = b.column(1).to_pylist()
            sizes, own = np.array([len(v) // 8 for v in raw]), np.arange(at, at + len(raw)) // tile
            v = {d: np.stack([np.frombuffer(raw[i], float) for i in np.flatnonzero(sizes == d)]) for d in np.unique(sizes).tolist()}
            for (dim, t), (c, bound) in shared.value.items():
                if dim in v:
                    to = np.flatnonzero(sizes == dim)[(v[dim] @ c.T >= bound).any(1)]
                    if len(to):
                        lo, hi = np.minimum(own[to], t), np.maximum(own[to], t)
                        rows = b.take(pa.array(to))
                        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(own[to]), rows.column(1), rows.column(2)], ["lo", "hi", "own", "x", "comp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, lambda r: (r[0], r[1], len(r[3]))):
            lo, hi = held[0][:2]
            own = np.array([r[2] for r in held])
            names, at = np.unique([r[4] for r in held], return_inverse=True)
            root = np.arange(len(names))
            v = np.frombuffer(b"".join(r[3] for r in held), float).reshape(len(held), -1)
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            step = max(1, STEP // max(1, len(b)))
            for k in range(0, len(a), step):
                some = a[k : k + step]
                hit = near(v[some], v[b], least)
                if hit.any():
                    hit &= root[at[some]][:, None] != root[at[b]][None, :]
                    i, j = np.nonzero(hit)
                    if len(i):
                        new = np.unique(np.stack([root[at[some[i]]], root[at[b[j]]]], 1), axis=0)
                        root = np.array(star(len(names), [*enumerate(root.tolist()), *map(tuple, new.tolist())]))
            apart = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(names[apart], pa.int64()), pa.array(names[root[apart]], pa.int64())], ["a", "b"])

    pairs = h.mapInArrow(sent, "lo long, hi long, own long, x binary, comp long").withColumn("size", F.length("x"))
    pairs = pairs.repartition(n, "lo", "hi").sortWithinPartitions("lo", "hi", "size").drop("size")
    return cut(pairs.mapInArrow(compared, "a long, b long").distinct())


def groups(classes: DataFrame, least: float, n: int) -> DataFrame:
    """``node, comp`` for each of the distinct unit vectors ``classes(id, x)`` that links with another; ``comp`` is the least node reachable."""
    centres = {r["comp"] // 8: np.frombuffer(r["s"], float) / r["n"] for r in _sums(classes.select(F.length("x").cast("long").alias("comp"), "x")).collect()}  # one for each length
    orders = {dim: [Order(k, c) for k in range(PASSES)] for dim, c in centres.items()}
    found = components(links(classes, orders, least, n)).select("node", "comp")
    v = cut(classes.select("id", "x").join(found, F.col("id") == F.col("node"), "left").select("id", "x", F.coalesce("comp", "id").alias("comp")))
    more = missed(v, {dim: o[:1] for dim, o in orders.items()}, least, n)
    if more.isEmpty():
        return found
    again = components(more).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    known = v.select("id", "comp").join(again, F.col("comp") == F.col("old"), "left").join(found.select("node"), F.col("id") == F.col("node"), "left")
    return known.where("old is not null or node is not null").select(F.col("id").alias("node"), F.coalesce("new", "comp").alias("comp"))


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    Vectors link when their cosine, in double precision, is at least ``least``; links go between all rows, whatever their other columns.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the least ``vec_id`` reachable.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even their
    copies; vectors of different lengths never link; rows repeated exactly are each other's links; a null ``vec_id`` is kept, and names a component
    only where it has no other; an empty table gives an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    n = tasks(spark)

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else v.tobytes() for v in x], pa.binary())], ["vec_id", "x"])

    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(norm, "vec_id long, x binary")
    v = v.withColumn("id", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    classes = cut(v.where("x is not null").groupBy("id", "x").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least")))
    light = cut(v.select("vec_id", "id"))
    comp = groups(classes, least, n)
    linked = cut(classes.join(comp, classes["id"] == comp["node"]).select("id", "x", "rows", "least", "comp"))
    sizes = linked.groupBy("comp").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    counts = _counted(linked.join(sizes.select("comp", "n"), "comp"), least, n)
    named = linked.select("id", "comp").join(sizes, "comp").join(counts, "id").select("id", "n_links", "component_id")
    alone = classes.select("id", "rows", "least").join(named, "id", "left")
    alone = alone.select(F.col("id").alias("_id"), F.coalesce("n_links", F.col("rows") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    ok = light.where("id is not null").join(alone, F.col("id") == F.col("_id")).select("vec_id", "n_links", "component_id")
    out = ok.unionByName(light.where("id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _core(linked: DataFrame, least: float) -> DataFrame:
    """``linked`` plus ``core``: whether a vector of a component of more than a block is within half the angle of its centre, so that all such are linked."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_core = np.sqrt((1 + least) / 2) + 1e-9
        for b in batches:
            core = []
            for x, s in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                c = None if s is None else np.frombuffer(s, float)
                core.append(c is not None and float(np.frombuffer(x, float) @ c) >= least_core * max(float(np.linalg.norm(c)), 1e-300))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(core, pa.bool_())], ["comp", "n", "id", "rows", "x", "core"])

    centres = _sums(linked.where(F.col("n") > BLOCK).select("comp", "x")).select("comp", F.col("s").alias("centre"))
    out = linked.join(centres, "comp", "left").select("comp", "n", "id", "rows", "x", "centre")
    return out.mapInArrow(marked, "comp long, n long, id long, rows long, x binary, core boolean")


def _counted(linked: DataFrame, least: float, n: int) -> DataFrame:
    """``id, n_links``: exact link counts within components ``linked(id, x, rows, comp, n)``.

    Blocks of vectors that are not core meet all blocks of their component, so a component of any size is spread over tasks.
    """
    m = cut(_core(linked, least))
    parts = m.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("rows")).otherwise(0)).alias("core_rows"), F.ceil(F.count_if("core") / BLOCK).cast("int").alias("nc"), F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("nr"))
    p = m.join(parts, "comp")
    known = p.where("core").select("id", F.col("core_rows").alias("n"))
    # blocks of the rest have numbers from 0, those of the core follow
    own = F.when(F.col("core"), F.col("nr") + F.pmod("id", F.greatest("nc", F.lit(1)).cast("long"))).otherwise(F.pmod("id", F.greatest("nr", F.lit(1)).cast("long"))).cast("int")
    p = p.where("nr > 0").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("core"), F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") + F.col("nc") - 1))))
    p = p.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "x", "rows")
    p = p.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def group(g: list[tuple]) -> pa.RecordBatch:
        own, ids = np.array([r[3] for r in g]), np.array([r[4] for r in g])
        x, rows = np.stack([np.frombuffer(r[5], float) for r in g]), np.array([r[6] for r in g], float)
        a = own == g[0][1]
        hit = near(x[a], x if g[0][1] == g[0][2] else x[~a], least)
        if g[0][1] == g[0][2]:
            np.fill_diagonal(hit, True)
            at, c = ids, hit @ rows
        else:
            at, c = np.concatenate([ids[a], ids[~a]]), np.concatenate([hit @ rows[~a], rows[a] @ hit])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(c.astype(np.int64))], ["id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, lambda r: r[:3]):
            yield group(held)

    every = known.unionByName(p.mapInArrow(run, "id long, n long"))
    return every.groupBy("id").agg((F.sum("n") - 1).cast("long").alias("n_links"))
