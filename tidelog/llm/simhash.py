"""SimHash fingerprints and near-duplicate groups by a self-join of binary tries.

The trie of a set of fingerprints is walked against itself: a pair of nodes stands for all pairs of fingerprints
below them, carries the number of differing bits of their paths, and is dropped as soon as that exceeds the error budget.
Pairs of nodes with one fingerprint each are finished at once from their remaining bits.

Distribution: every fingerprint is filed under several keys made of some of its bits, each with its own trie below. For a
small budget the keys are such that two fingerprints within it agree on at least one key (pigeonhole), so no
link is lost; keys that too many fingerprints share are split by further keys below, again without loss.

``similar_groups`` finds texts whose shingle sets are alike. It files their fingerprints under their rarest shingles, as many as make any two
texts alike share one, joins the trie below each of these keys within an error budget that texts alike keep, and verifies what it finds on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, release, sheltered, star, tasks, trim, unsheltered

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits of the three blocks that a fingerprint is cut into.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints that may share a key before it is split by keys below it.
CROWD = 4096


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``k``-word shingle, repeats included; of the whole where there are fewer words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[k - 1 :] or [len(line)]
    return np.array([h(line[a:b], 42) for a, b in zip(starts, stops, strict=False)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fp long`` for each row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(shingle_hashes(t.as_py() or "", k)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one group whose ``values`` differ in at most ``budget`` bits.

    ``values`` (unsigned 64-bit) are sorted by group and value; the first ``depth`` bits are known to agree.
    """
    n = len(values)
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    a_lo, a_hi = first, np.append(first[1:], n)
    many = a_hi - a_lo > 1
    a_lo, a_hi = a_lo[many], a_hi[many]
    b_lo, b_hi, diff = a_lo, a_hi, np.zeros(len(a_lo), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(depth, 64):
        if not len(a_lo):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        self_pair = a_lo == b_lo
        kids = (
            (a_lo, a_mid, b_lo, b_mid, diff, None),
            (a_mid, a_hi, b_mid, b_hi, diff, None),
            (a_lo, a_mid, b_mid, b_hi, diff + np.int8(1), None),
            (a_mid, a_hi, b_lo, b_mid, diff + np.int8(1), ~self_pair),  # a node with itself has this pair already
        )
        parts = []
        for al, ah, bl, bh, d, also in kids:
            ok = (al < ah) & (bl < bh) & (d <= budget) & ~((al == bl) & (ah - al == 1))
            ok = ok if also is None else ok & also
            parts.append([x[ok] for x in (al, ah, bl, bh, d)])
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if leaf.any():
            x, y = a_lo[leaf], b_lo[leaf]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            found.append((x[near], y[near]))
            a_lo, a_hi, b_lo, b_hi, diff = (v[~leaf] for v in (a_lo, a_hi, b_lo, b_hi, diff))
    # nodes left at the bottom have several equal values
    for lo, hi, at, to in zip(a_lo.tolist(), a_hi.tolist(), b_lo.tolist(), b_hi.tolist(), strict=True):
        x, y = np.repeat(np.arange(lo, hi), to - at), np.tile(np.arange(at, to), hi - lo)
        apart = x < y if lo == at else np.ones(len(x), bool)
        found.append((x[apart], y[apart]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def batched(groups: np.ndarray, most: int = 32768) -> Iterator[slice]:
    """Slices of sorted ``groups`` of about ``most`` rows that split no group."""
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, np.int64)
    begin = 0
    for s in [*starts[1:].tolist(), len(groups)]:
        if s - begin >= most or s == len(groups):
            yield slice(begin, s)
            begin = s


def _rotated(fp: F.Column, lo: int) -> F.Column:
    return fp if lo == 0 else F.shiftleft(fp, lo).bitwiseOR(F.shiftrightunsigned(fp, 64 - lo))


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fps(fp long)`` just as all pairs within ``budget`` (at most 2) bits do.

    Each task joins its tries and returns a star for each set it found connected, so there are never more edges than filed keys.
    """
    if budget > len(BLOCKS) - 1:
        raise ValueError("keys of three blocks find at most two differing bits")
    filed = None
    for i, (lo, hi) in enumerate(BLOCKS):
        turned = _rotated(F.col("fp"), lo)
        one = fps.select("fp", F.lit(i).alias("block"), F.shiftrightunsigned(turned, 64 - (hi - lo)).alias("key"), turned.alias("turned"), F.lit(hi - lo).alias("depth"))
        filed = one if filed is None else filed.unionByName(one)
    # crowded keys: of the other bits, again at least one of three blocks agrees
    crowded = filed.groupBy("block", "key").count().where(F.col("count") > CROWD).select("block", "key", F.lit(True).alias("crowded"))
    filed = filed.join(crowded, ["block", "key"], "left")
    subs = F.array(*[F.struct(F.lit(j).alias("sub"), F.pmod(F.shiftrightunsigned("turned", 28 - 14 * j), F.lit(1 << 14)).alias("subkey")) for j in range(3)])
    none = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    filed = filed.withColumn("s", F.explode(F.when(F.col("crowded"), subs).otherwise(none)))
    filed = filed.withColumn("grp", F.xxhash64("block", "key", "s.sub", "s.subkey"))
    n = tasks(fps.sparkSession)
    filed = filed.select("grp", "turned", "fp", "depth").repartition(n, "grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not cols:
            return
        grp, turned, fp, depth = (np.concatenate(x) for x in zip(*cols, strict=True))
        turned = turned.view(np.uint64)
        order = np.lexsort((turned, grp))
        grp, turned, fp, depth = grp[order], turned[order], fp[order], depth[order]
        for s in batched(grp):
            x, y = trie_pairs(turned[s], grp[s], budget, int(depth[s].min()) if s.stop > s.start else 0)
            if len(x):
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = star(len(used), zip(at[: len(x)].tolist(), at[len(x) :].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[s][used]), pa.array(fp[s][used][root])], ["a", "b"])

    return filed.mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, k: int = 3, budget: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Documents whose fingerprints differ in at most ``budget`` bits are linked; ``component_id`` is the least ``doc_id``
    reachable, itself included. Fingerprints are joined once each, however many documents share them.

    Defined cases: null, empty or blank text has fingerprint zero, linked like any other; fewer than ``k`` words are one
    shingle; a null ``doc_id`` is kept and never is a component's name unless it has no other; rows repeated exactly are kept;
    an empty table gives an empty result; other columns are left out.
    """
    f = cut(fingerprints(docs, k))
    per = f.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(per.select("fp"), budget))
    named = per.join(comp, per["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select(F.col("fp").alias("_fp"), "component_id")
    out = f.join(named, f["fp"] == named["_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts that may share a token before they are compared in blocks instead of pair by pair.
DENSE = 128
#: Texts of a block.
BLOCK = 256
#: One text in so many tells which shingles are common, and so many of these are told apart at most.
SAMPLE, COMMON = 16, 1 << 20
#: Token of texts without shingles, all of which are alike.
EMPTY = -1


#: Sets of fewer shingles are compared whatever their fingerprints.
FEW = 64
#: Share of pairs at the bound that may exceed the error budget.
LOST = 1e-9


def error_budget(similarity: float, bits: int = 64) -> int:
    """Least number of differing bits that fingerprints of sets of ``similarity`` exceed with a likelihood below ``LOST``.

    A bit differs as often as the angle between the sets' vectors is of a half turn; a twentieth is added for ties of small sets.
    """
    p = min(0.5, 1.05 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    over, d = 1.0, -1
    while over >= LOST and d < bits:
        d += 1
        over -= math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
    return d


def common_shingles(nodes: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than twice in a sample of ``nodes(node, text)``, sorted, and how often.

    They only order shingles, so that texts are filed under rare ones: no result depends on the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or "", k)) for t in b.column(0)]
            if sets:
                u, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["tok", "c"])

    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, min(SAMPLE, n // 4096)))) == 0).select("text")
    top = some.mapInArrow(run, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")).where("c > 2").orderBy(F.desc("c"), "tok").limit(COMMON).toPandas()
    tok, c = top["tok"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(tok)
    return tok[order], c[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of sorted, distinct ``shingles``, as many as make two sets of at least ``similarity`` share one."""
    n = len(shingles)
    tok, c = common
    often = np.zeros(n, np.int64)
    if len(tok):
        at = np.minimum(np.searchsorted(tok, shingles), len(tok) - 1)
        often = np.where(tok[at] == shingles, c[at], 0)
    return shingles[np.argsort(often, kind="stable")[: n - int(np.ceil(similarity * n - 1e-6)) + 1]]


def candidates(nodes: DataFrame, n: int, k: int, similarity: float) -> DataFrame:
    """Rows ``(a, b, need, times)`` of ``nodes(node, text)``: pairs and how many tokens they share in the task; ``need`` -1 for texts of a crowded token and the first of them.

    Every pair of at least ``similarity`` shares a token. Either that token is crowded, or the two meet in the trie of each token that they share, and these are at least ``need``:
    what is common to both is among these or among what the one whose prefix ends first has left.
    """
    spark = nodes.sparkSession
    budget = error_budget(similarity)
    common = spark.sparkContext.broadcast(common_shingles(nodes, n, k))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = []
            for x in b.column(0).to_pylist():
                new.append(x not in seen)
                seen.add(x)
            b = b.filter(pa.array(new, pa.bool_()))
            for lo in range(0, b.num_rows, 512):
                some = [np.unique(shingle_hashes(t.as_py() or "", k)) for t in b.column(1)[lo : lo + 512]]
                toks = [prefix(x, common.value, similarity).view(np.int64) if len(x) else np.array([EMPTY]) for x in some]
                times = [len(t) for t in toks]
                node = np.repeat(b.column(0).to_numpy()[lo : lo + 512], times)
                size = np.repeat(np.array([len(x) for x in some], np.int32), times)
                fp = np.repeat(np.array([simhash(x) for x in some], np.uint64).view(np.int64), times)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks)), pa.array(node), pa.array(size), pa.array(fp)], ["tok", "node", "size", "fp"])
        seen.clear()
        trim()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not cols:
            return
        tok, node, size, fp = (np.concatenate(x) for x in zip(*cols, strict=True))
        order = np.lexsort((node, tok))
        tok, node = tok[order], node[order]
        once = np.concatenate(([True], (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])))  # copies of a text in other tasks
        tok, node, size, fp = tok[once], node[once], size[order][once].astype(np.int64), fp[order][once].view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        of = np.diff(np.append(first, len(tok)))
        start, crowd = np.repeat(first, of), np.repeat(of > DENSE, of)
        hub = node[start]
        for i in range(0, len(tok), 1 << 20):
            c = crowd[i : i + (1 << 20)]
            a, b = node[i : i + (1 << 20)][c], hub[i : i + (1 << 20)][c]
            yield rows(a, b, np.full(len(a), -1), np.ones(len(a), np.int64))
        tok, node, size, fp = (x[~crowd] for x in (tok, node, size, fp))
        # tries of few shingles apart from the rest: both have those of nearly so few
        low, high = size <= FEW / similarity, size >= FEW
        rest = np.ceil(similarity * size - 1e-6).astype(np.int64) - 1
        held: list[tuple] = []
        for pick, most in ((np.flatnonzero(low), 64), (np.flatnonzero(high), budget)):
            pick = pick[np.lexsort((fp[pick], tok[pick]))]
            for s in batched(tok[pick]):
                x, y = trie_pairs(fp[pick[s]], tok[pick[s]], most)
                x, y = pick[s][x], pick[s][y]
                if most < 64:  # else both have met
                    apart = ~(low[x] & low[y])
                    x, y = x[apart], y[apart]
                x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                ok = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6
                x, y = x[ok], y[ok]
                need = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6).astype(np.int64) - np.maximum(rest[x], rest[y])
                held.append((node[x], node[y], np.maximum(need, 0)))
                if sum(len(h[0]) for h in held) > 1 << 20:
                    yield tallied(held)
                    held = []
        if held:
            yield tallied(held)
        del cols, tok, node, size, fp, held
        trim()

    def tallied(held: list[tuple]) -> pa.RecordBatch:
        a, b, need = (np.concatenate(z) for z in zip(*held, strict=True))
        by = np.lexsort((b, a))
        a, b, need = a[by], b[by], need[by]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        return rows(a[first], b[first], need[first], np.diff(np.append(first, len(a))))

    def rows(*x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in x], ["a", "b", "need", "times"])

    f = nodes.select("node", "text").mapInArrow(filed, "tok long, node long, size int, fp long")
    return f.repartition(4 * tasks(spark), "tok").mapInArrow(joined, "a long, b long, need long, times long")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions ``(x, y)``, ``left[x]`` and ``right[y]``, of sets of at least ``similarity``: exact, by a product of their incidence matrices."""
    size = np.array([len(s) for s in sets], np.int64)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), size)
    place = np.cumsum(often > 1) - 1  # of shingles that two have
    keep = often[at] > 1
    own, at = own[keep], place[at[keep]]
    by = np.argsort(at, kind="stable")
    own, at = own[by], at[by]
    common = np.zeros((int(left.sum()), int(right.sum())), np.float64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[own[i:j], at[i:j] - lo] = 1
        common += m[left] @ m[right].T
    hit = common >= similarity * (size[left][:, None] + size[right][None, :] - common)
    x, y = np.nonzero(hit)
    return list(zip(np.flatnonzero(left)[x].tolist(), np.flatnonzero(right)[y].tolist(), strict=True))


def _compared(blocks: DataFrame, similarity: float, n: int) -> DataFrame:
    """Links ``(a, b)`` that connect the texts of each block pair ``blocks(p, i, q, j, own, part, node, set)`` as all their links do: a star for each set connected.

    ``part`` and ``own`` name the block that a row belongs to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def group(g: list) -> pa.RecordBatch:
            block = np.array([r[4:6] == (r[0], r[1]) for r in g])
            other = np.array([r[4:6] == (r[2], r[3]) for r in g])
            root = star(len(g), block_links([np.frombuffer(r[7], "<u4") for r in g], block, other, similarity))
            hit = [(g[x][6], g[r][6]) for x, r in enumerate(root) if x != r]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64())], ["a", "b"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][:4] != r[:4]:
                    yield group(held)
                    held = []
                held.append(r)
        if held:
            yield group(held)

    g = blocks.repartition(n, "p", "i", "q", "j").sortWithinPartitions("p", "i", "q", "j")
    return g.select("p", "i", "q", "j", "part", "own", "node", "set").mapInArrow(run, "a long, b long")


def dense_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect ``members(node, comp, set)`` of each ``comp`` just as all pairs of at least ``similarity`` do.

    Texts are parted by size, as only sizes of a ratio of at least ``similarity`` can link. They are first compared within blocks dealt at random, twice,
    which joins most of a large group. Then all pairs of blocks are compared, but those of texts that are known to be in one group.
    """
    n = tasks(members.sparkSession)
    size = F.greatest(F.length("set") / 4, F.lit(1))
    m = cut(members.withColumn("band", F.floor(F.log(size) / float(-np.log(similarity) * 1.0001))).withColumn("part", F.xxhash64("comp", "band")))
    blocks = m.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    edges = None
    for salt in (0, 1):
        own = m.join(blocks, "part").withColumn("own", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("nb")))
        own = own.select(F.col("part").alias("p"), F.col("own").alias("i"), F.col("part").alias("q"), F.col("own").alias("j"), "own", "part", "node", "set")
        one = _compared(own, similarity, n)
        edges = one if edges is None else edges.unionByName(one)
    edges = cut(edges.distinct())
    m = m.join(components(edges).select("node", F.col("comp").alias("root")), "node", "left")
    large = m.groupBy("comp", "band", "root").count().where(F.col("root").isNotNull() & (F.col("count") >= BLOCK)).select("comp", "band", "root", F.lit(True).alias("large"))
    m = m.join(large, ["comp", "band", "root"], "left").withColumn("root", F.when(F.col("large"), F.col("root")))
    m = cut(m.select("node", "comp", "band", "root", F.xxhash64("comp", "band", F.coalesce("root", F.lit(0)), F.col("root").isNull()).alias("part"), "set"))
    parts = cut(m.groupBy("comp", "band", "root", "part").agg(F.ceil(F.count("*") / BLOCK).alias("nb")))
    x, y = (parts.select(*[F.col(c).alias(f"{side}_{c}") for c in parts.columns]) for side in "xy")
    step = F.col("y_band") - F.col("x_band")
    met = x.join(y, (F.col("x_comp") == F.col("y_comp")) & ((step == 1) | ((step == 0) & (F.col("x_part") <= F.col("y_part")))))
    met = met.where("x_root is null or y_root is null or x_root <> y_root").select(F.col("x_part").alias("p"), F.col("y_part").alias("q"), F.col("x_nb").alias("p_nb"), F.col("y_nb").alias("q_nb"))
    met = cut(met)
    mine = m.join(parts.select("part", "nb"), "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb"))).select("part", "own", "node", "set")

    def others(nb: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(nb) - 1)).alias("other")

    own = F.col("own").alias("i")
    first = mine.join(met.where("p <> q"), mine["part"] == met["p"]).select("p", own, "q", others("q_nb"), "own", "part", "node", "set").withColumnRenamed("other", "j")
    second = mine.join(met.where("p <> q"), mine["part"] == met["q"]).select("p", others("p_nb"), "q", F.col("own").alias("j"), "own", "part", "node", "set").withColumnRenamed("other", "i")
    same = mine.join(met.where("p = q"), mine["part"] == met["p"]).select("p", "q", others("p_nb"), "own", "part", "node", "set")
    same = same.select("p", F.least("own", "other").alias("i"), "q", F.greatest("own", "other").alias("j"), "own", "part", "node", "set")
    return edges.unionByName(_compared(first.unionByName(second).unionByName(same), similarity, n))


#: Bits of the filter that keeps texts no pair needs from being shuffled: 2 MB, however many texts there are. Full, it lets all of them pass.
FILTER_BITS = 24


def _needed(need: DataFrame) -> np.ndarray:
    """A bit for each hash of ``need(node)``: at most 2 ** (FILTER_BITS - 6) words."""
    spot = F.shiftrightunsigned(F.xxhash64("node"), 64 - FILTER_BITS)
    words = need.select(spot.alias("spot")).select(F.shiftrightunsigned("spot", 6).alias("word"), F.col("spot").bitwiseAND(F.lit(63)).cast("int").alias("n"))
    got = words.selectExpr("word", "shiftleft(1L, n) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in got:
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def shingle_sets(need: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``node, set`` of the ``texts(node, text)`` in ``need(node)``, which are distinct: sorted shingles, four bytes each."""
    marks = need.sparkSession.sparkContext.broadcast(_needed(need))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = b.column(2).to_numpy().view(np.uint64)
            use = (marks.value[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
            b = b.filter(pa.array(use))
            for lo in range(0, b.num_rows, 512):
                x = [np.unique((shingle_hashes(t.as_py() or "", k) >> np.uint64(32)).astype("<u4")).tobytes() for t in b.column(1)[lo : lo + 512]]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 512], pa.array(x, pa.binary())], ["node", "set"])

    spotted = texts.select("node", "text", F.shiftrightunsigned(F.xxhash64("node"), 64 - FILTER_BITS).alias("spot"))
    return spotted.mapInArrow(sets, "node long, set binary").join(need, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``texts(node, text)`` have shingle sets of at least ``similarity``."""
    s = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), texts, k)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        trim()

    both = pairs.join(s.withColumnRenamed("node", "a").withColumnRenamed("set", "p"), "a").join(s.withColumnRenamed("node", "b").withColumnRenamed("set", "q"), "b")
    return both.select("a", "b", "p", "q").mapInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of texts alike: rows of ``docs`` that stay, all columns as they are.

    Texts link when their sets of ``k``-word shingles have a Jaccard similarity of at least ``similarity``; of each group
    linked the document with the least ``doc_id`` stays. Fingerprints of the sets are filed under so many of their rarest shingles that any two texts that link share one, and the tries below
    these are joined. The error budget is such that a pair at the bound exceeds it with a likelihood of ``LOST``; sets of fewer than ``FEW`` shingles meet whatever it is.
    Pairs that meet under enough shingles are verified on the texts. Texts under a crowded shingle are compared in blocks. No text goes before all pairs are verified.

    Defined cases: null and empty texts are alike; fewer than ``k`` words are one shingle; a null ``doc_id`` counts as
    the largest; of rows repeated exactly one stays; an empty table gives an empty result.
    """
    last = 2**63 - 1
    docs, kept = sheltered(docs, ("doc_id", "text"))
    d = docs.withColumn("_node", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)))
    nodes = cut(d.groupBy(F.col("_node").alias("node")).agg(F.min("_ord").alias("ord")))
    texts = d.select(F.col("_node").alias("node"), "text")
    found = cut(candidates(texts, nodes.count(), k, similarity))
    pairs = found.where("need >= 0 and a <> b").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("a", "b")
    pairs = cut(pairs)
    release(docs.sparkSession)
    links = cut(verified(pairs, texts, k, similarity))
    release(docs.sparkSession)
    crowds = found.where("need < 0").select("a", "b").distinct()
    if not crowds.isEmpty():
        comp = cut(components(crowds))
        links = links.unionByName(dense_links(shingle_sets(comp.select("node"), texts, k).join(comp, "node"), similarity))
    links = cut(links)
    release(docs.sparkSession)
    comp = components(links)
    ranked = nodes.join(comp, "node").select("node", "comp", "ord")
    best = ranked.groupBy("comp").agg(F.min(F.struct("ord", "node")).alias("best"))
    drop = ranked.join(best, "comp").where(F.col("node") != F.col("best.node")).select("node")
    stay = nodes.join(drop, "node", "left_anti").select(F.col("node").alias("_n"), F.col("ord").alias("_o"))
    out = d.join(stay, (d["_node"] == stay["_n"]) & (d["_ord"] == stay["_o"]))
    out = out.withColumn("_row", F.row_number().over(Window.partitionBy("_node", "_ord").orderBy(F.lit(1)))).where("_row = 1")
    return unsheltered(out.select(*docs.columns), kept)
