"""External suffix sorting by induction, with common-prefix values, to a bounded depth.

As in SA-IS, the suffixes that are smaller than their right neighbour after a larger one (the leftmost-S suffixes) are sorted first, and they induce the
order of all others. Induction runs over priority queues ordered by (first symbol, time of arrival): a suffix taken from the
queue of its symbol puts the suffix one to the left into the queue of that one's symbol. Suffixes arrive in rank order, so within a symbol
first in is first out, and whole blocks are taken and dealt at a time. Each tuple carries the suffix and the length of its common prefix with the one
queued before it: one more than the least value scanned between their two origins. Queues beyond the memory
budget lie on disk, as do sorted parts, so a shard may be far larger than memory; its symbols may be a memory map.

Only the first ``depth`` symbols count, which is all that repeats of that length need: suffixes alike that far come in any order
among themselves, with a common prefix of ``depth``. Names of leftmost-S substrings are therefore refined recursively, pairs of
names to names of pairs, until they cover ``depth`` symbols.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes taken from a queue at a time.
TAKE = 1 << 16


class Queues:
    """One first-in-first-out queue of (suffix, common prefix) tuples for each symbol, on disk beyond ``budget`` bytes."""

    def __init__(self, symbols: int, budget: int, folder: str):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.budget, self.folder, self.files = 0, budget, folder, 0

    def put(self, symbol: int, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((suffix, lcp))
        self.held += suffix.nbytes + lcp.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        for queue in self.parts:
            mine = [k for k, p in enumerate(queue) if not isinstance(p, str)]
            if mine and sum(len(queue[k][0]) for k in mine) >= 1024:
                self.files += 1
                path = os.path.join(self.folder, f"{id(self)}-{self.files}.npz")
                # parts in memory are always the latest: what was spilled before stands in front
                np.savez(path, suffix=np.concatenate([queue[k][0] for k in mine]), lcp=np.concatenate([queue[k][1] for k in mine]))
                del queue[mine[0] :]
                queue.append(path)
        self.held = sum(p[0].nbytes + p[1].nbytes for q in self.parts for p in q if not isinstance(p, str))

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the front until the queue is empty, those put meanwhile included."""
        queue = self.parts[symbol]
        while queue:
            few, n = [], 0
            while queue and n < TAKE:
                part = queue.pop(0)
                if isinstance(part, str):
                    with np.load(part) as f:
                        suffix, lcp = f["suffix"], f["lcp"]
                    os.unlink(part)
                else:
                    suffix, lcp = part
                    self.held -= suffix.nbytes + lcp.nbytes
                few.append((suffix, lcp))
                n += len(suffix)
            suffix, lcp = (np.concatenate(x) for x in zip(*few, strict=True)) if len(few) > 1 else few[0]
            for at in range(0, n, TAKE):
                yield suffix[at : at + TAKE], lcp[at : at + TAKE]


class Least:
    """Least common prefix scanned since each symbol last got a suffix."""

    def __init__(self, symbols: int, depth: int):
        self.since, self.depth = np.zeros(symbols, np.uint8), depth

    def deal(self, lcp: np.ndarray, target: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the suffixes at places ``at`` of the block scanned, going to ``target``: their order by target, and their common prefixes."""
        order = np.argsort(target, kind="stable")
        t, j = target[order], at[order]
        fresh = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
        lo = np.where(fresh, 0, np.concatenate(([0], j[:-1] + 1))) if len(t) else j
        least = _range_min(lcp, lo, j)
        least = np.where(fresh, np.minimum(least, self.since[t]), least)
        rest = np.full(len(self.since), self.depth, np.uint8)
        whole = lcp.min() if len(lcp) else self.depth
        self.since = np.minimum(self.since, whole)
        if len(t):
            last = np.concatenate((t[1:] != t[:-1], [True]))
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)  # least from a place to the end
            rest[t[last]] = after[j[last] + 1]
            self.since[t[last]] = rest[t[last]]
        return order, np.minimum(least + 1, self.depth).astype(np.uint8)


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``v[lo..hi]``, ends included, by a table of minima over powers of two."""
    if not len(lo):
        return np.zeros(0, v.dtype)
    table, width = [v], 1
    while 2 * width <= int((hi - lo).max()) + 1:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), v.dtype)
    for k in range(len(table)):
        m = level == k
        if m.any():
            out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << k) + 1])
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes ``a`` and ``b``, up to ``depth``; the text's end is smaller than any symbol."""
    out, open_, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(text)
    for k in range(depth):
        x, y = a[open_] + k, b[open_] + k
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        open_ = open_[ok]
        if not len(open_):
            break
        out[open_] = k + 1
    return out


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their right neighbour, and the places of leftmost-S ones. The last is larger than the empty one."""
    n = len(text)
    starts = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
    up = np.concatenate((text[starts[1:]] > text[starts[:-1]], [False]))
    kind = np.repeat(up, np.diff(np.append(starts, n)))
    return kind, starts[1:][up[1:] & ~up[:-1]]


def _induce(text: np.ndarray, kind: np.ndarray, lms: np.ndarray, lcp: np.ndarray, symbols: int, depth: int, budget: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in blocks, each with its common prefix with the one before it, from the leftmost-S ones in ascending order."""
    n = len(text)
    low, low_done = Queues(symbols, budget, folder), Queues(symbols, budget, folder)
    least = Least(symbols, depth)
    firsts = np.searchsorted(text[lms], np.arange(symbols + 1)) if len(lms) else np.zeros(symbols + 1, np.int64)
    # larger ones: the last suffix comes before all that begin with its symbol
    low.put(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
    last: int | None = None

    def scan(suffix: np.ndarray, pre: np.ndarray, larger: bool, queues: Queues) -> None:
        left = suffix - 1
        at = np.flatnonzero(left >= 0)
        at = at[kind[left[at]] != larger]
        to = left[at]
        target = text[to]
        order, got = least.deal(pre, target, at)
        to, target = to[order], target[order]
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(target)) + 1):
            if len(part):
                queues.put(int(target[part[0]]), to[part], got[part])

    ends: list[int | None] = [None] * symbols
    for c in range(symbols):
        last = None
        for suffix, pre in low.take(c):
            if last is None:
                pre = pre.copy()
                pre[0] = 0
            low_done.put(c, suffix, pre)
            scan(suffix, pre, True, low)
            last = int(suffix[-1])
        ends[c] = last
        a, b = int(firsts[c]), int(firsts[c + 1])
        for at in range(a, b, TAKE):
            suffix, pre = lms[at : min(b, at + TAKE)], lcp[at : min(b, at + TAKE)].astype(np.uint8)
            if at == a:
                pre[0] = 0 if last is None else common_prefix(text, np.array([last]), suffix[:1], depth)[0]
            scan(suffix, pre, True, low)
    high, least = Queues(symbols, budget, folder), Least(symbols, depth)
    for c in range(symbols - 1, -1, -1):
        last = None
        for suffix, pre in high.take(c):
            if last is None:
                pre = pre.copy()
                pre[0] = 0
            yield suffix, pre
            scan(suffix, pre, False, high)
            last = int(suffix[-1])
        # the larger ones, from the back; a part's first value belongs to the part before it
        parts = low_done.parts[c]
        after = None
        while parts:
            part = parts.pop()
            if isinstance(part, str):
                with np.load(part) as f:
                    suffix, pre = f["suffix"], f["lcp"]
                os.unlink(part)
            else:
                suffix, pre = part
                low_done.held -= suffix.nbytes + pre.nbytes
            if after is None:
                after = 0 if last is None else int(common_prefix(text, np.array([last]), suffix[-1:], depth)[0])
            down, value = suffix[::-1], np.concatenate(([after], pre[:0:-1])).astype(np.uint8)
            after = int(pre[0])
            for at in range(0, len(down), TAKE):
                yield down[at : at + TAKE], value[at : at + TAKE]
                scan(down[at : at + TAKE], value[at : at + TAKE], False, high)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Names, equal for equal substrings from one leftmost-S place to the next and in their order, by place; ``order`` has them sorted."""
    n = len(lms)
    stop = np.append(lms[1:], len(text) - 1)
    length = np.empty(n, np.int64)
    rank_of = np.searchsorted(lms, order)
    length = (stop - lms + 1)[rank_of]
    same = length[1:] == length[:-1]
    idx = np.flatnonzero(same)
    k = 0
    while len(idx):
        # past an open end nothing more is to compare
        going = length[1:][idx] > k
        live = idx[going]
        eq = text[order[1:][live] + k] == text[order[:-1][live] + k]
        same[live[~eq]] = False
        idx = live[eq]
        k += 1
        if k >= depth:
            break
    name = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(n, np.int64)
    out[rank_of] = name
    return out


def _refine(names: np.ndarray, reach: int, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, each of which stands for ``reach`` symbols at least: names of pairs name twice as many."""
    if reach >= depth or (len(names) and names.max() + 1 == len(names)):
        return np.argsort(names, kind="stable")
    # a name of a pair takes the second from `step` names on
    step, rank = 1, names
    while reach * step < depth:
        nxt = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)))[: len(rank)]
        pair = rank * (int(rank.max()) + 2) + nxt
        uniq, rank = np.unique(pair, return_inverse=True)
        step *= 2
        if len(uniq) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def descending(text: np.ndarray, symbols: int, depth: int, budget: int = 1 << 28) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` (whole numbers below ``symbols``) in descending order to ``depth`` symbols, in blocks.

    With each comes the length, up to ``depth`` (200 at most), of its common prefix with the suffix before it. An empty text gives nothing.
    """
    if not 1 <= depth <= 200:
        raise ValueError("depth is 1 to 200")
    if not len(text):
        return
    kind, lms = _kinds(text)
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        by_symbol = lms[np.argsort(text[lms], kind="stable")]
        if len(lms) > 1:
            marks = np.zeros(len(text), bool)
            marks[lms] = True
            zeros = np.zeros(len(lms), np.uint8)
            found = [s[marks[s]] for s, _ in _induce(text, kind, by_symbol, zeros, symbols, depth, budget, folder)]
            names = _names(text, lms, np.concatenate(found)[::-1], depth)
            # a leftmost-S substring has three symbols at least, and shares its last with the next
            by_symbol = lms[_refine(names, 2, depth)]
        lcp = np.zeros(len(by_symbol), np.uint8)
        for at in range(1, len(by_symbol), 1 << 20):
            stop = min(len(by_symbol), at + (1 << 20))
            lcp[at:stop] = common_prefix(text, by_symbol[at - 1 : stop - 1], by_symbol[at:stop], depth)
        yield from _induce(text, kind, by_symbol, lcp, symbols, depth, budget, folder)
