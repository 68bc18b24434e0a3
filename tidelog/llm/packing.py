"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Best-fit decreasing looks at lengths only, and lengths are whole numbers up to the sequence length. So the driver
packs counts, not documents: it takes the lengths in descending order, finds the tightest open remaining
capacity for each with a segment tree in logarithmic time, and moves as many pieces at once as there are bins of that capacity.
What it holds is bounded by the sequence length, whatever the corpus. The documents of a
length are then numbered in parallel and looked up in the resulting table of intervals.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, trim

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: The vocabulary's own split of text before merges, for texts of the characters above, ASCII digits, marks and plain white space.
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
#: Entries kept of the per-process table of words' ids.
WORDS_KEPT = 400_000

_encoders: dict[str, Encoder] = {}


class Words(dict):
    """Ids of words, filled as words come up; of those not seen since the last but one filling, nothing is kept."""

    def __init__(self, model):
        super().__init__()
        self.model, self.before = model, {}
        # the vocabulary writes a byte that does not print as the next character from 256 on
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}

    def forget(self) -> None:
        self.before = {}
        self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))], "<u4").tobytes()
        if len(self) >= WORDS_KEPT:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Token ids of a byte-level BPE vocabulary file for the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    Merges never cross the pre-tokeniser's words, so ids of words are kept and reused. Texts with characters outside
    of ``PLAIN``'s alphabet or with the vocabulary's added tokens go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]  # found before words are split
        self.words = Words(self.lib.model)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def ids(self, text: str) -> bytes:
        if OTHER.search(text) or any(t in text for t in self.added):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, PLAIN.findall(text)))


class FreeTree:
    """Segment tree over remaining capacities 0..n: which have open bins, and the least one from a bound up."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, has: bool) -> None:
        k = self.size + capacity
        self.any[k] = has
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def tightest(self, need: int) -> int:
        """Least capacity of at least ``need`` with an open bin, or -1: up to the first right-hand subtree with one, then down its left edge."""
        k = self.size + need
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.any[2 * k])
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Intervals ``(length, first rank, first bin, offset)`` for ``counts[length]`` pieces of each length.

    Pieces of a length have ranks 0, 1, ...; from ``first rank`` on (up to the next interval of the length) they
    go to bins ``first bin``, ``first bin + 1``, ... at ``offset``. Bin by bin this is what best-fit decreasing makes of the pieces one
    by one: while bins of the tightest capacity are left, the next piece of the same length has them as its
    tightest too, unless the bin just filled has become tighter and still fits, which is then used first.
    """
    tree, bins = FreeTree(capacity), [[] for _ in range(capacity + 1)]  # by remaining capacity: [first bin, number]
    made, out = 0, []

    def put(free: int, first: int, n: int) -> None:
        if free:
            bins[free].append((first, n))
            tree.set(free, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = tree.tightest(length)
            if free < 0:
                free, first = capacity, made
                each = capacity // length  # the new bins, each filled up with this length before the next is opened
                whole, rest = divmod(left, each)
                for n, k in ((whole, each), (1, rest)):
                    if n and k:
                        for slot in range(k):
                            out.append((length, rank, made, slot * length, n))
                            rank += n
                        put(capacity - k * length, made, n)
                        made += n
                left = 0
                continue
            first, n = bins[free].pop()
            each = min(free // length, left)
            use = min(n, left // each)
            for slot in range(each):
                out.append((length, rank, first, capacity - free + slot * length, use))
                rank += use
            left -= use * each
            if n > use:
                bins[free].append((first + use, n - use))
            tree.set(free, bool(bins[free]))
            put(free - each * length, first, use)
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut where longer than ``capacity``.

    All pieces but a cut document's first are full. Null text counts as empty and gives one piece, the end id.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    for r, v in zip(rows, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        r.append(v)
                    start = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.words.forget()
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, block_rows: int = 2048) -> DataFrame:
    """Pack all of ``docs`` into sequences of at most ``capacity`` tokens, in as few as best-fit decreasing can.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece; a
    sequence's pieces stand without gaps from offset 0. Pieces of one length are numbered within hashed blocks of
    about ``block_rows``, so a length that a third of all documents share is spread over many tasks.

    Defined cases: null or empty text gives one piece (the end id alone); null ids are kept; rows repeated
    exactly are packed each; an empty table gives an empty result; other columns are left out.
    """
    p = cut(pieces(docs, vocabulary, capacity, end_id))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(counts, capacity)
    sized = p.sparkSession.createDataFrame([(k, -(-n // block_rows)) for k, n in counts.items()] or [(0, 1)], "length long, blocks long")
    p = p.join(F.broadcast(sized), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks")))
    ahead = p.groupBy("length", "block").agg(F.count("*").alias("s"))
    ahead = ahead.select("length", "block", (F.sum("s").over(Window.partitionBy("length").orderBy("block")) - F.col("s")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    p = p.withColumn("within", within).join(ahead, ["length", "block"])
    p = p.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("ahead")).alias("rank"))
    table = np.array(plan or [(0, 0, 0, 0, 0)], np.int64)  # in order of length, descending, and rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (capacity - table[:, 0]) * (1 << 44) + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (capacity - length) * (1 << 44) + rank, "right") - 1
            cols = [*b.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:5], "sequence_id", "offset"])

    return p.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
