"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from byte and word statistics by a small learned layer; a gated
attention layer weighs the passages, the weighted mean is the document's representation, and a logistic
output scores it. All layers are learned together from document labels alone.

Learning takes at most ``sample`` labelled rows of each label, chosen by hash, so what the driver holds is bounded. Scoring reads each
whole text once, without a shuffle; very long texts go through in blocks with running attention sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a passage; one ends at the white space after so many bytes at the latest.
PASSAGE = 512
#: Bytes looked at together.
BLOCK = 1 << 20
#: Buckets of hashed byte pairs.
PAIRS = 48


def _classes() -> np.ndarray:
    c = np.full(256, 15, np.int64)  # other bytes
    c[128:] = 0
    c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    for k, marks in enumerate((" \t\r\v\f", "\n", ".", ",;:", "!?", "#$%&*", "|", "()[]{}<>", "\"'`", "-_=+~", "@/\\"), 4):
        c[[ord(m) for m in marks]] = k
    return c


CLASSES = _classes()
N_CLASSES = 16
WIDTH = N_CLASSES + PAIRS + 5


def passages(text: str | None) -> Iterator[np.ndarray]:
    """Blocks of passage features, a row for each passage; an empty text is one passage of zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        yield np.zeros((1, WIDTH), np.float32)
        return
    at = 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        if stop < len(data):
            back = data.rfind(b" ", at + BLOCK // 2, stop)
            stop = back + 1 if back > 0 else stop
        yield _features(np.frombuffer(data, np.uint8, stop - at, at))
        at = stop


def _features(b: np.ndarray) -> np.ndarray:
    n = len(b)
    cls = CLASSES[b]
    space = (cls == 4) | (cls == 5)
    number = np.arange(n) // PASSAGE
    # a word belongs to the passage its first byte lies in
    start = ~space & np.concatenate(([True], space[:-1]))
    word_at = np.flatnonzero(start)
    word = np.maximum(np.cumsum(start) - 1, 0)
    if len(word_at):
        number = np.minimum(number, number[word_at][word])
    k = int(number[-1]) + 1
    size = np.maximum(np.bincount(number, minlength=k), 1).astype(np.float32)[:, None]
    share = np.bincount(number * N_CLASSES + cls, minlength=k * N_CLASSES).reshape(k, -1) / size
    low = np.where(cls == 2, b | 32, b).astype(np.uint32)
    pair = ((low[:-1] * np.uint32(257) + low[1:]) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(PAIRS)
    pairs = np.bincount(number[:-1] * PAIRS + pair, minlength=k * PAIRS).reshape(k, -1) / size
    more = np.zeros((k, 5), np.float32)
    if len(word_at):
        # words as numbers: sums of byte value by place, wrapping
        place = (np.arange(n) - word_at[word]).astype(np.uint64)
        mixed = np.where(space, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F)))
        code = np.add.reduceat(mixed, word_at)
        own = number[word_at]
        words = np.maximum(np.bincount(own, minlength=k), 1)
        again = np.concatenate(([False], (code[1:] == code[:-1]) & (own[1:] == own[:-1])))
        order = np.lexsort((code, own))
        same = np.concatenate(([False], (code[order][1:] == code[order][:-1]) & (own[order][1:] == own[order][:-1])))
        more[:, 0] = np.bincount(own, again, minlength=k) / words
        more[:, 1] = np.bincount(own[order], same, minlength=k) / words
        more[:, 2] = words / size[:, 0]
        more[:, 3] = np.log1p(words)
    more[:, 4] = 1
    return np.hstack([np.sqrt(share), np.sqrt(pairs), more]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    #: Added to the output, for labels learned in other proportions than they have.
    shift: float = 0.0

    def score(self, text: str | None) -> float:
        """Probability of label 1; attention's sums run over the text's blocks."""
        top, total, acc = -np.inf, 0.0, 0.0
        for x in passages(text):
            h, a = _attend((x - self.mean) / self.scale, self.layers)
            new = max(top, float(a.max()))
            w, keep = np.exp(a - new), np.exp(top - new)
            total, acc, top = total * keep + float(w.sum()), acc * keep + w @ h, new
        z = float(acc / total @ self.layers["out"] + self.layers["bias"][0]) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _attend(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ p["enc"] + p["enc0"])
    return h, (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["w"]


def train(bags: list[np.ndarray], labels: np.ndarray, prior: float, hidden: int = 24, gates: int = 12, epochs: int = 40, seed: int = 3) -> Model:
    """Fit all layers by Adam on the logistic loss of bags, both labels weighing the same; ``prior`` is the share of label 1 to score for."""
    rng = np.random.default_rng(seed)
    p = {"enc": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "enc0": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gates)), "u": rng.normal(0, 0.3, (hidden, gates)), "w": rng.normal(0, 0.3, gates), "out": rng.normal(0, 0.3, hidden), "bias": np.zeros(1)}
    logit = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    if not bags or labels.min() == labels.max():  # nothing to tell apart: the share of label 1 for all
        p["out"] = np.zeros(hidden)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), p, logit)
    every = np.vstack(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    bags = [(b - mean) / scale for b in bags]
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * len(labels)
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, seg = np.vstack([bags[i] for i in pick]), np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            begin = np.searchsorted(seg, np.arange(len(pick)))
            h = np.tanh(x @ p["enc"] + p["enc0"])
            t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
            a = (t * g) @ p["w"]
            e = np.exp(a - np.maximum.reduceat(a, begin)[seg])
            e /= np.add.reduceat(e, begin)[seg]
            z = np.add.reduceat(e[:, None] * h, begin)
            prob = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"], -40, 40)))
            d = (prob - labels[pick]) * weight[pick] / len(pick)
            dz = d[:, None] * p["out"]
            dh = e[:, None] * dz[seg]
            de = (dz[seg] * h).sum(1)
            da = e * (de - np.add.reduceat(e * de, begin)[seg])
            dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
            dh += dt @ p["v"].T + dg @ p["u"].T
            dx = dh * (1 - h * h)
            grad = {"enc": x.T @ dx + 1e-4 * p["enc"], "enc0": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ da, "out": z.T @ d + 1e-4 * p["out"], "bias": d.sum(keepdims=True)}
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, v in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, p, logit)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = 800, most: int = 256) -> Model:
    """Fit on at most ``sample`` documents of each quality label, those with the least hash of ``doc_id``, not held out.

    Of a document at most ``most`` passages are learned from, spread evenly over it, so ``2 * sample * most`` rows of ``WIDTH`` numbers are the most that the driver holds.
    Of texts repeated for an id the least counts.

    Rows whose crc32 of ``doc_id`` as text is divisible by 5 are held out. Labels other than 0 and 1, null ids and labels without
    a document are left out; of labels repeated for an id the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("k", F.xxhash64("doc_id", F.lit(5))).withColumn("part", F.pmod("k", F.lit(64)))
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    ids = known
    for by in (["quality", "part"], ["quality"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("k", "doc_id"))).where(F.col("r") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1)):
                x = np.vstack(list(passages(t.as_py())))
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), most)).astype(int))]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(2)[i : i + 1], pa.array([x.tobytes()], pa.binary())], ["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")  # at most 2 * sample rows are sent
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got], np.array([r["quality"] for r in got], float), 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` plus ``score double`` (likelihood of label 1) and ``predicted int`` from the texts alone.

    Defined cases: null and empty texts are one passage without content and get its score; without labels of both kinds
    all get label 1's share (a half without any). Other columns pass through, those named like the results are replaced.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts):
        import pandas as pd

        return pd.Series([share.value.score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*keep, predict("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
