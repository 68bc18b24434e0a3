"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary classifier (logistic regression on hashed byte n-grams) predicts the bit. A text gets the
language whose codeword has the least loss, each bit's logistic loss weighted by how reliable its classifier was on
held-back training rows. Texts whose best two languages are close are flagged as ambiguous.

The classifiers learn from at most ``sample`` labelled rows a language, chosen by hash, so what the driver holds
is bounded; prediction reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sheltered, unsheltered

DIMS = 4096
#: Bytes of a text hashed at a time.
STEP = 1 << 20
#: A text whose second language is at least this likely is ambiguous.
AMBIGUOUS = 0.4


@functools.cache
def _letter():
    import regex

    return regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    return _letter().search(text) is not None


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of hashed 1- to 3-byte n-grams of letters of the lower-cased text, to length 1."""
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass")
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(data), STEP):
        b = np.frombuffer(b" " * (at == 0) + data[max(0, at - 2) : at + STEP] + b" " * (at + STEP >= len(data)), np.uint8).astype(np.uint32)
        h2 = b[:-1] * np.uint32(257) + b[1:]
        for h in (b, h2, h2[:-1] * np.uint32(263) + b[2:]):
            total += np.bincount((h * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    x = np.sqrt(total.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (-1/1) of ``n`` classes as rows: all distinct splits for up to 5 classes, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (i == 0 or not (s >> (i - 1)) & 1) else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    rng, best, width = np.random.default_rng(seed), None, 4 * int(np.ceil(np.log2(n))) + 8
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if (best is None or apart > best[0]) and (abs(m.sum(0)) < n).all():
            best = (apart, m)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x (DIMS + 1)
    trust: np.ndarray  # bits
    sharpness: float = 4.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        return np.stack([(np.logaddexp(0, -c * margin) * self.trust).sum(-1) for c in self.code], -1) / self.trust.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability and whether it is ambiguous; ``und``, 0 and true where there are no letters or no languages."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        z = -self.sharpness * self.losses(features(text)[None])[0]
        p = np.exp(z - z.max())
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), bool(len(p) > 1 and p[order[1]] >= AMBIGUOUS)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 30.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression of each column of ``y`` (-1/1) by accelerated gradient descent; classes weigh the same."""
    x = np.hstack([x, np.full((len(x), 1), 0.1, np.float32)])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, share = w.copy(), np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)
    for t in range(rounds):
        g = x.T @ (-y * share / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))) + decay * ahead
        new = ahead - rate / 2 * g
        ahead, w = new + t / (t + 3) * (new - w), new
    w[-1] *= 0.1
    return w.T


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    """From ``(language, features)`` rows. A fifth of them is held back to weigh the bits and then used too."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((1, DIMS + 1)), np.ones(1))
    code = codebook(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((1, DIMS + 1)), np.ones(1))
    x = np.stack([v for _, v in rows])
    y = code[[langs.index(lang) for lang, _ in rows]].astype(np.float32)
    back = np.arange(len(rows)) % 5 == 4
    w = _fit(x[~back], y[~back])
    margin = y[back] * (x[back] @ w[:, :-1].T + w[:, -1])
    trust = np.clip((margin > 0).mean(0) if back.any() else np.ones(code.shape[1]), 0.5, 1.0) - 0.499
    return Model(langs, code, _fit(x, y), trust)


def learned(docs: DataFrame, sample: int = 400) -> Model:
    """Fit on at most ``sample`` rows of each ``lang``, those with the least hash of ``doc_id``, not held out.

    Rows whose crc32 of ``doc_id`` as text leaves 2 modulo 4 are held out; so are null ids, texts and langs.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    key = F.xxhash64(F.col("doc_id"), F.lit(11))
    # the least hashes by language: merged within tasks first, so a frequent language costs one bounded list a task
    ids = pick.select("lang", key.alias("k"), "doc_id").withColumn("part", F.pmod("k", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("k", "doc_id"))).where(F.col("r") <= sample)
    chosen = F.broadcast(ids.select("doc_id").distinct())  # at most `sample` for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    few = pick.join(chosen, "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of rows repeated for an id one
    got = few.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["x"]))
    return train([(r["lang"], np.frombuffer(r["x"], np.float32)) for r in got])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred string, score double, ambiguous boolean`` from the texts alone.

    Defined cases: null text and text without letters get ``und``, score 0, ambiguous; without any learned language all
    do. Very long texts are read whole, in steps. Other columns pass through, those named like the results are replaced.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([share.value.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    docs, kept = sheltered(docs.drop("lang_pred", "score", "ambiguous"), ("text",))
    return unsheltered(docs.withColumn("_p", predict("text")).select(*docs.columns, "_p.*"), kept)
