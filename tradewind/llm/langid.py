"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fenced, fields_of, unfenced

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
PIECE = 1 << 20
#: Words of the short cuts by which the score is calibrated.
CUTS = (1, 2, 4, 8, 16)
_LETTER = re.compile(rb"[A-Za-z]")


def subwords(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of all byte n-grams of a text (ASCII lower case, white space as one byte); a word's borders are part of
    them. Long texts are counted piece by piece, so that memory doesn't grow with them."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8)
    if len(data) <= PIECE:
        return np.unique(_ngrams(data, len(data)), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(data), PIECE):
        total += np.bincount(_ngrams(data[s : s + PIECE + max(ORDERS) - 1], PIECE), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint32), total[at]


def _ngrams(data: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that start at the first so many places."""
    data = data.astype(np.uint32)
    out = [np.empty(0, np.uint32)]
    for n in ORDERS:
        m = min(len(data) - n + 1, starts)
        if m > 0:
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ data[k : m + k]
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return np.concatenate(out)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embedding times output weights: bucket -> logits
    temperature: float
    threshold: float

    def logits(self, text: bytes) -> np.ndarray:
        at, n = subwords(text)
        return n @ self.table[at].astype(np.float64) / n.sum()

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted)."""
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0, False
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def train(rows: list[tuple[bytes, str]], dim: int = 16, epochs: int = 4, rate: float = 4.0, precision: float = 0.99, seed: int = 5) -> Model:
    """Stochastic gradient descent over four fifths of the rows; the rest sets the temperature and the threshold of rejection:
    the least score at which the accepted share of them is right in ``precision`` of cases.

    Whole texts part too well to say how sure a score is. So these figures are set on short cuts of the held-out texts, of one to
    sixteen words each, as many of every length.
    """
    languages = sorted({y for _, y in rows})
    known = [(x, languages.index(y)) for x, y in rows if has_letter(x)]
    if not known:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    few = len(known) < 50
    fit = [(subwords(x), y) for i, (x, y) in enumerate(known) if i % 5 or few]
    held = []
    for x, y in known if few else known[::5]:
        ws = x.split()
        for n in CUTS:
            at = int(rng.integers(max(1, len(ws) - n + 1)))
            if has_letter(cut := b" ".join(ws[at : at + n])):
                held.append((subwords(cut), y))
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    w = np.zeros((dim, len(languages)))
    steps, at = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)).tolist():
            (idx, n), y = fit[k]
            share = n / n.sum()
            h = share @ e[idx]
            z = h @ w
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            lr = rate * (1 - at / steps)
            at += 1
            back = w @ g
            w -= lr * 0.1 * np.outer(h, g)
            e[idx] -= lr * np.sqrt(len(idx)) * share[:, None] * back
    table = (e @ w).astype(np.float32)
    z = np.array([(n / n.sum()) @ table[idx] for (idx, n), _ in held], np.float64)
    y = np.array([k for _, k in held])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(np.geomspace(0.01, 100, 120).tolist(), key=loss)
    p = probabilities(temperature)
    order = np.argsort(-p.max(1))
    right = np.cumsum(p.argmax(1)[order] == y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return Model(languages, table, temperature, float(p.max(1)[order][good[-1]]) if len(good) else 1.0)


def identify_language(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = 3000) -> DataFrame:
    """Every row without its text, with held_out, lang_pred, score and accepted.

    The model learns from at most train_docs rows (those with the smallest hash of the key) of the rows with a text, a language
    and a key whose crc32 (as text) modulo 4 is not 2; the other rows are held out. A prediction sees nothing but the text. accepted
    is false where the calibrated probability is below the threshold of rejection.

    ``und`` with score 0 stands for texts that are null or have no letter, and for all if there was nothing to learn from. A
    null key is not held out. Repeated rows get the same result; an empty table gives an empty result. Columns named like a
    result are replaced, all others carried along, whatever their names.
    """
    added = ("held_out", "lang_pred", "score", "accepted")
    rows, inner, outer = fenced(docs, {text: "text", lang: "lang", key: "id"}, (text, *added))
    body = F.col("text").cast("binary")
    fold = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    pool = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~fold)
    sample = bounded_sample(pool, train_docs, F.xxhash64(F.col("id").cast("string")), body, F.col("lang").cast("string").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(train([(bytes(r.x), r.y) for r in sample]))
    frame = rows.select(body.alias("text"), *inner, fold.alias("held_out"))
    schema = ", ".join([*fields_of(rows, inner), "held_out boolean", "lang_pred string", "score double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.predict(x.as_py()) for x in batch.column(0)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*inner, *added])

    return unfenced(frame.mapInArrow(run, schema), inner, outer, added)
