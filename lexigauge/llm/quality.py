"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(z - t_k) with one score z from hashed text weights shared by all
grades and ordered thresholds t_0 < t_1 < ...; that gives an expected grade, and the tail
probability of reaching a grade, by which documents are selected.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, annotate, cached_in_worker, pieces, utf8
from .sampling import labelled

#: Weights: 2**BITS for words and as many for shapes.
BITS = 17
#: Labelled rows that a fit uses at most, about.
SAMPLE = 8_000
#: Bytes of a word reduced to its shape: upper case, lower case, digit, other; ASCII marks stay.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 97 if c >= 128 else c for c in range(256))
EXTRA = 24


def squeezed(word: bytes) -> bytes:
    """The word's shape with runs cut to two."""
    s = word.translate(SHAPE)
    return bytes(c for i, c in enumerate(s) if i < 2 or c != s[i - 1] or c != s[i - 2])[:12]


def slots(word: bytes) -> tuple[int, int]:
    """Hashed places of a word and of its shape."""
    mask = (1 << BITS) - 1
    return zlib.crc32(word.lower()) & mask, (1 << BITS) + (zlib.crc32(squeezed(word), 7) & mask)


def whole_text(n: int, distinct: int, repeats: int, chars: int) -> list[tuple[int, float]]:
    """Features of the whole text, as places after the hashed ones: length, variety, repeats, word length."""
    if not n:
        return [(0, 1.0)]
    return [
        (1 + min(7, n.bit_length() // 2), 1.0),
        (9, repeats / n),
        (10, min(1.0, distinct / (n**0.8))),
        (11 + min(7, int(chars / n / 2)), 1.0),
        (20, float(repeats > 0.2 * n)),
    ]


@dataclass
class Ordinal:
    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) by row and k."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades)


def parts(text: bytes | None) -> tuple[dict[bytes, int], int, list[tuple[int, float]]]:
    words = text.split() if text else []
    n = len(words)
    counts = Counter(words)
    repeats = sum(map(operator.eq, words, words[1:]))
    return counts, n, whole_text(n, len(counts), repeats, len(text) - n + 1 if n else 0)


def features(rows: DataFrame) -> DataFrame:
    """For fitting: y, places, values of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, val = [], []
            for text in utf8(b.column(1)):
                counts, n, extra = parts(text)
                x: dict[int, float] = {}
                for w, c in counts.items():
                    for s in slots(w):
                        x[s] = x.get(s, 0.0) + c / n
                x |= {(2 << BITS) + k: v for k, v in extra}
                at.append(list(x))
                val.append(list(x.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["y", "places", "vals"])

    return rows.mapInArrow(run, "y double, places array<int>, vals array<float>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, rounds: int = 150, l2: float = 1e-5) -> Ordinal:
    """Fit on about sample labelled rows. Without two different grades, every text gets the one grade (0 without labels)."""
    rows = labelled(docs, labels, id_col, text_col, label_col, sample)
    got = features(rows.select(OWN + "y", OWN + "text")).toArrow().combine_chunks()
    size = (2 << BITS) + EXTRA
    y = got["y"].to_numpy()
    grades = sorted(set(y.tolist())) or [0.0]
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(0), np.zeros(size, np.float32))
    lists = got["places"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    col = lists.flatten().to_numpy().astype(np.int64)
    vals = got["vals"].combine_chunks()
    vals = vals if isinstance(vals, pa.ListArray) else vals.chunk(0)
    val = vals.flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((col, val, row))
    row, col, val = row[order], col[order], val[order]
    return descend(row, col, val, np.searchsorted(grades, y), grades, size, rounds, l2)


def descend(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, grades: list[float], size: int, rounds: int, l2: float) -> Ordinal:
    """Maximum likelihood by Adam. Thresholds stay ordered: the first is free, the steps between are exponentials."""
    k, n = len(grades) - 1, len(y)
    share = np.clip([(y > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    p = np.concatenate([np.zeros(size), free])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        w, free = p[:size], p[size:]
        t = np.cumsum(np.concatenate([free[:1], np.exp(np.minimum(free[1:], 20))]))
        z = np.bincount(row, val * w[col], n)
        # cumulative probabilities with the ends 1 and 0; a row's probability is a difference
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -60, 60)))
        up, down = np.c_[np.ones(n), s], np.c_[s, np.zeros(n)]
        r = np.arange(n)
        prob = np.maximum(up[r, y] - down[r, y], 1e-9)
        du, dd = up[r, y] * (1 - up[r, y]) / prob, down[r, y] * (1 - down[r, y]) / prob
        dz = (du - dd) / n
        dt = np.zeros((n, k + 2))
        dt[r, y] -= du
        dt[r, y + 1] += dd
        dt = dt[:, 1 : k + 1].sum(0) / n
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, val * dz[row], size) - l2 * w, tail[:1], tail[1:] * np.exp(np.minimum(free[1:], 20))])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    free = p[size:]
    return Ordinal(grades, np.cumsum(np.concatenate([free[:1], np.exp(np.minimum(free[1:], 20))])), p[:size].astype(np.float32))


class WordWeights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        a, b = slots(word)
        self[word] = x = float(self.weights[a]) + float(self.weights[b])
        return x


def scored(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs with OWN-prefixed score (z), expected_grade, tail (probability of more than the lowest grade).

    Null and empty texts are scored by their emptiness alone. The weights have a fixed
    size (2 * 2**BITS floats), so sending them to every task is bounded.
    """
    blob, t, grades = model.weights.tobytes(), model.thresholds, model.grades
    key = f"quality:{zlib.crc32(blob)}:{len(blob)}"
    held = docs.sparkSession.sparkContext.broadcast(blob)

    def make():
        words = cached_in_worker(key, lambda: WordWeights(np.frombuffer(held.value, np.float32)))
        m = Ordinal(grades, t, words.weights)

        def f(texts):
            z = []
            for text in texts:
                w = text.split() if text else []
                n = len(w)
                repeats = sum(map(operator.eq, w, w[1:]))
                s = sum(map(words.__getitem__, w)) / n if n else 0.0
                for k, v in whole_text(n, len(set(w)), repeats, len(text) - n + 1 if n else 0):
                    s += float(words.weights[(2 << BITS) + k]) * v
                z.append(s)
            a = np.array(z, np.float64)
            tail = m.tails(a)[:, 0] if len(t) else np.ones(len(a))
            return [z, m.expected(a).tolist() if len(t) else [grades[0]] * len(z), tail.tolist()]

        return f

    return annotate(docs, text_col, [("score", "double"), ("expected_grade", "double"), ("tail", "double")], make)


#: Documents whose tail probability is less are rejected.
LEAST = 0.5


def graded(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, tail_prob, kept of every document.

    Null and empty texts are scored by their emptiness; repeated rows and null ids row by row;
    very long texts as a whole; ties at least are kept; an empty table gives no rows; extra
    columns are left out. Labels that are null or of no document say nothing; of repeated
    labels of one id the largest counts.
    """
    x = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return x.select("doc_id", F.col(OWN + "expected_grade").alias("expected_grade"), F.col(OWN + "tail").alias("tail_prob"), (F.col(OWN + "tail") >= least).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents that graded() keeps, with their own columns, row by row."""
    return scored(docs, fit(docs, labels)).where(F.col(OWN + "tail") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
