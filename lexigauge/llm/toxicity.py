"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from hashed weights of
its words and of their beginnings and ends; a document is toxic unless no sentence is:
1 - prod(1 - p). The weights are trained through that noisy-or from document labels
alone, and the sentence probabilities then say where the offence is.

Only features that toxic documents of the sample have clearly more often than others
(z of Z or more) get a weight; all others are left at zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, OWN, annotate, cached_in_worker, pieces, stored, utf8
from .sampling import held_out, labelled

BITS = 18
#: Labelled rows that a fit uses at most, about.
SAMPLE = 10_000
#: Documents that a feature needs, and how many standard deviations it must be above chance.
LEAST_DOCS, Z = 4, 4.5
#: Counters of one row when they are added up.
BLOCK = 1 << 15
END = re.compile(rb"[.!?\n]+")


def sentences(text: bytes | None) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    return [w for s in END.split(text.translate(LOWER)) if (w := s.translate(ALNUM).split())] if text else []


def places(word: bytes) -> list[int]:
    """Hashed places of a word, its beginnings of 3 to 8 characters and its ends of 3 to 6."""
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word) & mask]
    w = word.decode("utf-8", "replace")
    n = len(w)
    out += [zlib.crc32(w[:k].encode(), 1) & mask for k in range(3, min(8, n - 1) + 1)]
    out += [zlib.crc32(w[-k:].encode(), 2) & mask for k in range(3, min(6, n - 1) + 1)]
    return out


class Places(dict):
    """Word to its places, of those in chosen if that is given."""

    def __init__(self, chosen: np.ndarray | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        x = places(word)
        self[word] = x = [p for p in x if self.chosen[p]] if self.chosen is not None else x
        return x


def document_counts(rows: DataFrame) -> np.ndarray:
    """How many documents have each place, by label: (2, 2**BITS). Summed in each task, then by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, get, any_ = np.zeros((2, 1 << BITS), np.int32), Places(), False
        for b in pieces(batches):
            for y, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                found = {w for s in sentences(text) for w in s}
                counts[int(y)][list({p for w in found for p in get[w]})] += 1
                any_ = True
        flat = counts.ravel()
        k = range(0, len(flat), BLOCK) if any_ else []
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in k], pa.int32()), pa.array([flat[i : i + BLOCK].tobytes() for i in k], pa.binary())], names=["block", "x"])

    def add_up(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v, np.int32) for v in t["x"].to_pylist())
        return pa.table({"block": t["block"].slice(0, 1), "x": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(2 << BITS, np.int64)
    for r in rows.mapInArrow(run, "block int, x binary").groupBy("block").applyInArrow(add_up, "block int, x binary").collect():  # 2**BITS counters twice
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["x"]), np.int32)
    return out.reshape(2, -1)


def telling(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places that toxic documents have clearly more often than chance."""
    n, share = counts.sum(0), y.mean()
    z = (counts[1] - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return (n >= LEAST_DOCS) & (z >= Z)


def bags(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """For fitting: y, weight, number of chosen places of each sentence, those places (each once a sentence)."""
    bits = np.packbits(chosen).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Places(np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool))
        for b in pieces(batches):
            sizes, at = [], []
            for text in utf8(b.column(1)):
                found = [{p for w in s for p in get[w]} for s in sentences(text)]
                sizes.append([len(x) for x in found])
                at.append([p for x in found for p in sorted(x)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], names=["y", "weight", "sizes", "places"])

    return rows.mapInArrow(run, "y double, weight double, sizes array<int>, places array<int>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias from about sample labelled rows, as many toxic ones as others if there are enough, weighted back to
    their shares; without both labels, a bias that gives their mean for any text."""
    one = labels.select(id_col, (F.col(label_col) > 0).cast("double").alias(label_col))
    rows = labelled(docs, one, id_col, text_col, label_col, sample, balanced=True)
    rows = stored(rows.select(F.col(OWN + "y").alias("y"), OWN + "text", F.col(OWN + "weight").alias("weight")), "labelled")
    size = 1 << BITS
    y = rows.select("y").toArrow()["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return np.zeros(size, np.float32), -20.0 if not y.sum() else 20.0
    got = bags(rows, telling(document_counts(rows), y)).toArrow().combine_chunks()
    y, weight = got["y"].to_numpy(), got["weight"].to_numpy()

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = got[name].combine_chunks()
        c = c if isinstance(c, pa.ListArray) else c.chunk(0)
        return c.flatten().to_numpy().astype(np.int64), np.diff(c.offsets.to_numpy())

    sizes, per_doc = lists("sizes")
    col, _ = lists("places")
    doc = np.repeat(np.arange(len(y)), per_doc)
    sent = np.repeat(np.arange(len(sizes)), sizes)
    return descend(sent, col, doc, y, len(sizes), size, rounds, weight=weight)


def descend(sent: np.ndarray, col: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int, size: int, rounds: int, l2: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Likelihood of the noisy-or by Adam: with S = sum of log(1 - p) over a bag, P(toxic) = 1 - exp(S). weight: how many documents one stands for."""
    each = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
    use, col = np.unique(col, return_inverse=True)
    w, bias = np.zeros(len(use) + 1), -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        z = np.bincount(sent, w[col], n) + bias + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        s = np.minimum(np.bincount(doc, -np.logaddexp(0, z), len(y)), -1e-9)
        g = np.where(y > 0, np.exp(s) / -np.expm1(s), -1.0) * each
        dz = p * g[doc]
        grad = np.concatenate([np.bincount(col, dz[sent], len(use)) - l2 * w[:-1], [dz.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    out = np.zeros(size, np.float32)
    out[use] = w[:-1]
    return out, bias + float(w[-1])


class WordWeights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = float(self.weights[places(word)].sum())
        return x


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with OWN-prefixed score and worst (the number of the sentence likeliest to be toxic, from 0).

    A null, empty or wordless text is a bag of one empty sentence. Rows are independent, so
    repeated rows and ids are alike; very long texts are read as a whole; ties of sentences
    go to the first; an empty table gives no rows.
    """
    weights, bias = model
    blob = weights.tobytes()
    key = f"toxicity:{zlib.crc32(blob)}:{bias}"
    held = docs.sparkSession.sparkContext.broadcast(blob)

    def make():
        get = cached_in_worker(key, lambda: WordWeights(np.frombuffer(held.value, np.float32))).__getitem__

        def f(texts):
            score, worst = [], []
            for text in texts:
                z = np.array([sum(map(get, set(s))) for s in sentences(text)] or [0.0]) + bias
                score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                worst.append(int(z.argmax()))
            return [score, worst]

        return f

    return annotate(docs, text_col, [("score", "double"), ("worst", "long")], make)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from rows outside the held-out fold, applied to every whole text."""
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    x = scored(docs.select("doc_id", "text"), model)
    s = F.col(OWN + "score")
    return x.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.col(OWN + "worst").alias("worst_sentence"))
