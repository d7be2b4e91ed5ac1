"""Language by word-first backoff.

A known word is scored by its log frequency in each language. For an unseen word the
longest character n-grams that are known speak instead: five characters, else four, and
so on to single characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, annotate, cached_in_worker, pieces, stored, utf8
from .sampling import bounded_each, held_out

#: Labelled rows of each language that a fit uses at most, about. All their words and n-grams are known.
SAMPLE = 3_000
LONGEST = 5
#: ASCII letters and all longer characters make words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split() if text else []


ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def grams(word: bytes, n: int) -> list[str]:
    w = f" {word.decode('utf-8', 'replace')} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def counted(rows: DataFrame) -> DataFrame:
    """lang, n (0 for words), item, count over all rows given, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                by = Counter()
                for w, k in c.items():
                    by[(0, w.decode("utf-8", "replace"))] += k
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            by[(n, g)] += k
                keys = list(by)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array(list(by.values()), pa.int64())], names=["lang", "n", "item", "k"])
            held.clear()

        for b in pieces(batches):
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) > 150_000:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, n int, item string, k long").groupBy("lang", "n", "item").agg(F.sum("k").alias("k"))


class Model:
    """Log frequencies by language of known words (table 0) and n-grams: of each table the items and their counts by language."""

    def __init__(self, langs: list[str], tables: list[tuple[list[str], np.ndarray]]):
        self.langs = langs
        self.tables: list[tuple[dict[str, int], np.ndarray]] = []
        for items, k in tables:
            total = k.sum(0) + 0.5 * (len(items) + 1)
            self.tables.append(({x: i for i, x in enumerate(items)}, np.log((k + 0.5) / total).astype(np.float32)))

    def word(self, w: bytes) -> np.ndarray:
        at, logs = self.tables[0]
        s = w.decode("utf-8", "replace")
        if s in at:
            return logs[at[s]].astype(np.float64)
        for n in range(LONGEST, 0, -1):
            at, logs = self.tables[n]
            if found := [at[g] for g in grams(w, n) if g in at]:
                # an unseen word is one piece of evidence, not one for each n-gram
                return logs[found].mean(0, dtype=np.float64)
        return np.zeros(len(self.langs))


class Rows(dict):
    """Word to its row in a growing table of log frequencies."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.most = model, 400_000
        self.logs = np.zeros((1024, len(model.langs)))

    def __missing__(self, w: bytes) -> int:
        i = len(self)
        if i == len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[i] = self.model.word(w)
        self[w] = i
        return i

    def score(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return self.logs_of(np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)))

    def logs_of(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(at, minlength=1) @ self.logs[: at.max() + 1] if len(at) > 50_000 else self.logs[at].sum(0)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on about sample rows of each language that has a text, chosen row by row; null texts and languages say nothing.

    Repeated rows count as often as they are chosen; without any row the model knows no language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null and lang is not null")
    counts = stored(counted(bounded_each(rows, "lang", sample)), "langid")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], [([], np.zeros((0, 0)))] * (LONGEST + 1))
    wide = counts.groupBy("n", "item").agg(*[F.sum(F.when(F.col("lang") == x, F.col("k")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)])
    tables: list[tuple[list[str], np.ndarray]] = []
    for n in range(LONGEST + 1):
        got = wide.where(F.col("n") == n).toArrow()
        items = got["item"].to_pylist()
        k = np.stack([got[f"l{i}"].to_numpy() for i in range(len(langs))], 1).astype(np.float64) if items else np.zeros((0, len(langs)))
        order = np.argsort(np.array(items, dtype=object)) if items else np.zeros(0, np.int64)
        tables.append(([items[i] for i in order], k[order]))
    return Model(langs, tables)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with OWN-prefixed lang_pred and score, the posterior of that language.

    Texts that are null or have no letter, and all texts if no language was learned, are
    `und` with score 0. Ties go to the first language by name. Rows are independent, so
    repeated rows and ids are alike; very long texts are read as a whole; an empty table gives
    no rows. The model's size is bounded by the sample it was fitted on.
    """
    import pickle

    blob = pickle.dumps((model.langs, [(list(at), logs) for at, logs in model.tables]))
    key = f"langid:{zlib.crc32(blob)}"
    held = docs.sparkSession.sparkContext.broadcast(blob)

    def make():
        def build():
            m = Model([], [])
            m.langs, tables = pickle.loads(held.value)
            m.tables = [({x: i for i, x in enumerate(items)}, logs) for items, logs in tables]
            return Rows(m)

        rows = cached_in_worker(key, build)
        langs = rows.model.langs

        def f(texts):
            pred, score = [], []
            for text in texts:
                if not langs or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                ws = words(text)
                # texts whose letters are all outside words (none here) leave even odds
                s = rows.score(ws) if ws else np.zeros(len(langs))
                p = np.exp(s - s.max())
                k = int(p.argmax())
                pred.append(langs[k])
                score.append(float(p[k] / p.sum()))
            return [pred, score]

        return f

    return annotate(docs, text_col, [("lang_pred", "string"), ("score", "double")], make)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned outside the held-out fold, predicted for every whole text."""
    test = held_out("doc_id", 4, 2)
    model = fit(docs.where(~test).select("text", "lang"))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", test.alias("held_out"), F.col(OWN + "lang_pred").alias("lang_pred"), F.col(OWN + "score").alias("score"))
