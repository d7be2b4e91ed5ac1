"""Fact tables by stored tokenizers, made where texts are encoded: numbers and counts leave the workers, ids do not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measure import Measure, not_blank
from .encode import Tokenizer, slices
from .facts import Facts, text_facts
from .parts import encoded

#: Counts that a worker holds before it gives them out, eight bytes each.
HELD = 4_000_000


def by_libraries(tokenizers: list[Tokenizer]) -> bool:
    """Whether all have ids of texts as they are."""
    return all(t.ids is not None and not t.preprocess for t in tokenizers)


def _texts(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("text").isNotNull() & not_blank(F.col("text")))


def numbers(corpus: DataFrame, tokenizers: list[Tokenizer], *carried: str) -> DataFrame:
    """The carried columns of every text that is not blank, and by: tokenizer, n_tokens, most (the largest id) of each tokenizer that has tokens for it."""
    names, of = [t.name for t in tokenizers], [(t.ids, t.parts) for t in tokenizers]
    src = _texts(corpus).select(*dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, most = [], []
            for ids, k in encoded(b["text"].to_pylist(), of):
                top = np.full(len(k), -1, np.int64)
                if len(ids):
                    top[k > 0] = np.maximum.reduceat(ids, (np.cumsum(k) - k)[k > 0])
                n.append(k)
                most.append(top)
            # texts in order, the tokenizers of each side by side
            n, most = np.stack(n, 1), np.stack(most, 1)
            has = n > 0
            rows = pa.StructArray.from_arrays([pa.array(np.tile(np.array(names, object), b.num_rows)[has.ravel()], pa.string()), pa.array(n[has]), pa.array(most[has])], names=["tokenizer", "n_tokens", "most"])
            by = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *has.sum(1)]), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in carried], by], names=[*carried, "by"])

    kinds = [f"{c} {src.schema[c].dataType.simpleString()}" for c in carried]
    return src.mapInArrow(run, ", ".join([*kinds, "by array<struct<tokenizer string, n_tokens long, most long>>"]))


def counts(corpus: DataFrame, tokenizers: list[Tokenizer]) -> DataFrame:
    """tokenizer, language, token (an id as a string), cnt; summed in each worker before the one shuffle."""
    names, of = [t.name for t in tokenizers], [(t.ids, t.parts) for t in tokenizers]
    src = _texts(corpus).select("language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str | None], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (name, language), c in held.items():
                ids = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array([language] * len(ids), pa.string()), pa.array(ids), pa.array(c[ids])], names=["tokenizer", "language", "id", "cnt"])
            held.clear()

        for b in slices(batches, "text"):
            languages = b["language"].to_pylist()
            rows: dict[str | None, list[int]] = {}
            for i, x in enumerate(languages):
                rows.setdefault(x, []).append(i)
            order = [i for at in rows.values() for i in at]
            texts = b["text"].to_pylist()
            for name, (ids, n) in zip(names, encoded([texts[i] for i in order], of), strict=True):
                upto, at = [0, *np.cumsum(n).tolist()], 0
                for language, those in rows.items():
                    c = np.bincount(ids[upto[at] : upto[at + len(those)]])
                    at += len(those)
                    old = held.get((name, language), c[:0])
                    if len(old) < len(c):
                        old, c = c, old
                    old[: len(c)] += c
                    held[name, language] = old
                    if sum(map(len, held.values())) > HELD:
                        yield from out()
        yield from out()

    x = src.mapInArrow(run, f"tokenizer string, language {src.schema['language'].dataType.simpleString()}, id long, cnt long")
    return x.groupBy("tokenizer", "language", "id").agg(F.sum("cnt").alias("cnt")).select("tokenizer", "language", F.col("id").cast("string").alias("token"), "cnt")


def library_facts(corpus: DataFrame, tokenizers: list[Tokenizer], sizes: DataFrame | None = None, measure: Measure = Measure()) -> Facts:
    """The facts of encode()'s tokens; a text leaves its worker once, not once a tokenizer."""
    if len({t.name for t in tokenizers}) < len(tokenizers):
        raise ValueError("tokenizer names repeat")
    x = numbers(corpus, tokenizers, "language", "doc_id", "text")
    docs = x.select("language", "doc_id", "by", *text_facts(F.col("text"), measure))
    docs = docs.select("*", F.explode("by").alias("t")).select("t.tokenizer", "language", "doc_id", "t.n_tokens", "n_units", "n_chars", "n_lines", "has_text")
    return Facts(docs, counts(corpus, tokenizers), sizes, measure)
