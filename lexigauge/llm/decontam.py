"""Benchmark decontamination by one Aho-Corasick automaton.

Questions and answers are normalised to words, cut into windows of 13 words, and all
windows go into a single automaton whose alphabet is the set of benchmark words. Each
text is scanned once; a match gives word positions, which map back to code points of the
original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, OWN, annotate, cached_in_worker, stored

#: What one automaton may hold, in bytes of benchmark text; beyond it the items are dealt over several passes.
MAX_BYTES = 8_000_000
#: Words of the original text: the same as ALNUM and split().
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def windows_of(items: list[tuple[str | None, bytes | None]], window: int) -> dict[tuple[bytes, ...], list[str | None]]:
    """Windows and the items that hold them; an item shorter than a window is one window."""
    out: dict[tuple[bytes, ...], list[str | None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held = out.setdefault(tuple(w[i : i + window]), [])
            if not held or held[-1] != item:
                held.append(item)
    return out


class Automaton:
    """Patterns over word numbers; number 0 is any word that no pattern has."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        import ahocorasick

        found = windows_of(items, window)
        self.ids = {w: i for i, w in enumerate(sorted({w for k in found for w in k}), 1)}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, held in found.items():
            self.auto.add_word(tuple(self.ids[w] for w in k), (len(k), held))
        self.any = bool(found)
        if found:
            self.auto.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Word count, merged runs of hit words (end exclusive), items found."""
        w = words(text)
        if not self.any or not w:
            return len(w), [], set()
        get = self.ids.get
        runs: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for end, (n, held) in self.auto.iter(tuple([get(x, 0) for x in w])):
            items.update(held)
            start = end - n + 1
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, end + 1))
        return len(w), runs, items


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[int]:
    """Runs of words as code points of the original text: start, end, start, end, ..."""
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return list(chain.from_iterable((at[a][0], at[b - 1][1]) for a, b in runs))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanner(items: list[tuple[str | None, bytes | None]], window: int) -> Callable[[], Callable]:
    key = "decontam:" + hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def make() -> Callable:
        auto = cached_in_worker(key, lambda: Automaton(items, window))

        def f(texts: list[bytes | None]) -> list[list]:
            n, hit, found, at = [], [], [], []
            for text in texts:
                k, runs, held = auto.scan(text)
                n.append(k)
                hit.append(list(chain.from_iterable(runs)))
                found.append(sorted(held, key=lambda x: (x is None, x or "")))
                at.append(spans(text, runs) if runs else [])
            return [n, hit, found, at]

        return f

    return make


def grouped_items(bench: DataFrame, item_col: str, text_col: str, max_bytes: int):
    """The benchmark in groups of bounded size, one at a time on the driver."""
    b = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_bytes) or 1
    for g in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g)
        yield n, sorted({(r["item"], r["text"].encode()) for r in part.collect()}, key=lambda x: (x[0] is None, x[0] or "", x[1]))


def contamination(
    docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """docs with OWN-prefixed n_words, n_hit, n_items, items, spans, contaminated.

    spans are code points of the original text (start, end, ...). A document is
    contaminated when a word is hit and share * n_hit >= n_words. Null and empty texts
    have no words; items with a null text take no part; repeated items count once by id, and
    all items with a null id as one, which is null in items; repeated documents are scanned each for itself; an empty benchmark hits nothing.
    Benchmarks beyond max_bytes are scanned in several passes of bounded automata, and the
    hits of the passes are merged.
    """
    fields = [("n_words", "long"), ("runs", "longs"), ("items", "strings"), ("spans", "longs")]
    run_type = "array<bigint>"
    out, own = docs, [OWN + n for n, _ in fields]
    for k, (passes, items) in enumerate(grouped_items(bench, item_col, item_text_col, max_bytes)):
        out = annotate(out, text_col, fields, scanner(items, window))
        if passes > 1:
            for c in (own[1], own[2], own[3]):
                out = out.withColumn(f"{c}_{k}", F.col(c))
            out = stored(out.drop(*own[1:], *([own[0]] if k + 1 < passes else [])), "decontam")
    if own[1] not in out.columns:
        held = lambda c: F.concat(*(F.col(f"{c}_{i}") for i in range(passes)))
        # runs of several passes may overlap: sort pairs by start and fold them
        def fold(c: str):
            pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(held(c)) / 2 - 1).cast("int")), lambda i: F.struct(held(c)[(i * 2).cast("int")].alias("a"), held(c)[(i * 2 + 1).cast("int")].alias("b"))))
            empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
            step = lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
            ).otherwise(F.concat(acc, F.array(x)))
            return F.when(F.size(held(c)) == 0, F.array().cast(run_type)).otherwise(F.flatten(F.transform(F.aggregate(pairs, empty, step), lambda x: F.array(x["a"], x["b"]))))

        out = out.withColumns({own[1]: fold(own[1]), own[2]: F.array_sort(F.array_distinct(held(own[2]))), own[3]: fold(own[3])})
        out = out.drop(*(f"{c}_{i}" for c in own[1:] for i in range(passes)))
    runs = F.col(OWN + "runs")
    n_hit = F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        out.withColumn(OWN + "n_hit", n_hit)
        .withColumn(OWN + "n_items", F.size(OWN + "items").cast("long"))
        .withColumn(OWN + "contaminated", (F.col(OWN + "n_hit") > 0) & (F.col(OWN + "n_hit") * share >= F.col(OWN + "n_words")))
        .drop(OWN + "runs")
    )


def digest(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, from contamination()."""
    x = contamination(docs.select(id_col, "text"), bench)
    o = lambda c: F.col(OWN + c).alias(c)
    return x.select(F.col(id_col), o("n_words"), o("n_hit"), o("n_items"), F.sha2(F.array_join(OWN + "items", ","), 256).alias("items_sha256"), o("contaminated"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    return contamination(docs, bench).where(~F.col(OWN + "contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
