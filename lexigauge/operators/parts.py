"""Texts by stored tokenizers, part by part, in the worker of a task.

Before a space or a line's end behind a character that shows, the tokenizers from files end a token
(those that say so), so a text falls into parts that encode alike wherever they stand. Texts repeat their parts: a worker
gives each to the libraries once, keeps its ids as numbers in arrays, and puts the ids of whole texts together from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np

#: Characters (or ids) that a library gets at once, a text at least: what it holds of its results is many times as large.
AT_ONCE = 1 << 18
#: Parts that a worker keeps with their ids by all tokenizers of a pass (about 120 MB for four), and characters of them.
KEEP, KEEP_CHARS = 400_000, 8_000_000
#: Characters that show: letters of Latin script and what ASCII prints, but space.
SHOWN = "!-~À-ÖØ-öø-ɏ"
SHOWS = frozenset(c for c in map(chr, range(0x250)) if re.match(f"[{SHOWN}]", c))
CUT = re.compile(f"(?<=[{SHOWN}])(?=[ \n])")

#: Parts and whether each begins its text, to their lists of ids. Equal ones (by ==) give equal ids.
Encoder = Callable[[list[str], list[bool]], list]


def portions(items: list, size: int = AT_ONCE) -> Iterator[list]:
    """Items that are not None, in lists of about size characters or ids."""
    held, n = [], 0
    for x in items:
        if x is None:
            continue
        held.append(x)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def laid(lists: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and how many each has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n


class Apart(Exception):
    """Texts with white space behind what does not show: the pattern decides where they fall apart."""


class Parts(dict):
    """Part to its number. A part that begins with one space is written without it; those that begin a text have numbers of their own."""

    def __init__(self, encoders: Sequence[Encoder]):
        super().__init__()
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.firsts: dict[str, int] = {}
        self.lasts: dict[str, int] = {}  # parts that end their text with what doesn't show: no place to cut behind
        self.new: list[str] = []
        self.begins: list[bool] = []
        self.chars = self.count = 0
        self.ids = [np.zeros(0, np.int32) for _ in self.encoders]
        self.ends = [np.zeros(1, np.int64) for _ in self.encoders]

    def add(self, held: dict, key: str, part: str) -> int:
        held[key] = n = self.count
        self.count += 1
        self.new.append(part)
        self.begins.append(held is self.firsts)
        self.chars += len(part)
        return n

    def __missing__(self, key: str) -> int:
        if key[-1:] not in SHOWS:
            raise Apart
        return self.add(self, key, key if key[0] == "\n" else " " + key)

    def first(self, part: str) -> int:
        return self.firsts[part] if part in self.firsts else self.add(self.firsts, part, part)

    def split(self, text: str) -> np.ndarray:
        """The numbers of a text's parts in order."""
        if not text:
            return np.zeros(0, np.int64)
        # a line's end is set apart like a space; a part that doesn't end in what shows leaves it to the pattern
        begin, *rest = text.replace("\n", " \n").split(" ")
        try:
            if begin[-1:] not in SHOWS:
                raise Apart
            inner = np.fromiter(map(self.__getitem__, rest), np.int64, len(rest))
        except Apart:
            begin, *rest = CUT.split(text)
            keys = [x[1:] if x[0] == " " and x[1:2] and not x[1].isspace() else x for x in rest]
            into = [self if k[-1] in SHOWS else self.lasts for k in keys]
            inner = np.array([d[k] if k in d else self.add(d, k, x) for d, k, x in zip(into, keys, rest, strict=True)], np.int64)
        return np.concatenate([[self.first(begin)], inner])

    def settle(self) -> None:
        """Ids of the parts that are new."""
        if not self.new:
            return
        new, begins = self.new, self.begins
        self.new, self.begins = [], []
        for k, encoder in enumerate(self.encoders):
            at, ids, ends = 0, [self.ids[k]], [self.ends[k]]
            for few in portions(new):
                flat, n = laid(encoder(few, begins[at : at + len(few)]))
                at += len(few)
                ids.append(flat)
                ends.append(ends[-1][-1] + np.cumsum(n))
            self.ids[k], self.ends[k] = np.concatenate(ids), np.concatenate(ends)

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of the texts, one after the other, and how many each text has."""
        if self.count > KEEP or self.chars > KEEP_CHARS:
            self.forget()
        each = [self.split(t) for t in texts]
        self.settle()
        at = np.concatenate(each) if each else np.zeros(0, np.int64)
        stops = np.cumsum([0, *map(len, each)])
        out = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            starts = ends[at]
            n = ends[at + 1] - starts
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append((ids[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], n)], np.diff(upto[stops])))
        return out


@lru_cache(maxsize=1)
def _kept(encoders: tuple[Encoder, ...]) -> Parts:
    return Parts(encoders)


def encoded(texts: list[str], tokenizers: Sequence[tuple[Any, Any]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of (ids, parts), a function of whole texts and one of parts or None: the ids of the texts one after the other, and how many each has."""
    by_part = iter(_kept(tuple(p for _, p in tokenizers if p is not None)).encode(texts) if any(p is not None for _, p in tokenizers) else [])
    return [next(by_part) if p is not None else laid([x for few in portions(texts) for x in ids(few)]) for ids, p in tokenizers]
