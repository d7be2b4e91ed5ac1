"""Whole-text byte-level BPE by the tokenizers library, with results kept per chunk.

A space after a character that is not white space always begins a new pre-token, and a line's
end between two such characters is one of its own, so a text falls into chunks that encode
alike wherever they stand. Texts repeat their chunks, so each worker encodes a chunk once and then looks it up. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``; tests compare the two.
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

from .common import cached_in_worker

#: Chunks in each of the two generations that a worker keeps: about 130 MB each at most.
KEEP = 600_000
#: Space not preceded by white space (Python's, a superset of the library's).
CUT = re.compile(r"(?<=\S)(?= )")
#: Chunks of letters up to U+024F, of which every Unicode version agrees that they are letters, and ASCII marks but the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


ID = attrgetter("id")
#: The last letter of PLAIN; letters below it that PLAIN leaves out; marks that often end words.
LAST_LATIN, RARE, MARKS = "ɏ", re.compile("[ªµº]").search, frozenset(".,;:!?")


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE shows for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}


class Unsafe(Exception):
    """A chunk that ends in white space: the split at single spaces doesn't hold for its text."""


class Encoder(dict):
    """Chunk (without its leading space, or with the line's end that it begins with) to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = byte_chars()
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}
        self.old: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {"": b""}
        self.stops: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def stop(self, text: str) -> bytes:
        if text not in self.stops:
            if len(self.stops) > 10_000:
                self.stops = {"": b""}
            self.stops[text] = self.whole(text)
        return self.stops[text]

    def start(self, first: str) -> bytes:
        """What stands before a text's first space."""
        if first not in self.starts:
            if len(self.starts) > 10_000:
                self.starts = {"": b""}
            # letters alone are one pre-token; longer beginnings are seldom seen twice
            if not (m := PLAIN(first)):
                return self.whole(first)
            ids = self.letters("", m[1])
            if m[2]:
                return ids + self.stop(m[2])
            self.starts[first] = ids
        return self.starts[first]

    def letters(self, space: str, word: str) -> bytes:
        """One pre-token, given to the model without the library's pattern search."""
        shown = word if word.isascii() else word.translate(self.shown)
        return array("I", map(ID, self.model.tokenize(space + shown))).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) <= LAST_LATIN and not RARE(chunk)):
                ids = self.letters("Ġ", chunk)
            elif chunk[-1:] in MARKS and (word := chunk[:-1]).isalpha() and word.isascii():
                # a word before a mark is a chunk that other places have without one
                ids = self[word] + self.stop(chunk[-1])
            elif not chunk or chunk[-1].isspace():
                raise Unsafe
            elif chunk[0] == "\n":
                if chunk[1].isspace():
                    raise Unsafe
                ids = self.stop("\n") + self.start(chunk[1:])
            elif m := PLAIN(chunk):
                ids = self[m[1]] + self.stop(m[2])
            else:
                ids = self.whole(" " + chunk)
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of text."""
        if not text:
            return b""
        try:
            first, *rest = text.replace("\n", " \n").split(" ")
            if first[-1:].isspace():
                raise Unsafe
            return self.start(first) + b"".join(map(self.__getitem__, rest))
        except Unsafe:
            first, *rest = CUT.split(text)
            if not rest:
                return self.whole(first)
            last = rest.pop()
            return self.whole(first) + b"".join([self.whole(x) if x[1].isspace() else self[x[1:]] for x in rest]) + (self.whole(last) if last[-1].isspace() or last[1].isspace() else self[last[1:]])


def encoder(path: str) -> Encoder:
    return cached_in_worker(f"encoder:{path}", lambda: Encoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
