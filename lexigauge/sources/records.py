"""Records of large JSON files, read by byte range: arrays of objects, and objects of such arrays.

A file is cut at closing braces by Spark's text reader, so its blocks are read in parallel whatever its lines.
Whether a block begins inside a string, and how deep, depends on all before it, so a first pass
sums up each block for either case, the few numbers of blocks are put together in file order, and a second pass
finds the records. A record that goes over the end of a block is joined from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, CLOSE = re.compile(r'["\[\]{}]'), re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


class Scanner:
    """Follows strings and brackets over pieces of JSON. Objects directly at depth base are records."""

    def __init__(self, in_string: bool = False, depth: int = 0, base: int | None = None, key: str | None = None):
        self.in_string, self.depth, self.base = in_string, depth, base
        self.keys: dict[int, str | None] = {} if base is None else {base - 1: key}
        self.string: list[str] = []
        self.last: str | None = None
        # parts of the record that is open; a block that begins inside one has its first part
        self.open: list[str] | None = [] if base is not None and (depth > base or in_string and depth >= base) else None

    def feed(self, piece: str) -> Iterator[str]:
        """The records that end in piece."""
        at = begin = 0
        while True:
            if self.in_string:
                m = CLOSE.match(piece, at)
                if not m:
                    self.string.append(piece[at:])
                    break
                self.string.append(piece[at : m.end() - 1])
                self.last, self.string, self.in_string, at = "".join(self.string), [], False, m.end()
                continue
            m = MARK.search(piece, at)
            if not m:
                break
            c, at = m.group(), m.end()
            if c == '"':
                self.in_string = True
            elif c in "[{":
                if c == "[":
                    self.keys[self.depth] = self.last
                elif self.depth == self.base:
                    self.open, begin = [], m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if c == "}" and self.depth == self.base and self.open is not None:
                    yield "".join([*self.open, piece[begin:at]])
                    self.open = None
        if self.open is not None:
            self.open.append(piece[begin:])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(file, block) and its pieces, each with the brace that it was cut at; behind a file's end that brace is one too many, and nothing follows."""
    rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    for k, own in groupby(rows, key=lambda r: r[:2]):
        yield k, (r[2] + "}" for r in own)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), pieces in _blocks(batches):
        cases, first = [Scanner(False), Scanner(True)], None
        for p in pieces:
            first = first or (p.lstrip()[:1] or None)
            for s in cases:
                for _ in s.feed(p):
                    pass
        ends = [{"in_string": s.in_string, "depth": s.depth, "keys": {str(d): k for d, k in s.keys.items()}} for s in cases]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, block, first or "", json.dumps(ends))], names=["file", "block", "first", "ends"])


def starts(summaries: list[tuple[str, int, str, str]]) -> dict[tuple[str, int], tuple[bool, int, int, str | None]]:
    """(file, block) to how it begins: inside a string or not, depth, the depth of records, the key that its array is under."""
    out = {}
    for file, own in groupby(sorted(summaries), key=lambda r: r[0]):
        state, base = (False, 0, None), None
        for _, block, first, ends in own:
            if base is None:
                base = {"[": 1, "{": 2}.get(first)
                if base is None:
                    raise ValueError(f"{file} is neither an array nor an object of arrays")
            inside, depth, key = state
            out[file, block] = (inside, depth, base, key)
            end = json.loads(ends)[int(inside)]
            # an array that opens at depth 1 of an object of arrays has a new key
            state = (end["in_string"], depth + end["depth"], end["keys"].get(str(1 - depth), key) if base == 2 else None)
    return out


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, i, key, record: every object of an array (key null), or of the arrays of an object by key.

    file, block and i tell records apart and order them. One row a block passes through the driver.
    """
    raw = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = raw.mapInArrow(_summaries, "file string, block long, first string, ends string").collect()
    begins = starts([tuple(r) for r in found])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (file, block), pieces in _blocks(batches):
                inside, depth, base, key = begins[file, block]
                s, i = Scanner(inside, depth, base, key), 0
                # what was open when the block began is no whole record
                part = s.open is not None
                name = lambda: json.loads(f'"{s.keys.get(1)}"') if base == 2 and s.keys.get(1) is not None else None  # noqa: B023, E731
                for p in pieces:
                    for r in s.feed(p):
                        if part:
                            part = False
                            yield file, block, -1, None, "end", r
                        else:
                            yield file, block, i, name(), "whole", r
                            i += 1
                if s.open is not None:
                    # begins here, or goes through the whole block
                    yield file, block, i, name(), "through" if part else "begin", "".join(s.open)

        out: list[tuple] = []
        size = 0
        for r in rows():
            out.append(r)
            size += len(r[5])
            if size > 1 << 22:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    schema = "file string, block long, i long, key string, kind string, record string"
    parts = raw.mapInArrow(records, schema)
    whole = parts.where("kind = 'whole'").drop("kind")

    def join(rows: pa.Table) -> pa.Table:
        made, held = [], None
        for r in sorted(rows.to_pylist(), key=lambda r: (r["block"], r["i"])):
            if r["kind"] == "begin":
                held = r | {"record": [r["record"]]}
            elif held is not None:
                held["record"].append(r["record"])
                if r["kind"] == "end":
                    made.append(held | {"record": "".join(held["record"])})
                    held = None
        return pa.Table.from_pylist([{k: v for k, v in r.items() if k != "kind"} for r in made], schema=pa.schema([f for f in rows.schema if f.name != "kind"]))

    # two parts a block at most
    cut = parts.where("kind <> 'whole'").groupBy("file").applyInArrow(join, "file string, block long, i long, key string, record string")
    return whole.unionByName(cut)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "block", "i", "key", "kind", "record"])
