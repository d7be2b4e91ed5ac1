"""Best-fit packing by patterns and non-negative least squares.

Everything that decides is done on the histogram of piece lengths, which has at most
``size`` entries whatever the input: patterns of few lengths that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least squares,
rounded, and what is left is packed best fit, still by counts. Pieces then find their
place by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, stored
from .encode import default_tokenizer, encoder

SIZE, END = 1024, 2
#: Patterns offered to the fit: the fullest and most usable come first.
MAX_PATTERNS = 12_000
#: All pieces over this many buckets are numbered within a length; no length can outgrow a task.
BUCKET = 4096


def cut(df: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, end: int | None) -> DataFrame:
    """Pieces of the encoded texts: id, piece, start, length, ids_crc32; of a longer text, the first piece is the short one."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        last = b"" if end is None else np.array([end], "<u4").tobytes()
        for b in portions(batches, 1):
            rows, out = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                raw = enc.encode(x or "") + last
                n = len(raw) // 4
                first = n if n <= size else n % size or size
                at = [0, *range(first, n + 1, size)] if n else [0, 0]
                for k, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                    rows.append(i)
                    out.append((k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, size: int, most: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Full patterns of one to three lengths that occur, descending in each; those whose scarcest length is most frequent come first.

    Where no third length fits exactly, the longest that fits is taken, so that sparse
    histograms have patterns too.
    """
    have = np.flatnonzero(counts)
    have = have[(have > 0) & (have <= size)].tolist()
    out: set[tuple[int, ...]] = {(size,)} if counts[size] else set()
    for i, a in enumerate(have):
        k = bisect_left(have, size - a + 1)
        if k and have[k - 1] <= a:
            out.add((a, have[k - 1]))
        for b in have[: i + 1]:
            rest = size - a - b
            if rest > 0 and (k := bisect_left(have, rest + 1)) and have[k - 1] <= b and size - a - b - have[k - 1] <= size // 64:
                out.add((a, b, have[k - 1]))
    use = lambda p: (-min(counts[x] // p.count(x) for x in p), size - sum(p), p)
    pairs = [p for p in out if len(p) < 3]
    return sorted(pairs, key=use) + sorted((p for p in out if len(p) == 3), key=use)[: max(0, most - len(pairs))]


def nnls(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, goal: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """min |Ax - goal| for x >= 0 and a sparse non-negative A, by scaled multiplicative steps.

    Each step multiplies x by A'goal / A'Ax, which keeps x non-negative and never raises
    the residual.
    """
    x = np.ones(n)
    up = np.bincount(cols, vals * goal[rows], n)
    for _ in range(rounds):
        ax = np.bincount(rows, vals * x[cols], len(goal))
        x *= up / np.maximum(np.bincount(cols, vals * ax[rows], n), 1e-12)
    return x


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up the histogram exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    offered = patterns(left, size)
    if offered:
        cols = np.repeat(np.arange(len(offered)), [len(p) for p in offered])
        rows = np.array([x for p in offered for x in p])
        # short lengths weigh less: they fit anywhere later
        weight = np.sqrt(np.arange(size + 1) / size)
        scale = max(1, left.sum())
        x = nnls(rows, cols, weight[rows], weight * left / scale, len(offered)) * scale
        for j in np.argsort(-x, kind="stable"):
            p = offered[j]
            if x[j] < 0.5:
                break
            times = min(int(x[j] + 0.5), *(int(left[k]) // p.count(k) for k in p))
            if times > 0:
                out.append((p, times))
                for k in p:
                    left[k] -= times
    return out + best_fit(left, size)


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: open sequences alike are held as one entry with a number."""
    spaces: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    live: list[int] = []  # spaces with open sequences, ascending

    def put(p: tuple[int, ...], space: int, n: int) -> None:
        if n:
            if not spaces[space]:
                live.insert(bisect_left(live, space), space)
            spaces[space][p] = spaces[space].get(p, 0) + n

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect_left(live, length)
            if k < len(live):
                space = live[k]
                p, m = spaces[space].popitem()
                if not spaces[space]:
                    live.pop(k)
            else:
                space, p, m = size, (), -(-n // (size // length))
            fit = space // length
            full = min(m, n // fit)
            put((*p, *[length] * fit), space - fit * length, full)
            n -= full * fit
            m -= full
            if n and m:  # fewer than fit are left
                put((*p, *[length] * n), space - n * length, 1)
                n, m = 0, m - 1
            if p:
                put(p, space, m)
    return [(p, n) for held in spaces for p, n in held.items()]


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, offset, sequences), ascending by number."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    at = 0
    for p, n in chosen:
        offset = 0
        for length in p:
            k = seen.get(length, 0)
            out.setdefault(length, []).append((k, at, offset, n))
            seen[length] = k + n
            offset += length
        at += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int | None = END) -> DataFrame:
    """Every piece of every document with sequence_id and offset, as the contract has it.

    Null and empty texts have the end id alone; very long texts are cut into as many pieces
    as they need; repeated rows, whose order among themselves does not show, are packed each
    for itself; null ids are packed too; an empty table gives no rows; extra columns are left
    out. No sequence is longer than size, and none has a gap.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    held = stored(cut(src, id_col, "text", tokenizer or default_tokenizer(), size, end), "pieces")
    n = held.count()
    # a length may hold any share of the pieces
    buckets = max(1, -(-n // BUCKET))
    held = held.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most size rows
        counts[r["length"]] = r["n"]
    where = places(plan(counts, size))
    lengths = sorted(where)
    bound = [where[k] for k in lengths]
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    w = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")
    numbered = held.withColumn("k", F.row_number().over(w) - 1).join(before, ["length", "bucket"])
    numbered = numbered.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(zip(lengths, bound, strict=True))
        for b in batches:
            length, k = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for part in np.split(order, edges[1:]) if len(order) else []:
                t = table[int(length[part[0]])]
                row = t[np.searchsorted(t[:, 0], k[part], "right") - 1]
                seq[part] = row[:, 1] + k[part] - row[:, 0]
                off[part] = row[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
