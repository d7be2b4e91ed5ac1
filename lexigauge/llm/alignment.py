"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

DuckDB runs in each Arrow partition on token interval tables: ASOF joins find the first and the
last token that overlaps another, a range over the places between them gives the links, and window
sums over shared ends number the groups. Texts fall into chunks at white space that both
tokenizers end a token before, so an alignment is made once for each chunk that a worker
meets and is put together for whole texts. Counts of id pairs are partial for each block of
texts and merged in Spark; the merged counts return to the blocks that hold the pair, so
neither they nor the texts pass through one task or the driver.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte
for byte, have no tokens (zeros and ''); very long texts are read whole and are a block of
their own; ids are carried, never compared, so null and repeated ids and repeated rows keep a row each; ties for the highest
count are all best; an empty table gives an empty one; other columns of the caller are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached_in_worker, portions, stored
from .encode import PLAIN, Encoder, Unsafe, byte_chars, default_tokenizer

#: Chunks that a worker keeps, and bytes of text in a block: both bound memory, neither changes a result.
KEEP, BLOCK = 400_000, 16 << 20
#: White space before which both tokenizers end a token: after a character that is not white space, a space, or a line's end with such a character behind it.
CUT = re.compile(r"(?<=\S)(?= |\n\S)")

#: a(i, id, s, e) and b(j, id, s, e): tokens of all chunks laid end to end, by byte; c is the chunk.
LINKS = """
WITH link AS (SELECT a.c, a.i, a.id, unnest(range(first.j, last.j + 1)) AS j FROM a ASOF JOIN b first ON a.s >= first.s ASOF JOIN b last ON a.e > last.s)
SELECT link.c AS c, (CAST(link.id AS BIGINT) << 32) | b.id AS pair FROM link JOIN b USING (j) ORDER BY i, j
"""
#: Whether a token is its group's last, and how many groups end before it, on one side and the other.
GROUPS = """
WITH ends AS (SELECT {place}, CAST(e IN (SELECT e FROM {other}) AS INT) AS last FROM {side})
SELECT last, CAST(sum(last) OVER (ORDER BY {place} ROWS UNBOUNDED PRECEDING) - last AS BIGINT) AS g FROM ends ORDER BY {place}
"""


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Chunks(dict):
    """Chunk to its number; new ones wait for align().

    A chunk is written without its leading space, unless nothing or another white space follows that.
    """

    def __init__(self, a: str, b: str):
        import duckdb
        import sentencepiece

        super().__init__()
        self.a = Encoder(a)
        self.a.tokenizer.encode_special_tokens = True
        plain = {c: x for x, c in byte_chars().items()}
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        shown = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode() for t in shown]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁|[\n]", p) for p in pieces):
            raise ValueError("a piece goes on behind white space, so texts have no chunks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # no folder to spill to: what a call joins is bounded
        self.sql = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # tokens of a, tokens of b, groups, links; negative: not given back byte for byte
        self.pairs = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[-1].isspace():
            raise Unsafe
        return self.add(chunk)

    def add(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def split(self, text: str) -> np.ndarray:
        """The numbers of a text's chunks in order."""
        # a line's end is set apart like a space; where white space meets white space, the pattern decides
        chunks = text.replace("\n", " \n").split(" ")
        try:
            return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        except Unsafe:
            chunks = [x[1:] if x[0] == " " and x[1:2] and not x[1].isspace() else x for x in CUT.split(" " + text)]
            return np.array([self[x] if x in self else self.add(x) for x in chunks], np.int64)

    def ids_a(self, chunk: str) -> bytes:
        space, word = ("\n", chunk[1:]) if chunk[0] == "\n" else ("Ġ", chunk)
        if m := PLAIN(word):
            ids = self.a.letters("Ġ", m[1]) if space == "Ġ" else self.a.stop(space) + self.a.letters("", m[1])
            return ids + self.a.stop(m[2]) if m[2] else ids
        return self.a.whole(chunk if chunk[0] in " \n" else " " + chunk)

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        out = self.b.encode([x[1:] if x[0] == " " else x for x in chunks], num_threads=1)
        # the space that it puts before a line's end is a token of its own, and is not in the text
        return [[self.space] if x == " " else ids[1:] if x[0] == "\n" and ids[:1] == [self.space] else ids for x, ids in zip(chunks, out, strict=True)]

    def align(self) -> None:
        """Facts, groups and pairs of the chunks that are new."""
        if not self.new:
            return
        new, self.new = self.new, []
        raw, listed = list(map(self.ids_a, new)), self.ids_b(new)
        a, b = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array(list(chain.from_iterable(listed)), np.int64)
        n = np.array([[len(x) // 4 for x in raw], list(map(len, listed))])
        texts = [(x if x[0] in " \n" else " " + x).encode() for x in new]
        ok = np.ones(len(new), bool)
        for ids, k, held in ((a, n[0], self.a_bytes), (b, n[1], self.b_bytes)):
            if b"".join([held[i] for i in ids.tolist()]) != b"".join(texts):
                ends = np.cumsum(k).tolist()
                ok &= [b"".join([held[i] for i in ids[e - m : e].tolist()]) == x for e, m, x in zip(ends, k.tolist(), texts, strict=True)]
        facts = np.where(ok, n, -(1 << 40))
        a, b, n = a[np.repeat(ok, n[0])], b[np.repeat(ok, n[1])], n * ok
        self.sql.register("a", intervals(a, n[0], self.a_bytes, "i"))
        self.sql.register("b", intervals(b, n[1], self.b_bytes, "j"))
        links = self.sql.execute(LINKS).fetchnumpy()
        in_a = self.sql.execute(GROUPS.format(side="a", other="b", place="i")).fetchnumpy()
        in_b = self.sql.execute(GROUPS.format(side="b", other="a", place="j")).fetchnumpy()
        self.sql.unregister("a")
        self.sql.unregister("b")
        pairs, n_pairs = links["pair"].astype(np.int64), np.bincount(links["c"].astype(np.int64), minlength=len(new))
        # a group's tokens of a, then those of b, each written with what stands behind it
        shown = [f"{i}{'|' if x else ','}" for i, x in zip(a.tolist(), in_a["last"].tolist(), strict=True)] + [f"{i}{';' if x else ','}" for i, x in zip(b.tolist(), in_b["last"].tolist(), strict=True)]
        order = np.argsort(np.concatenate([in_a["g"] * 2, in_b["g"] * 2 + 1]), kind="stable")
        shown = [shown[i] for i in order.tolist()]
        ends = np.cumsum(n.sum(0)).tolist()
        groups = ["".join(shown[x:y])[:-1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        n_groups = np.bincount(np.repeat(np.arange(len(new)), n[0]), weights=in_a["last"].astype(float), minlength=len(new)).astype(np.int64)
        facts = np.stack([*facts, n_groups, n_pairs], 1)
        self.groups += groups
        self.facts = np.concatenate([self.facts, facts])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n_pairs)])

    def links(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the chunks, one after the other, and how many each chunk has."""
        n = self.at[chunks + 1] - self.at[chunks]
        ends = np.cumsum(n)
        return self.pairs[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.at[chunks] - (ends - n), n)], n


def intervals(ids: np.ndarray, n: np.ndarray, token_bytes: list[bytes], place: str) -> pa.Table:
    """Tokens as intervals of bytes on one line that holds all chunks."""
    ends = np.cumsum(np.array([len(token_bytes[i]) for i in ids.tolist()], np.int64))
    starts = np.concatenate([[0], ends])[:-1]
    return pa.table({"c": np.repeat(np.arange(len(n)), n), place: np.arange(len(ids)), "id": ids, "s": starts, "e": ends})


PARTS = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair binary, times binary, pairs array<long>, holds array<long>"


def parts(docs: DataFrame, id_col: str, text_col: str, a: str, b: str, with_groups: bool) -> DataFrame:
    """A row a text, and a row a block (its id null) with its pairs in order and how many of its texts hold each.

    pair and times of a text: which of its block's pairs it holds, and how often, as little-endian integers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Chunks = cached_in_worker(f"chunks:{a}:{b}", lambda: Chunks(a, b))
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0
        ids: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, rows, size, ids
            all_ids = pa.chunked_array(ids).combine_chunks()
            yield from finished(chunks, block, all_ids, rows)
            block, rows, size, ids = block + 1, [], 0, []
            if len(chunks) > KEEP:
                chunks.forget()

        def finished(chunks: Chunks, block: int, all_ids: pa.Array, rows: list) -> Iterator[pa.RecordBatch]:
            met = np.unique(np.concatenate([x[3] for x in rows]))
            keys, n = chunks.links(met)
            known, number = np.unique(keys, return_inverse=True)
            at = np.concatenate([[0], np.cumsum(n)])
            holds = np.zeros(len(known), np.int64)
            pair, times = [], []
            for *_, own, count in rows:
                k = np.searchsorted(met, own)
                m = n[k]
                ends = np.cumsum(m)
                mine = number[np.arange(ends[-1] if len(m) else 0) + np.repeat(at[k] - (ends - m), m)]
                order = np.argsort(mine, kind="stable")
                mine, count = mine[order], np.repeat(count, m)[order]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                pair.append(mine[first].astype("<i4").tobytes())
                times.append((np.add.reduceat(count, first) if len(first) else first).astype("<i4").tobytes())
                holds[mine[first]] += 1
            for k in range(0, len(rows), 1024):
                own = rows[k : k + 1024]
                facts = np.array([x[0] for x in own], np.int64).reshape(-1, 4)
                cols = [pa.array([block] * len(own), pa.int64()), *(pa.array(facts[:, i]) for i in range(4))]
                cols += [pa.array([x[i] for x in own], pa.string()) for i in (1, 2)]
                cols += [pa.array(pair[k : k + 1024], pa.binary()), pa.array(times[k : k + 1024], pa.binary())]
                none = pa.nulls(len(own), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([all_ids.slice(k, len(own)), *cols, none, none], names=["id", *names])
            cols = [pa.nulls(1, all_ids.type), pa.array([block]), *(pa.nulls(1, pa.int64()) for _ in range(4)), *(pa.nulls(1, pa.string()) for _ in range(2)), *(pa.nulls(1, pa.binary()) for _ in range(2))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.list_(pa.int64())) for x in (known, holds))], names=["id", *names])

        for batch in portions(batches, 1):
            split = [chunks.split(x) if x else None for x in batch.column(1).to_pylist()]
            chunks.align()
            for own in split:
                facts, groups = np.zeros(4, np.int64), ""
                if own is None or (facts := chunks.facts[own].sum(0))[0] < 0:
                    facts, own = np.zeros(4, np.int64), np.zeros(0, np.int64)
                else:
                    groups = ";".join(map(chunks.groups.__getitem__, own.tolist()))
                sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                rows.append((facts, sha, groups if with_groups else None, *np.unique(own, return_counts=True)))
            ids.append(batch.column(0))
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield from flush()
        if rows:
            yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, {PARTS}")


def merged(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, place, pair) of the blocks, and pair, n_docs, best of the corpus."""
    held = made.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "holds")).alias("place", "x")).select("block", "place", "x.pairs", "x.holds")
    total = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holds").alias("n_docs")).withColumn("a_id", F.shiftright("pair", 32))
    # as many rows as the first tokenizer has ids
    most = total.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    best = total.join(F.broadcast(most), "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    return held.select("block", "place", F.col("pairs").alias("pair")), best


def pair_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """a_id, b_id, n_docs, best: how many texts hold the two ids linked, and whether that is the most for a_id."""
    made = stored(parts(docs, id_col, text_col, a or default_tokenizer(), b or default_pieces(), False), "alignment")
    return merged(made)[1].select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n_docs", "best")


def aligned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, with_groups: bool = False) -> DataFrame:
    """A row a text: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    a: a byte-level BPE file of tokenizers, given a space and the text; b: a SentencePiece model that puts the space itself.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    made = stored(parts(docs, id_col, text_col, a or default_tokenizer(), b or default_pieces(), with_groups), "alignment")
    held, total = merged(made)
    back = held.join(total, "pair").select("block", "place", "n_docs", "best")
    texts = made.where("pairs is null").drop("pairs", "holds").withColumn("of", F.col("block") + 0).drop("block")
    shown = ["groups"] if with_groups else []

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        place = counts["place"].to_numpy()
        n_docs[place], best[place] = counts["n_docs"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
        n_best, count_sum = [], []
        for pair, times in zip(texts["pair"].to_pylist(), texts["times"].to_pylist(), strict=True):
            k, m = np.frombuffer(pair, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
            n_best.append(int(best[k] @ m))
            count_sum.append(int(n_docs[k] @ m))
        out = {x: texts[x] for x in ("id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(out | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())} | {x: texts[x] for x in ("groups_sha256", *shown)})

    out = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    scored = texts.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(score, f"id {id_type}, {out}")
    return scored.withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return aligned(docs)
