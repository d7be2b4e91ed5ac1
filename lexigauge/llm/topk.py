"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted onto a sphere (one more coordinate makes all norms equal), so that the
largest inner product is the smallest distance. Each vector is keyed by its nearest pivot
and its distance to it; keys are cut into annuli of bounded size, sorted by distance. A
query first searches the annulus it falls into, which bounds its k-th score; then it goes
to every annulus that the triangle inequality cannot exclude, and in each expands from
its own distance outwards until the bound stops it.

Only pivots and a histogram of fixed size go to the driver. Annuli and query chunks are
packed rows of bounded size that meet by joins on their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored
from .sampling import bounded

SCALE = 64
#: Pivots, fitted on about SAMPLE vectors; distance steps of the histogram of each pivot.
PIVOTS, SAMPLE, STEPS = 16, 4_000, 512
#: Vectors of an annulus and queries of a chunk, about.
BLOCK, CHUNK = 16_384, 4_096
#: Vectors scored at a time while an annulus is expanded.
STRIDE = 2_048


def whole(lists: pa.Array, dim: int) -> np.ndarray:
    """floor(64 * x) of valid vectors as rows of dim integers; shorter vectors are filled up with zeros."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    # beyond this an inner product would not fit a long
    most = float(int((2.0**62 / max(dim, 1)) ** 0.5))
    flat = np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    at = 0
    for i, k in enumerate(n.tolist()):
        out[i, :k] = flat[at : at + k]
        at += k
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer rows as they are multiplied: in floating point where all inner products are exact, else as integers."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


@dataclass
class Index:
    """Pivots on the sphere of squared radius norm, and where annuli begin."""

    dim: int
    norm: float
    pivots: np.ndarray  # (P, dim + 1)
    width: float = 1.0
    first: np.ndarray | None = None  # (P, STEPS): annulus number of each distance step
    salts: np.ndarray | None = None  # by annulus: parts it is split into
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    pivot: np.ndarray | None = None

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))]

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries, which lie in the plane of the last coordinate 0: squared norms, distances to pivots, and the
        annulus nearest to each."""
        x = q.astype(np.float64)
        d = self.distances(np.c_[x, np.zeros(len(x))])
        to = d[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.low - to, to - self.high))
        return (x * x).sum(1), d, (gap + 1e-9 * to).argmin(1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(d, 0))

    def keyed(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.distances(self.lifted(v))
        p = d.argmin(1)
        d = d[np.arange(len(v)), p]
        return p, d, np.minimum((d / self.width).astype(np.int64), STEPS - 1)

    def cut(self, counts: np.ndarray) -> None:
        """Annuli from counts (P, STEPS): neighbouring steps up to BLOCK vectors; a fuller step is split into parts."""
        self.first = np.zeros(counts.shape, np.int64)
        low, high, pivot, size = [], [], [], []
        for p in range(len(counts)):
            begun = -1
            for s in np.flatnonzero(counts[p]).tolist():
                if begun < 0 or size[-1] + counts[p, s] > BLOCK:
                    begun = len(size)
                    low.append(s * self.width)
                    high.append(0.0)
                    pivot.append(p)
                    size.append(0)
                size[-1] += int(counts[p, s])
                high[-1] = (s + 1) * self.width if s + 1 < STEPS else float("inf")
                self.first[p, s] = begun
        self.low, self.high, self.pivot = np.array(low), np.array(high), np.array(pivot, np.int64)
        self.salts = np.array([-(-n // BLOCK) for n in size], np.int64)

    def best(self, qq: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The largest inner product at a distance of gap or more, rounded up."""
        return (qq + self.norm - gap * gap) / 2 + 1e-9 * (qq + self.norm) + 1


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a small sample; the first are far apart."""
    at = [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(k, len(x)) and d.max() > 0:
        at.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    c = x[at].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v of the rows that take part."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return x.where(F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))


def fit(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Index | None:
    """Pivots from a bounded sample; the radius and the histogram are over all vectors."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE) * F.floor(x * SCALE))
    r = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(norm2).alias("norm")).first()
    if r["dim"] is None:
        return None
    dim = max(1, r["dim"])
    few = bounded(vectors, sample).toArrow().combine_chunks()
    lists = few["v"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    ids = few["id"].to_numpy()
    v = whole(lists, dim)[np.argsort(ids, kind="stable")]
    index = Index(dim, float(min(r["norm"], 2.0**62)), np.zeros((1, dim + 1)))
    index.pivots = kmeans(index.lifted(v), pivots) if len(v) else index.pivots
    index.width = max(2 * index.norm**0.5 * 1.0001, 1e-9) / STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(index.pivots), STEPS), np.int64)
        for b in pieces(batches, 2048):
            p, _, s = index.keyed(whole(b.column(1), dim))
            np.add.at(counts, (p, s), 1)
        p, s = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(s, pa.int32()), pa.array(counts[p, s])], names=["p", "s", "k"])

    counts = np.zeros((len(index.pivots), STEPS), np.int64)
    for r in vectors.mapInArrow(run, "p int, s int, k long").groupBy("p", "s").agg(F.sum("k").alias("k")).collect():  # at most pivots * STEPS rows
        counts[r["p"], r["s"]] = r["k"]
    index.cut(counts)
    return index


def packed_annuli(vectors: DataFrame, index: Index) -> DataFrame:
    """One row an annulus part: a, salt, ids, dist, vecs, sorted by distance."""
    dim = index.dim

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2048):
            v = whole(b.column(1), dim)
            p, d, s = index.keyed(v)
            a = index.first[p, s]
            ids = b.column(0).to_numpy().astype(np.uint64)
            salt = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % index.salts[a]
            raw = v.tobytes()
            k = 8 * dim
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(salt), b.column(0), pa.array(d), pa.array([raw[i * k : (i + 1) * k] for i in range(len(v))], pa.binary())], names=["a", "salt", "id", "d", "v"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.group_by(["id", "v"]).aggregate([("d", "min"), ("a", "min"), ("salt", "min")]).rename_columns(["id", "v", "d", "a", "salt"])  # repeated rows
        t = t.sort_by([("d", "ascending"), ("id", "ascending")])
        one = lambda x, kind: pa.array([x], kind)
        return pa.table({"a": t["a"].slice(0, 1), "salt": t["salt"].slice(0, 1), "ids": one(t["id"].to_numpy().tobytes(), pa.binary()), "dist": one(t["d"].to_numpy().tobytes(), pa.binary()), "vecs": one(b"".join(t["v"].to_pylist()), pa.binary())})

    keyed = vectors.mapInArrow(key, "a long, salt long, id long, d double, v binary")
    return keyed.groupBy("a", "salt").applyInArrow(pack, "a long, salt long, ids binary, dist binary, vecs binary")


def packed_queries(queries: DataFrame, index: Index, chunks: int) -> DataFrame:
    """One row a chunk: chunk, ids, vecs."""
    dim = index.dim

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        lists = t["v"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        return pa.table({"chunk": t["chunk"].slice(0, 1), "ids": pa.array([t["id"].to_numpy().tobytes()], pa.binary()), "vecs": pa.array([whole(lists, dim).tobytes()], pa.binary())})

    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), "id", "v")
    return q.groupBy("chunk").applyInArrow(pack, "chunk long, ids binary, vecs binary")


def search_one(index: Index, q: np.ndarray, qid: int, qq: float, dq: float, tau: float, k: int, ids: np.ndarray, dist: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one annulus part (at least those of score tau or more), expanding from dq outwards."""
    got_s, got_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
    right = int(np.searchsorted(dist, dq))
    left = right
    while left > 0 or right < len(dist):
        # gaps of what is next on either side; the nearer goes first
        gl = dq - dist[left - 1] if left > 0 else np.inf
        gr = dist[right] - dq if right < len(dist) else np.inf
        if index.best(qq, max(min(gl, gr), 0.0)) < tau:
            break
        a, b = (max(0, left - STRIDE), left) if gl <= gr else (right, min(len(dist), right + STRIDE))
        left, right = (a, right) if gl <= gr else (left, b)
        s, i = vecs[a:b] @ q, ids[a:b]
        keep = (s >= tau) & (i != qid)
        if keep.any():
            got_s, got_i = np.r_[got_s, s[keep].astype(np.int64)], np.r_[got_i, i[keep]]
            if len(got_s) > k:
                top = np.lexsort((got_i, -got_s))[:k]
                got_s, got_i = got_s[top], got_i[top]
        if len(got_s) >= k:
            tau = max(tau, float(got_s.min()))
    return got_s, got_i


def searched(pairs: DataFrame, annuli: DataFrame, chunks: DataFrame, index: Index, k: int, taus: DataFrame | None) -> DataFrame:
    """query_id, vec_id, score: at most k for each query and annulus part of pairs (chunk, a, salt)."""
    dim = index.dim
    x = pairs.join(annuli, ["a", "salt"]).join(chunks.select("chunk", F.col("ids").alias("qids"), F.col("vecs").alias("qvecs")), "chunk")
    x = x.join(taus, "chunk", "left") if taus is not None else x.withColumn("tq", F.lit(None).cast("binary")).withColumn("tt", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            r = {c: b.column(c)[0].as_py() for c in ("a", "salt", "own", "ids", "dist", "vecs", "qids", "qvecs", "tq", "tt")}
            ids, dist = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dist"])
            vecs = np.frombuffer(r["vecs"], np.int64).reshape(len(ids), dim)
            qids = np.frombuffer(r["qids"], np.int64)
            qv = np.frombuffer(r["qvecs"], np.int64).reshape(len(qids), dim)
            known = dict(zip(np.frombuffer(r["tq"] or b"", np.int64).tolist(), np.frombuffer(r["tt"] or b"").tolist(), strict=True))
            qq, d, home = index.asked(qv)
            p = index.pivot[r["a"]]
            mv, mq = exact(vecs, qv)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for j in range(len(qids)):
                at_home = home[j] == r["a"]
                if r["own"] and not at_home:
                    continue
                tau = known.get(int(qids[j]), -np.inf)
                dq = float(d[j, p])
                if not r["own"]:
                    gap = max(0.0, index.low[r["a"]] - dq, dq - index.high[r["a"]])
                    if at_home and not r["salt"]:
                        continue  # searched before
                    if index.best(qq[j], gap) < tau:
                        continue
                s, i = search_one(index, mq[j], int(qids[j]), float(qq[j]), dq, tau, k, ids, dist, mv)
                out.append((np.full(len(s), qids[j]), i, s))
            cat = lambda n: np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(n), pa.int64()) for n in range(3)], names=["query_id", "vec_id", "score"])

    return x.select("a", "salt", "own", "ids", "dist", "vecs", "qids", "qvecs", "tq", "tt").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(64 * x), ties to smaller ids.

    A row is no candidate of a query with its own id. Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; shorter vectors count as
    filled up with zeros; components are clipped where a product would not fit a long.
    Repeated candidate rows count once by id and score. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    v = valid(vectors, id_col, vec_col)
    q = valid(queries, id_col, vec_col).dropDuplicates(["id"])
    index = fit(v)
    schema = "query_id long, rank int, vec_id long, score long"
    n = q.count() if index is not None else 0
    if not n:
        return spark.createDataFrame([], schema)
    annuli = stored(packed_annuli(v, index), "annuli")
    chunks = stored(packed_queries(q, index, -(-n // CHUNK)), "queries")

    def pairs(own: bool, taus: DataFrame | None) -> DataFrame:
        """Which chunks go to which annuli: own, the annuli that hold their queries; else all that no bound excludes."""
        src = chunks if taus is None else chunks.join(taus, "chunk", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1):
                qids = np.frombuffer(b.column("ids")[0].as_py(), np.int64)
                qv = np.frombuffer(b.column("vecs")[0].as_py(), np.int64).reshape(len(qids), index.dim)
                if own:
                    a = np.unique(index.asked(qv)[2])
                    salt = np.zeros(len(a), np.int64)
                else:
                    tau = np.full(len(qids), -np.inf)
                    if b.column("tq")[0].as_py() is not None:
                        known = dict(zip(np.frombuffer(b.column("tq")[0].as_py(), np.int64).tolist(), np.frombuffer(b.column("tt")[0].as_py()).tolist(), strict=True))
                        tau = np.array([known.get(i, -np.inf) for i in qids.tolist()])
                    qq, d, _ = index.asked(qv)
                    need = [bool((index.best(qq, np.maximum(0, np.maximum(index.low[i] - d[:, p], d[:, p] - index.high[i]))) >= tau).any()) for i, p in enumerate(index.pivot)]
                    a = np.repeat(np.flatnonzero(need), index.salts[need])
                    salt = np.concatenate([np.arange(s) for s in index.salts[need]]) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("chunk")[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(salt, pa.int64()), pa.array([own] * len(a), pa.bool_())], names=["chunk", "a", "salt", "own"])

        return src.mapInArrow(run, "chunk long, a long, salt long, own boolean")

    first = stored(searched(pairs(True, None), annuli, chunks, index, k, None), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.dropDuplicates().withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k)
    chunk = F.pmod(F.xxhash64(F.col("query_id")), F.lit(-(-n // CHUNK)))

    def bind(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": t["chunk"].slice(0, 1), "tq": pa.array([t["query_id"].to_numpy().tobytes()], pa.binary()), "tt": pa.array([t["score"].to_numpy().astype(np.float64).tobytes()], pa.binary())})

    taus = stored(kth.select(chunk.alias("chunk"), "query_id", "score").groupBy("chunk").applyInArrow(bind, "chunk long, tq binary, tt binary"), "bounds")
    rest = searched(pairs(False, taus), annuli, chunks, index, k, taus)
    both = first.unionByName(rest).dropDuplicates()
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: queries are the vectors whose id is divisible by 20."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
