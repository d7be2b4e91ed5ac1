"""Embedding whitening by a randomised range finder.

A random orthonormal basis of a few more columns than components are wanted is multiplied with the
covariance again and again; each pass goes over all centred rows, whose partial products are
summed in Spark, and Rayleigh-Ritz turns the basis into eigenpairs. If their residuals don't fall to
rounding within the passes, as with a flat spectrum, the basis becomes the full space, for which one
more pass gives the whole covariance. The driver holds sums of a dimension's square at most.

Defined results: vectors that are null, empty, hold null or non-finite entries, or are not of the most frequent
length (of equally frequent ones the longest) take no part; entries beyond 2^52 after scaling are cut there; ids are carried, so null and repeated ids and
repeated rows count and stay; directions without variance are no components, so equal vectors, one vector and an empty
table have none; a deviation that is no long is null; of equal eigenvalues any eigenvectors are right; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Columns of the random basis beyond the components, passes before it becomes the full space, its seed.
OVERSAMPLE, PASSES, SEED = 8, 4, 13
#: Residuals and variances at most this share of the first eigenvalue are rounding.
SETTLED, FLAT = 1e-14, 1e-11


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit, their sums, eigenvalues and components (a column each), trace of the covariance, how it was found."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    full: bool

    @property
    def scale(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        # the whole part of the mean is taken off as an integer, so nothing is rounded before
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([(s % self.n) / self.n for s in self.sums])


def usable(vec: str) -> Column:
    """Whether a vector takes part, but for its length."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def entries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v"))


def integers(lists: pa.Array, dim: int) -> np.ndarray:
    c = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -(2.0**52), 2.0**52).astype(np.int64) + SHIFT


def summed(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a matrix that part makes of a batch of them; each task sends its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                made = part(integers(b.column(0), dim))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[1]]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["width", "x"])

    made = rows.select("v").mapInArrow(run, "width long, x array<double>").select("width", F.posexplode("x").alias("at", "x"))
    got = made.groupBy("at").agg(F.sum("x").alias("x"), F.max("width").alias("width")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r["x"]
    return out.reshape(-1, got[0]["width"])


def sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """How many rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                # of high and low halves, so that no sum leaves a long
                x = integers(b.column(0), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([b.num_rows] * dim), pa.array((x >> 20).sum(0)), pa.array((x & 0xFFFFF).sum(0))], names=["at", "n", "high", "low"])

    made = rows.select("v").mapInArrow(run, "at long, n long, high long, low long").groupBy("at")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    got = sorted(made.agg(*exact).collect(), key=lambda r: r["at"])
    return int(got[0]["n"]), tuple((int(r["high"]) << 20) + int(r["low"]) for r in got)


def dimension(rows: DataFrame) -> int:
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def fit(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Whitening | None:
    """The largest components of all usable rows; None if there are no rows."""
    rows = entries(df, id_col, vec_col)
    dim = dimension(rows)
    if not dim:
        return None
    rows = rows.where(F.size("v") == dim)
    n, total = sums(rows, dim)
    mean = Whitening(n, total, np.ones(1), np.ones((1, 1)), 0.0, False).centred

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times q, and its trace, by one pass over all rows."""

        def part(x: np.ndarray) -> np.ndarray:
            c = mean(x)
            product = c.T @ (c @ q)
            return np.vstack([product, np.full((1, q.shape[1]), np.square(c).sum())])

        made = summed(rows, dim, part) / n
        return made[:-1], float(made[-1, 0])

    k, width, full = min(components, dim), min(dim, components + oversample), False
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    for step in range(passes + 1):
        if step == passes or width >= dim:
            q, full = np.eye(dim), True
        z, trace = times(q)
        b = q.T @ z
        values, u = np.linalg.eigh((b + b.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        if full:
            break
        residual = np.linalg.norm(z @ u - (q @ u) * values, axis=0)[:k]
        if residual.max() <= SETTLED * max(values[0], 0.0):
            break
        q = np.linalg.qr(z)[0]
    vectors = (q @ u)[:, :k]
    kept = values[:k] > FLAT * max(values[0], 0.0)
    values, vectors = values[:k][kept], vectors[:, kept]
    if len(values):
        # one sign for all: the largest entry is positive
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return Whitening(n, total, values, vectors, trace, full)


def identity_error(df: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance minus the identity, by a pass over all of them."""
    dim, k, scale = len(model.sums), len(model.values), model.scale

    def part(x: np.ndarray) -> np.ndarray:
        w = model.centred(x) @ scale
        return np.vstack([w.T @ w, w.sum(0)[None]])

    made = summed(entries(df, id_col, vec_col).where(F.size("v") == dim), dim, part) / model.n
    return float(np.abs(made[:-1] - np.outer(made[-1], made[-1]) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Of each row the exact sum of (n * x - S)^2; None where it is no long."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums))
    if most * most * x.shape[1] < 1 << 62:
        return np.square(x * model.n - np.array(model.sums, np.int64)).sum(1).tolist()
    if most < 1 << 62:
        t = x * model.n - np.array(model.sums, np.int64)
        if int(np.abs(t).max()) ** 2 * x.shape[1] < 1 << 62:
            return np.square(t).sum(1).tolist()
    out = [sum((model.n * a - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whitened(df: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, whitened (an array, the largest component first) and deviation of each usable row."""
    dim, scale = len(model.sums), model.scale
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column(1), dim)
                w = model.centred(x) @ scale
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(deviations(x, model), pa.int64())], names=["id", "whitened", "deviation"])

    rows = entries(df, id_col, vec_col).where(F.size("v") == dim)
    return rows.mapInArrow(run, f"id {id_type}, whitened array<double>, deviation long").withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The contract's rows: one for each usable vector and component."""
    model = fit(df)
    if model is None or not len(model.values):
        id_type = df.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(df, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = whitened(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
