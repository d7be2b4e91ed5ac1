"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has COORDS coordinates. In round i every shingle is hashed to one coordinate with a
value i + fraction, and each coordinate keeps its smallest value; rounds COORDS and later send
every shingle to coordinate i - COORDS, so every coordinate is filled after 2 COORDS rounds at most,
and after one or two for all but short texts. Two sketches agree on a coordinate with a
probability of the sets' Jaccard similarity, concentrated as for independent hashing.

Texts with equal shingle sets are one class from the start. Sketches are cut into bands;
classes that share a band are candidates, and only those. Joined through the heads of their
bands, candidates form clusters, outside of which no link can be. The full shingle sets
of candidates are compared by counting common shingles as a matrix product: a cluster
that fits a block as a whole; larger ones first with the most central member of each bucket, and
then, in blocks, where different parts of a bucket remain. What is compared gives back only links
that join something, so their number grows with that of the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, OWN, annotate, checkpointed, pieces, stored, utf8
from .graph import components

#: Coordinates, and bands of ROWS coordinates: at similarity 0.85 a pair is missed with probability (1 - 0.85^5)^24 < 1e-6.
COORDS, BANDS, ROWS = 120, 24, 5
#: Classes of a block; two blocks meet in a task.
BLOCK = 256
#: Classes of small clusters that one group has, about; shingles counted at a time.
TOGETHER, WIDE = 2_000, 8_192

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def shingles(text: bytes | None, get, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; a text of fewer words is one shingle."""
    words = text.translate(LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(get, words), np.uint64, n)
    k = min(n, size)
    s = np.full(n - k + 1, seed(k), np.uint64)
    for j in range(k):
        s = mix(s ^ h[j : n - k + 1 + j])
    return np.unique(s)


def sketches(sets: list[np.ndarray], t: int = COORDS) -> np.ndarray:
    """Sketches of many sets at once: a row of t 64-bit values for each set, zeros for empty ones."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), full, np.uint64)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for i in range(2 * t):
        if not len(todo):
            break
        x = np.concatenate([sets[k] for k in todo])
        row = np.repeat(np.arange(len(todo)), [len(sets[k]) for k in todo])
        h = mix(x ^ seed(i))
        at = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.full(len(x), i - t, np.uint64)
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        part = out[todo].ravel()
        np.minimum.at(part, row * t + at.astype(np.int64), value)
        part = part.reshape(len(todo), t)
        out[todo] = part
        todo = todo[(part == full).any(1)]
    out[[len(s) == 0 for s in sets]] = 0
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.tile(np.array([seed(1000 + b) for b in range(bands)], np.uint64), (len(sketch), 1))
    for r in range(rows):
        keys = mix(keys ^ sketch[:, r : bands * rows : rows])
    return keys


def halves(raw: bytes) -> tuple[int | None, int | None]:
    """A set's 128-bit digest as two signed longs; none for an empty set."""
    if not raw:
        return None, None
    d = xxhash.xxh3_128_intdigest(raw)
    return tuple(((d >> k & (2**64 - 1)) ^ (1 << 63)) - (1 << 63) for k in (64, 0))


def signed(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n, d0 and d1 (a 128-bit digest of the set), bands."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = WordHash().__getitem__
        for b in pieces(batches, 512):
            sets = [shingles(x, get, size) for x in utf8(b.column(1))]
            sk = sketches(sets)
            d = [halves(x.tobytes()) for x in sets]
            flat = pa.array(band_keys(sk).astype(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), bands], names=[id_col, "n", "d0", "d1", "bands"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, n long, d0 long, d1 long, bands array<long>")


def with_sets(df: DataFrame, size: int) -> DataFrame:
    """df (text, d0, d1 and more) with s, the sorted shingle hashes as bytes, for text; rows whose text isn't the class's go.

    The latter happens where rows of different texts have one id.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != "text"] + [T.StructField("s", T.BinaryType())])
    at, rest = df.columns.index("text"), [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = WordHash().__getitem__
        for b in pieces(batches):
            sets = [shingles(x, get, size).tobytes() for x in utf8(b.column(at))]
            own = [halves(s) == d for s, d in zip(sets, zip(b.column("d0").to_pylist(), b.column("d1").to_pylist(), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(sets, pa.binary())], names=[*rest, "s"]).filter(pa.array(own, pa.bool_()))

    return df.mapInArrow(run, schema)


def common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of a left and a right set; without right, of any two different left ones."""
    every = [*left, *(right or [])]
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[col] > 1  # others are in no intersection
    row, col = row[keep], np.unique(col[keep], return_inverse=True)[1]
    second = slice(len(left) if right is not None else 0, None)
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, WIDE):
        i, j = np.searchsorted(col, [a, a + WIDE])
        m = np.zeros((len(every), min(WIDE, int(col[j - 1]) - a + 1)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m[: len(left)] @ m[second].T
    return out


def joining(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of links between parts, those that join parts not joined by the ones before."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def linked(n: np.ndarray, c: np.ndarray, sets: list[np.ndarray], bands: np.ndarray | None, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between parts c of left and right rows (that share a band, if bands are given), enough to join all that are linked."""
    if not len(left) or not len(right) or (c[left] == c[right][0]).all() and (c[right] == c[left][0]).all():
        return []
    both = common([sets[i] for i in left], None if np.array_equal(left, right) else [sets[i] for i in right])
    ok = (den * both >= num * (n[left][:, None] + n[right][None, :] - both)) & (c[left][:, None] != c[right][None, :])
    if bands is not None and ok.any():
        ok &= np.logical_or.reduce([x[left][:, None] == x[right][None, :] for x in bands.T])
    i, j = np.nonzero(ok)
    return joining(c[left][i], c[right][j])


def compared(rows: DataFrame, few: int, num: int, den: int) -> DataFrame:
    """Links a, b between parts: of each g, rows of the left with rows of the right.

    rows have g, lo, hi (which with g say what meets; null: all rows of g), left, right, k, c (the
    part k is in), n, s, bands (null where any pair may link). The few rows with a null lo go many g to a task.
    """
    groups = max(1, -(-few // TOGETHER))
    key = F.when(F.col("lo").isNull(), F.pmod(F.xxhash64("g"), F.lit(groups))).otherwise(F.col("g"))
    x = rows.select(key.alias("key"), F.coalesce("lo", F.lit(-1)).cast("long").alias("lo"), F.coalesce("hi", F.lit(-1)).cast("long").alias("hi"), "g", "left", "right", "k", "c", "n", "s", "bands")

    def compare(t: pa.Table) -> pa.Table:
        g, c, n = (t[x].to_numpy() for x in ("g", "c", "n"))
        left, right = (t[x].to_numpy(zero_copy_only=False).astype(bool) for x in ("left", "right"))
        sets = [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]
        bands = None if t["bands"].null_count else np.array(t["bands"].to_pylist(), np.int64)
        out: list[tuple[int, int]] = []
        order = np.argsort(g, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            out += linked(n, c, sets, bands, at[left[at]], at[right[at]], num, den)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return x.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept of every row of docs.

    component_id is the smallest id reachable over links (den * intersection >= num *
    union of the full sets of size-word shingles); kept marks the row that has it. Null and
    empty texts have no shingles and stand alone. Rows with a null id link like others; if
    all of a component are null, component_id is null and they are kept. Repeated ids share
    their fate if their texts are alike, else each text has its own. Very long texts are
    shingled whole. Extra columns are ignored; an empty table gives no rows. Ids are integers.
    """
    out = marked(docs, id_col, text_col, size, num, den)
    return out.select(id_col, F.col("n").alias("n_shingles"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def marked(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """id, n, d0, d1, c (the component's key, null without shingles), component_id of every row of docs."""
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    sig = stored(signed(src, id_col, "text", size), "signatures")
    # equal sets are one class, summed up before the shuffle and numbered by the table it is written to
    alike = sig.where("n > 0").groupBy("d0", "d1").agg(F.min(id_col).alias("least"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    classes = stored(alike.withColumn("k", F.monotonically_increasing_id()), "classes")
    spread = classes.select("k", F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.min("k").alias("a"), F.count("*").alias("m")).where("m > 1")
    shared = stored(spread.join(heads, "band"), "buckets")  # members of buckets with two classes or more
    cluster = components(shared.select("a", F.col("k").alias("b"))).select(F.col("node").alias("k"), F.col("component").alias("g"))
    cluster = checkpointed(cluster.join(cluster.groupBy("g").agg(F.count("*").alias("m")), "g"))
    members = with_sets(class_texts(src, id_col, sig, classes.join(cluster, "k"), size), size)
    small = cluster.where(F.col("m") <= BLOCK).count()
    large = cluster.where(F.col("m") > BLOCK).limit(1).count() > 0
    if large:
        members = stored(members, "sets")
    null, yes = F.lit(None).cast("long"), F.lit(True)
    links = stored(compared(members.where(F.col("m") <= BLOCK).select("g", null.alias("lo"), null.alias("hi"), yes.alias("left"), yes.alias("right"), "k", F.col("k").alias("c"), "n", "s", "bands"), small, num, den), "links")
    if large:
        links = links.unionByName(large_links(members.where(F.col("m") > BLOCK), shared, num, den))
    found = components(links)
    ids = classes.select("d0", "d1", "k", "least").join(found.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("c", F.coalesce("component", "k"))
    ids = checkpointed(ids.select("d0", "d1", "least", "c"))
    least = ids.groupBy("c").agg(F.min("least").alias("component_id"))
    at = ids.join(least, "c").select("d0", "d1", "c", "component_id")
    out = sig.select(id_col, "n", "d0", "d1").join(at, ["d0", "d1"], "left")
    return out.select(id_col, "n", "d0", "d1", "c", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


def class_texts(src: DataFrame, id_col: str, sig: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (a row a class) with a text of it: the one of its least id, or, where that is null or repeats, one with its digest."""
    out = ["text", "k", "g", "m", "n", "d0", "d1", "bands"]
    repeated = sig.groupBy(id_col).agg(F.count("*").alias("times")).where(f"times > 1 or `{id_col}` is null")
    if not repeated.limit(1).count():
        return src.join(wanted, F.col(id_col) == F.col("least")).select(out)
    odd = stored(repeated.select(F.col(id_col).alias("odd")), "odd")
    same = lambda c: F.col(c).eqNullSafe(F.col("odd"))
    one = src.join(wanted.join(odd, same("least"), "left_anti"), F.col(id_col) == F.col("least")).select(out)
    rows = with_digests(src.join(odd, same(id_col), "left_semi").select("text"), size)
    rows = rows.groupBy(F.col(OWN + "d0").alias("d0"), F.col(OWN + "d1").alias("d1")).agg(F.first("text").alias("text"))
    return one.unionByName(wanted.join(odd, same("least"), "left_semi").join(rows, ["d0", "d1"]).select(out))


def large_links(members: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """Links within clusters of more than a block, of pairs that share a band, in two steps of which neither gathers a cluster.

    First every member is compared with the most central member of each of its buckets,
    the one whose own buckets are largest; that joins most of a group of copies with as many links as
    members. Then, in buckets where several parts remain, members are compared that are in different parts.
    """
    sets = members.select("k", "n", "s")
    mine = checkpointed(shared.select("band", "k", "m").join(members.select("k"), "k", "left_semi"))
    central = mine.groupBy("k").agg(F.sum("m").alias("score"))
    hubs = mine.join(central, "k").groupBy("band").agg(F.max(F.struct("score", "k")).alias("x")).select("band", F.col("x.k").alias("a"))
    stars = checkpointed(with_hubs(mine.join(hubs, "band").where("k <> a").select("a", "k").distinct()))
    first = stored(compared(stars.join(sets, "k"), stars.where("lo is null").count(), num, den), "links")
    part = components(first).select(F.col("node").alias("k"), F.col("component").alias("c"))
    rows = checkpointed(mine.select("band", "k").join(part, "k", "left").withColumn("c", F.coalesce("c", "k")))
    apart = rows.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("band", "m")
    rows = checkpointed(in_blocks(rows.join(apart, "band")))
    return first.unionByName(compared(rows.join(sets, "k"), rows.where("lo is null").count(), num, den))


def no_bands():
    return F.lit(None).cast("array<bigint>").alias("bands")


def with_hubs(stars: DataFrame) -> DataFrame:
    """Stars (a, k) as compared() takes them, without sets: a on the left with up to BLOCK of its k at a time."""
    parts = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    lo = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k"), F.col("parts")))
    ends = stars.join(parts, "a").select(F.col("a").alias("g"), lo.alias("lo"), F.lit(False).alias("left"), "k")
    hubs = parts.select("a", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("lo"))
    hubs = hubs.select(F.col("a").alias("g"), F.when(F.col("parts") > 1, F.col("lo")).alias("lo"), F.lit(True).alias("left"), F.col("a").alias("k"))
    return ends.unionByName(hubs).select("g", "lo", F.col("lo").alias("hi"), "left", (~F.col("left")).alias("right"), "k", F.col("k").alias("c"), no_bands())


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, k, c, m, the bucket's size) as compared() takes them, without sets: blocks of about BLOCK members of which each two meet.

    A part of more than BLOCK members has blocks of its own, which do not meet each other;
    members of smaller parts share blocks.
    """
    big = rows.groupBy("band", "c").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("own", F.ceil(F.col("size") / BLOCK).cast("long"))
    per = big.groupBy("band").agg(F.sum("size").alias("sizes"), F.sum("own").alias("owns"))
    w = Window.partitionBy("band").orderBy("c")
    big = big.select("band", "c", "own", (F.sum("own").over(w) - F.col("own")).alias("at"))
    x = rows.join(per, "band", "left").join(big, ["band", "c"], "left")
    mixed = F.ceil((F.col("m") - F.coalesce("sizes", F.lit(0))) / BLOCK).cast("long")
    x = x.withColumn("mixed", mixed).withColumn("at", F.col("at") + F.col("mixed"))
    deal = F.xxhash64("k", F.lit(7))
    x = x.withColumn("i", F.when(F.col("own").isNull(), F.pmod(deal, F.col("mixed"))).otherwise(F.col("at") + F.pmod(deal, F.col("own"))))
    all_ = F.col("mixed") + F.coalesce("owns", F.lit(0))
    others = F.filter(F.sequence(F.lit(0).cast("long"), all_ - 1), lambda j: F.col("own").isNull() | (j < F.col("at")) | (j >= F.col("at") + F.col("own")))
    one = all_ == 1
    x = x.select(F.col("band").alias("g"), "k", "c", "i", one.alias("one"), F.explode(others).alias("j"))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    return x.select("g", F.when(~F.col("one"), lo).alias("lo"), F.when(~F.col("one"), hi).alias("hi"), (F.col("i") == lo).alias("left"), (F.col("i") == hi).alias("right"), "k", "c", no_bands())


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: three-word shingles, similarity 0.85."""
    return near_duplicates(docs, size=3, num=85)


def with_digests(docs: DataFrame, size: int) -> DataFrame:
    """docs with OWN-prefixed d0 and d1 of each text's shingles."""

    def make():
        get = WordHash().__getitem__

        def f(texts):
            d = [halves(shingles(x, get, size).tobytes()) for x in texts]
            return [[x for x, _ in d], [x for _, x in d]]

        return f

    return annotate(docs, "text", [("d0", "long"), ("d1", "long")], make)


def distinct_documents(docs: DataFrame, size: int = 5, num: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with its own columns, also where ids repeat or are null.

    Texts without shingles are no group: they stay, of repeated rows of one id and text one.
    """
    marks = marked(docs, "doc_id", "text", size, num, 100)
    whole = F.struct("doc_id", "d0", "d1")
    kept = marks.where(F.col("c").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("c").agg(F.min(whole).alias("x")).select("x.*")
    kept = kept.unionByName(marks.where("c is null").select("doc_id", "d0", "d1").distinct())
    kept = stored(kept.toDF(*(OWN + x for x in ("id", "e0", "e1"))), "kept")
    repeated = stored(marks.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias(OWN + "id")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col(OWN + "id"))
    if not repeated.limit(1).count():
        return docs.join(kept, same, "left_semi")
    once = docs.join(repeated, same, "left_anti").join(kept, same, "left_semi")
    again = with_digests(docs.join(repeated, same, "left_semi"), size)
    again = again.join(kept, same & F.col(OWN + "d0").eqNullSafe(F.col(OWN + "e0")) & F.col(OWN + "d1").eqNullSafe(F.col(OWN + "e1")), "left_semi")
    again = again.withColumn(OWN + "empty", F.when(F.col(OWN + "d0").isNull(), F.col("text"))).dropDuplicates(["doc_id", OWN + "d0", OWN + "d1", OWN + "empty"])
    return once.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
