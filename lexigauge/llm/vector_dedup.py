"""Embedding near-duplicates of one label: dual traversal of cover trees, exact at a cosine threshold.

Equal vectors of a label are one class from the start. Classes go to the nearest of a few centres (farthest-first over a bounded
sample, so that a prefix of them serves a small label), cells of more than BLOCK classes are dealt over several blocks, and each
block becomes a row with its matrix and a cover tree: nested levels, each with half the radius of the one above, whose nodes know the largest distance to
what they cover. Blocks of neighbouring cells are bundled, and pairs of bundles of one label meet as one row if the covering radii let any
of their blocks be near, so that a vector is sent once for each bundle it meets, not for each block. There both trees of near blocks are
descended together. Of two nodes whose balls are too far apart nothing is looked at, of two
whose balls are near enough all points are linked at once, and others go on to their children, down to few points. Points
are compared in tiles of single precision, which leave out what is further below the threshold than rounding can reach; the others are told
apart in double precision. A pair of bundles returns a row a class at most: its links, weighted by copies, and the class that stands for what it is connected to there.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries, and those without a label,
link with nothing and keep their id as component; vectors of different lengths don't link; of repeated rows each counts; ties need no rule,
since every link counts; null ids count as the largest, and are never kept; an empty table gives an empty one; other columns are left
out, whatever their names. Trees only leave out what cannot change a result: on vectors without near groups every two of a label are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .graph import components
from .whitening import usable

#: Classes in a block, about; vectors of the sample that centres are chosen from, and centres at most.
BLOCK, SAMPLE, CENTRES, SEED = 2048, 4096, 256, 12
#: Classes in a bundle of blocks, about, and bundles in all that smaller tables are dealt over for more tasks.
BUNDLE, BUNDLES = 16384, 32
#: Rows of a tile that is compared at once, and pairs that are looked at again at once.
TILE, AGAIN = 512, 1 << 16
#: Nodes of at most so many points are not descended if most of their children are points: their points are compared.
SMALL = 256
#: Room for rounding in bounds on distances; nodes of at most this radius, or below the finest level, hold points.
ROOM, FINEST = 1e-6, 1 / 64


@dataclass
class Tree:
    """Nodes in order of levels, children of a node side by side; node k covers points lo[k] to hi[k]."""

    points: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @cached_property
    def single(self) -> np.ndarray:
        return self.points.astype(np.float32)

    def under(self, ks: np.ndarray) -> np.ndarray:
        """The points that some nodes cover."""
        n = self.hi[ks] - self.lo[ks]
        return np.repeat(self.lo[ks] - np.cumsum(n) + n, n) + np.arange(n.sum())

    @cached_property
    def flat(self) -> np.ndarray:
        n, kids = self.hi - self.lo, self.last - self.first
        return (kids == 0) | (2 * kids >= n) & (n <= SMALL)

    def below(self, k: int) -> np.ndarray:
        return np.arange(self.first[k], self.last[k])


FIELDS = ("centre", "lo", "hi", "first", "last")


def grown(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A cover tree over unit vectors: their order, and the tree's arrays."""
    gram = np.clip(points @ points.T, -1.0, 1.0)
    order = np.arange(len(points))
    top = int((points @ points.mean(0)).argmax())
    far = lambda c, members: math.sqrt(max(0.0, 2 - 2 * float(gram[c, members].min())))
    centre, radius, lo, hi, first, last = [top], [far(top, order)], [0], [len(order)], [], []
    k = 0
    while k < len(centre):
        first.append(len(centre))
        members = order[lo[k] : hi[k]].copy()
        reach = 2.0 ** math.ceil(math.log2(max(radius[k], FINEST / 2))) / 2
        if len(members) > 1 and radius[k] > ROOM and reach >= FINEST:
            left, at, c = members, lo[k], centre[k]
            while len(left):
                near = gram[c, left] >= 1 - reach * reach / 2
                near |= left == c
                own, left = left[near], left[~near]
                order[at : at + len(own)] = own
                centre.append(c)
                radius.append(far(c, own))
                lo.append(at)
                hi.append(at := at + len(own))
                c = left[0] if len(left) else -1
        last.append(len(centre))
        k += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ints = {n: np.array(x, np.int64) for n, x in zip(FIELDS, (place[centre], lo, hi, first, last), strict=True)}
    return order, ints | {"radius": np.array(radius) + ROOM}


def compared(a: Tree, la: np.ndarray, b: Tree, lb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices into la and lb of the pairs of points that link."""
    room = (a.points.shape[1] + 8) * 2.0**-23  # more than single precision is off by
    x, y = a.single[la], b.single[lb].T
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(la), TILE):
        c = x[at : at + TILE] @ y
        rows = np.flatnonzero(c.max(1) >= cosine - room)
        if not len(rows):
            continue
        c = c[rows]
        i, j = np.nonzero(c >= cosine - room)
        close = np.flatnonzero(c[i, j] <= cosine + room)
        i, link = rows[i] + at, np.ones(len(i), bool)
        for k in range(0, len(close), AGAIN):
            few = close[k : k + AGAIN]
            link[few] = np.einsum("ij,ij->i", a.points[la[i[few]]], b.points[lb[j[few]]]) >= cosine
        found.append((i[link], j[link]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def near_pairs(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight linked to each point of a and of b, and edges (place in a, place in b) and spans that connect what is linked.

    Spans are rows (side, lo, hi): points that are connected with each other through the other side.
    """
    t = math.sqrt(2 - 2 * cosine)
    sums = [np.concatenate([[0], np.cumsum(x.weight)]) for x in (a, b)]
    heavy = [s[x.hi] - s[x.lo] for s, x in zip(sums, (a, b), strict=True)]
    steps = [np.zeros(len(x.points) + 1, np.int64) for x in (a, b)]
    edges, spans, todo = [], [], [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def linked(i: np.ndarray, j: np.ndarray, lows: tuple, highs: tuple, weights: tuple) -> None:
        if not len(i):
            return
        for side, own, other in ((0, i, j), (1, j, i)):
            gain = np.bincount(own, weights=weights[1 - side][other], minlength=len(lows[side])).astype(np.int64)
            np.add.at(steps[side], lows[side], gain)
            np.subtract.at(steps[side], highs[side], gain)
            wide = np.unique(own)
            wide = wide[highs[side][wide] - lows[side][wide] > 1]
            spans.extend((side, x, y) for x, y in zip(lows[side][wide].tolist(), highs[side][wide].tolist(), strict=True))
        edges.append(np.stack([lows[0][i], lows[1][j]], 1))

    def points(la: np.ndarray, lb: np.ndarray) -> None:
        if len(la) and len(lb):
            linked(*compared(a, la, b, lb, cosine), (la, lb), (la + 1, lb + 1), (a.weight[la], b.weight[lb]))

    def balls(ka: np.ndarray, kb: np.ndarray) -> None:
        if len(ka) and len(kb):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.points[a.centre[ka]] @ b.points[b.centre[kb]].T)))
            reach = a.radius[ka][:, None] + b.radius[kb][None]
            link = d + reach <= t - ROOM
            linked(*np.nonzero(link), (a.lo[ka], b.lo[kb]), (a.hi[ka], b.hi[kb]), (heavy[0][ka], heavy[1][kb]))
            i, j = np.nonzero(~link & (d - reach <= t + ROOM))
            small = a.flat[ka[i]] & b.flat[kb[j]]
            wide = ~small & ~a.flat[ka[i]]
            todo.extend((a.below(k), kb[j[wide & (ka[i] == k)]]) for k in np.unique(ka[i[wide]]).tolist())
            wide = ~small & a.flat[ka[i]]
            todo.extend((ka[i[wide & (kb[j] == k)]], b.below(k)) for k in np.unique(kb[j[wide]]).tolist())
            i, j = i[small], j[small]
            flat_a, flat_b = a.flat[ka], b.flat[kb]
            if 2 * len(i) > flat_a.sum() * flat_b.sum() and not link[np.ix_(flat_a, flat_b)].any():  # too little is left out to go by parts
                points(a.under(ka[flat_a]), b.under(kb[flat_b]))
            elif len(each := np.unique(i)) <= len(np.unique(j)):
                for k in each.tolist():
                    points(a.under(ka[[k]]), b.under(kb[j[i == k]]))
            else:
                for k in np.unique(j).tolist():
                    points(a.under(ka[i[j == k]]), b.under(kb[[k]]))

    while todo:
        ka, kb = todo.pop()
        one_a, one_b = a.hi[ka] - a.lo[ka] == 1, b.hi[kb] - b.lo[kb] == 1
        points(a.lo[ka[one_a]], b.lo[kb[one_b]])
        balls(ka[~one_a], kb)
        balls(ka[one_a], kb[~one_b])
    joined = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return np.cumsum(steps[0])[:-1], np.cumsum(steps[1])[:-1], joined, np.array(spans, np.int64).reshape(-1, 3)


def forest(n: int, edges: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node that each of n nodes is connected to, beyond what root connects already."""
    root = np.arange(n) if root is None else root
    while len(edges):
        x, y = root[edges[:, 0]], root[edges[:, 1]]
        edges = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y]
        np.minimum.at(root, edges[:, 1], edges[:, 0])
        while (root[root] != root).any():
            root = root[root]
    return root


def centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors chosen farthest first, so that any prefix spreads over the sample."""
    if not len(sample) or most < 1:
        return sample[:0]
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(most, len(sample)) and best.min() < 1 - ROOM:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows: id, and d0, d1 of their class (null if they link with nothing). Classes: d0, d1, label, v, n."""
    kind = df.schema[vec_col].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    x = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(kind).alias("v"))
    live = F.col("label").isNotNull() & F.coalesce(usable("v") & F.exists("v", lambda y: y != 0), F.lit(False))
    # label and length, so that only vectors that can be compared meet
    group = F.xxhash64(F.lit(0), "label", F.size("v"))
    rows = x.select("id", *(F.when(live, F.xxhash64(F.lit(k), "label", "v")).alias(f"d{k}") for k in (0, 1)), F.when(live, group).alias("grp"), F.when(live, F.col("v")).alias("v"))
    made = rows.where("d0 is not null").groupBy("d0", "d1").agg(F.first("grp").alias("grp"), F.first("v").alias("v"), F.count("*").alias("n"))
    return rows.select("id", "d0", "d1"), made


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as unit rows."""
    return unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def blocks(made: DataFrame, block: int, sample: int) -> DataFrame:
    """A row a block: its group, centre and radius, and what dual traversal needs."""
    sizes = made.groupBy("grp").agg(F.count("*").alias("size"), F.first(F.size("v")).alias("dim"))
    top = sizes.agg(F.max("size").alias("m"), F.sum("size").alias("n"), F.max("dim").alias("dim"), F.min("dim").alias("least")).first()
    n, dim = top["n"] or 0, top["dim"] or 1
    most = min(CENTRES, -(-2 * (top["m"] or 0) // block)) if top["dim"] == top["least"] and (top["m"] or 0) > block else 1
    placed = made.join(sizes.select("grp", "size"), "grp").withColumn("use", F.when(F.col("size") > block, F.least(F.lit(most), F.ceil(2 * F.col("size") / block))).otherwise(1).cast("int"))
    if most > 1:
        got = made.select("v").where(F.rand(SEED) < sample / n).limit(2 * sample).toArrow() if n > sample else made.select("v").toArrow()
        found = centres(matrix(got["v"].combine_chunks()), most)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cos = matrix(b.column("v")) @ found.T
                    # a small label uses the first centres only
                    cos[np.arange(cos.shape[1])[None] >= b.column("use").to_numpy()[:, None]] = -9
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cos.argmax(1).astype(np.int32))], names=[*b.schema.names, "cell"])

        placed = placed.mapInArrow(nearest, placed.schema.simpleString()[7:-1] + ",cell:int")
    else:
        placed = placed.withColumn("cell", F.lit(0))
    placed = stored(placed, "vectors")
    dealt = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = placed.join(dealt, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "d0", "d1"), F.col("parts")).cast("int"))

    def build(x: pa.Table) -> pa.Table:
        x = x.combine_chunks()
        raw = x["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)
        points = unit(raw)
        order, tree = grown(points)
        points, raw = points[order], raw[order]
        longs = np.stack([x[c].to_numpy()[order] for c in ("n", "d0", "d1")])
        nodes = np.stack([tree[f] for f in FIELDS]).astype(np.int32)
        key = {c: x[c].slice(0, 1) for c in ("grp", "cell", "part")}
        return pa.table(key | {"size": [len(points)], "dim": [points.shape[1]], "centre": pa.array([points[tree["centre"][0]]], pa.list_(pa.float64())), "radius": [float(tree["radius"][0])], "points": [raw.tobytes()], "longs": [longs.tobytes()], "nodes": [nodes.tobytes()], "radii": [tree["radius"].tobytes()]})

    return placed.groupBy("grp", "cell", "part").applyInArrow(build, "grp long, cell int, part int, size long, dim long, centre array<double>, radius double, points binary, longs binary, nodes binary, radii binary")


def opened(size: int, dim: int, points: bytes, longs: bytes, nodes: bytes, radii: bytes) -> tuple[Tree, np.ndarray]:
    own = np.frombuffer(longs, np.int64).reshape(3, size)
    parts = dict(zip(FIELDS, np.frombuffer(nodes, np.int32).astype(np.int64).reshape(len(FIELDS), -1), strict=True))
    raw = np.frombuffer(points, np.float32 if len(points) == 4 * size * dim else np.float64).reshape(size, dim)
    return Tree(unit(raw), own[0], radius=np.frombuffer(radii), **parts), own[1:]


PAYLOAD = ["size", "dim", "points", "longs", "nodes", "radii"]


def meetings(built: DataFrame, cosine: float, bundle: int) -> DataFrame:
    """blocks_a, blocks_b: the blocks of two bundles that may have links; of a bundle with itself, blocks_b is null."""
    ends = built.select("grp", "block", "centre", "radius", (F.sum("size").over(Window.partitionBy("grp").orderBy("cell", "part")) - F.col("size")).alias("before"))
    ends = ends.withColumn("k", F.floor(F.col("before") / bundle)).withColumn("bundle", F.xxhash64("grp", "k"))
    x, y = (ends.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("bundle", "k", "centre", "radius"))) for s in "ab")
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    # rows of blocks, not of vectors: a pair here stands for millions of pairs of vectors
    pairs = x.join(y, "grp").where("k_a < k_b").where(apart <= F.col("radius_a") + F.col("radius_b") + math.sqrt(2 - 2 * cosine) + ROOM)
    # each bundle stands on either side about as often, so that what meets it is dealt evenly
    turned = (F.col("k_a") + F.col("k_b")) % 2 == 1
    pairs = pairs.select(F.when(turned, F.col("bundle_b")).otherwise(F.col("bundle_a")).alias("a"), F.when(turned, F.col("bundle_a")).otherwise(F.col("bundle_b")).alias("b")).distinct()
    bundles = built.join(F.broadcast(ends.select("block", "bundle")), "block").groupBy("bundle").agg(F.collect_list(F.struct(*PAYLOAD)).alias("blocks"))
    bundles = stored(bundles, "bundles")
    met = pairs.join(bundles.select(F.col("bundle").alias("a"), F.col("blocks").alias("blocks_a")), "a").join(bundles.select(F.col("bundle").alias("b"), F.col("blocks").alias("blocks_b")), "b")
    alone = bundles.select(F.col("blocks").alias("blocks_a"), F.lit(None).cast(bundles.schema["blocks"].dataType).alias("blocks_b"))
    return met.select("blocks_a", "blocks_b").unionByName(alone)


def links(made: DataFrame, cosine: float, block: int = BLOCK, sample: int = SAMPLE, bundle: int = BUNDLE) -> DataFrame:
    """d0, d1, links, r0, r1: of a class in a pair of bundles, the weight it links to (itself included) and what it is connected to."""
    built = stored(blocks(made, block, sample).withColumn("block", F.xxhash64("grp", "cell", "part")), "trees")
    n = built.agg(F.sum("size").alias("n")).first()["n"] or 0
    t = math.sqrt(2 - 2 * cosine)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [batch[c][k].as_py() for c in ("blocks_a", "blocks_b")]
                same = rows[1] is None
                sides = [[opened(*(r[c] for c in PAYLOAD)) for r in side or []] for side in rows]
                ids = np.concatenate([own for side in sides for _, own in side], 1)
                at = np.cumsum([0, *(len(tree.points) for side in sides for tree, _ in side)]).tolist()
                got, root = np.zeros(at[-1], np.int64), np.arange(at[-1])
                trees = [tree for side in sides for tree, _ in side]
                first = len(sides[0])
                for i, a in enumerate(trees[:first]):
                    for j in range(i, first) if same else range(first, len(trees)):
                        b = trees[j]
                        if i != j and math.sqrt(max(0.0, 2 - 2 * float(a.points[a.centre[0]] @ b.points[b.centre[0]]))) > a.radius[0] + b.radius[0] + t + ROOM:
                            continue
                        got_a, got_b, edges, spans = near_pairs(a, b, cosine)
                        got[at[i] : at[i + 1]] += got_a
                        if i != j:
                            got[at[j] : at[j + 1]] += got_b
                        wide = [np.stack([np.full(hi - lo, lo), np.arange(lo, hi)], 1) + at[j if side else i] for side, lo, hi in np.unique(spans, axis=0).tolist()]
                        root = forest(at[-1], np.concatenate([edges + [at[i], at[j]], *wide]), root)
                own = np.flatnonzero(got)
                cols = [ids[0][own], ids[1][own], got[own], ids[0][root[own]], ids[1][root[own]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d0", "d1", "links", "r0", "r1"])

    return meetings(built, cosine, max(block, min(bundle, n // BUNDLES))).mapInArrow(meet, "d0 long, d1 long, links long, r0 long, r1 long")


def near_duplicates(df: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """A row a vector: its id, n_links, component_id and kept."""
    rows, made = classes(df, id_col, vec_col, label_col)
    rows, made = stored(rows, "vector-rows"), stored(made, "vector-classes")
    found = stored(links(made, cosine, block, sample), "vector-links")
    node = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = found.where("d0 <> r0 or d1 <> r1").select(node("d0", "d1").alias("a"), node("r0", "r1").alias("b"))
    least = rows.where("d0 is not null").groupBy("d0", "d1").agg(F.min("id").alias("rep"))
    comp = components(edges).select(F.col("node.x").alias("d0"), F.col("node.y").alias("d1"), "component")
    own = least.join(comp, ["d0", "d1"], "left").withColumn("component", F.coalesce("component", node("d0", "d1")))
    top = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    total = found.groupBy("d0", "d1").agg((F.sum("links") - 1).alias("n_links"))
    result = own.join(top, "component").join(total, ["d0", "d1"]).select("d0", "d1", "n_links", "component_id")
    out = rows.where("d0 is not null").join(result, ["d0", "d1"]).select("id", "n_links", "component_id")
    alone = rows.where("d0 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's rows."""
    return near_duplicates(df)
