"""A hidden Markov language model with counts from the whole corpus.

Words are counted over all training documents. Words that occur OFTEN times, and the
CLASSES most frequent in any case, are observations of their own; the others share one
class and, within it, are drawn by their add-one counts. States, transitions and emissions start where they fit the counts of
adjacent words in all training documents, and Baum-Welch trains them by passes over all whole training documents, whose expected
counts are added up across partitions. No step learns from a sample. A text's likelihood is exact, by the scaled forward recursion over
the whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cached_in_worker, pieces, stored, utf8
from .sampling import held_out

STATES, CLASSES = 8, 8192
#: Occurrences that make a word of the head a class of its own, so that classes grow with the corpus.
OFTEN = 100
#: Words whose counts every task gets, at most; counts of all others are joined.
HEAD = 200_000
#: Longer words go by a digest of their bytes, so that what every task gets has a bound. No word has the digest's leading space.
WORD_BYTES = 64
#: Rounds that fit the start to counts of adjacent words; passes over all training documents.
WARM, PASSES = 200, 2
#: Classes told apart in counts of adjacent words, the most frequent ones; other words count there as one, and the end as another.
ADJACENT = 512
#: Texts of more tokens are trained on apart from others, and so many tokens of the shorter and of the longer ones at once.
LONG, TOGETHER = 1024, (400_000, 1_000_000)
#: Expected counts of one row when they are added up.
BLOCK = 8192
LOG10 = float(np.log(10))


def words(text: bytes | None) -> list[bytes]:
    w = text.translate(LOWER).split() if text else []
    if w and max(map(len, w)) > WORD_BYTES:
        w = [x if len(x) <= WORD_BYTES else b" " + xxhash.xxh3_128_hexdigest(x).encode() for x in w]
    return w


def counted(texts: DataFrame) -> DataFrame:
    """token, c over all texts; the end of a text is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return b

        for b in pieces(batches):
            for text in utf8(b.column(0)):
                held.update(words(text))
                held[b""] += 1
                if len(held) > 300_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of at least some count, as many as most allows: found from the numbers of words by size of count, without a sort."""
    size = F.floor(F.log2("c") * 64).cast("int")
    left, least = most, 0
    for r in sorted(counts.groupBy(size.alias("s")).agg(F.count("*").alias("words"), F.min("c").alias("least")).collect(), reverse=True):  # at most 64 sizes a doubling
        left, least = left - r["words"], least if left < r["words"] else r["least"]
        if left < 0:
            return counts.where(F.col("c") >= least) if least else counts.limit(0)
    return counts


@dataclass
class Params:
    """start (S), step (S, S), emit (C + 2, S): a row for each class, then the other words, then the end."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, np.float64).tobytes() for x in (self.start, self.step, self.emit))

    @staticmethod
    def unpack(raw: bytes, states: int) -> Params:
        x = np.frombuffer(raw, np.float64)
        return Params(x[:states], x[states : states * (states + 1)].reshape(states, states), x[states * (states + 1) :].reshape(-1, states))


def initial(base: np.ndarray, states: int) -> Params:
    """Emissions are the words' frequencies, disturbed so that states can part."""
    rng = np.random.default_rng(5)
    emit = base[:, None] * np.exp(rng.normal(0, 1, (len(base), states)))
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Params(np.full(states, 1 / states), step, emit / emit.sum(0))


def expected(p: Params, obs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, step, emit) and log likelihood of whole texts given one after the other."""
    s = len(p.start)
    if not len(sizes):
        return np.zeros(s), np.zeros((s, s)), np.zeros_like(p.emit), 0.0
    # rows are put by step, within a step the longest texts first: texts that go on are the first rows of each step
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    top = int(sizes.max())
    at = np.r_[0, np.cumsum(np.searchsorted(-sizes[order], -np.arange(top), "left"))]
    t = np.arange(len(obs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by_step = np.empty_like(obs)
    by_step[at[t] + np.repeat(rank, sizes)] = obs
    obs, at = by_step, at.tolist()
    alpha = np.empty((len(obs), s))
    scale = np.empty((len(obs), 1))
    a = np.tile(p.start, (len(sizes), 1))
    for t in range(top):
        i, j = at[t], at[t + 1]
        a = (a[: j - i] @ p.step if t else a) * p.emit[obs[i:j]]
        scale[i:j, 0] = a.sum(1)
        a = np.divide(a, scale[i:j], out=alpha[i:j])
    step = np.zeros((s, s))
    b = np.ones((len(sizes), s))
    for t in range(top - 1, -1, -1):
        i, j = at[t], at[t + 1]
        m = at[t + 2] - j if t + 1 < top else 0
        if m:  # b of longer texts is carried on
            w = p.emit[obs[j : j + m]] * b[:m] / scale[j : j + m]
            step += alpha[i : i + m].T @ w
            b[:m] = w @ p.step.T
        alpha[i:j] *= b[: j - i]  # from here on the states' probabilities
    emit = np.stack([np.bincount(obs, alpha[:, k], len(p.emit)) for k in range(s)], 1)
    return alpha[: at[1]].sum(0), step * p.step, emit, float(np.log(scale).sum())


def maximised(p: Params, start: np.ndarray, step: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Params:
    """New parameters; the base frequencies stand in with the weight of 50 tokens a state."""
    start, step, emit = start + 1, step + 1, emit + 50 * base[:, None]
    return Params(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def likelihood(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each text: the scaled forward recursion, all texts in step."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    obs = np.concatenate([texts[i] for i in order])
    sorted_sizes = sizes[order]
    begin = np.cumsum(sorted_sizes) - sorted_sizes
    live = np.searchsorted(-sorted_sizes, -np.arange(int(sorted_sizes[0])), "left")
    logs = np.zeros(len(texts))
    a = np.tile(p.start, (len(texts), 1))
    for t, n in enumerate(live.tolist()):
        a = (a[:n] @ p.step if t else a[:n]) * p.emit[obs[begin[:n] + t]]
        c = a.sum(1)
        a = a / c[:, None]
        logs[:n] += np.log(c)
    out[order] = logs
    return out


class Classes(dict):
    """Word to its rank among the head; other words are -1 and are not kept."""

    def __missing__(self, word: bytes) -> int:
        return -1


def ranks(get, text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    w = words(text)
    return w, np.fromiter(map(get, w), np.int64, len(w))


def observed(rank: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word, the other words' class for the rest, and the end."""
    out = np.full(len(rank) + 1, classes + 1, np.int64)
    out[:-1] = np.where((rank < 0) | (rank >= classes), classes, rank)
    return out


def runs(obs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts one after the other, and their sizes."""
    return np.concatenate(obs) if obs else np.zeros(0, np.int64), np.array([len(x) for x in obs], np.int64)


class Model:
    """What the corpus says (n, v and the head's counts) and the trained parameters."""

    def __init__(self, spark, counts: DataFrame, classes: int, head: int, states: int):
        r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
        self.n, self.v, self.ends = r["n"], r["v"], r["ends"]
        top = frequent(counts.where(F.col("token") != ""), head).toArrow()
        most = sorted(zip(top["c"].to_pylist(), (x.encode() for x in top["token"].to_pylist()), strict=True), key=lambda x: (-x[0], x[1]))
        self.head = [x for _, x in most]
        self.c = np.array([c for c, _ in most], np.int64)
        self.classes, self.states = min(max(classes, int((self.c >= OFTEN).sum())), len(self.head)), states
        own = self.c[: self.classes] + 1
        # mass of all other words, the unseen one among them, which stays also where no text was learned from
        self.rest = max(1.0, float(self.n + self.v + 1 - own.sum() - (self.ends + 1)))
        base = np.r_[own, self.rest, self.ends + 1].astype(np.float64)
        self.base = base / base.sum()
        self.params = initial(self.base, states)
        self.sent = spark.sparkContext.broadcast((self.head, np.log10(self.c + 1.0)))

    def in_worker(self):
        """Function for executors: the head's dictionary and logs of its counts."""
        sent, key = self.sent, f"hmm:{id(self)}:{self.n}:{self.v}:{zlib.crc32(self.c.tobytes())}"

        def get():
            return cached_in_worker(key, lambda: (Classes({w: i for i, w in enumerate(sent.value[0])}), sent.value[1]))

        return get


def adjacent(texts: DataFrame, m: Model) -> np.ndarray:
    """How often each of the most frequent classes, the other words and the end stand behind each other, in all texts: exact counts."""
    get, classes = m.in_worker(), m.classes
    k = min(ADJACENT, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = get()[0].__getitem__
        total = np.zeros((k + 2) ** 2, np.int64)
        for b in pieces(batches):
            held = [np.zeros(0, np.int64)]
            for text in utf8(b.column(0)):
                x = observed(ranks(at, text)[1], classes)
                x = np.where(x > classes, k + 1, np.minimum(x, k))
                held.append(x[:-1] * (k + 2) + x[1:])
            total += np.bincount(np.concatenate(held), minlength=len(total))
        yield in_blocks(total)

    return added_up(texts.mapInArrow(run, BLOCKS), np.int64).reshape(k + 2, k + 2)


def started(pairs: np.ndarray, base: np.ndarray, states: int, rounds: int) -> Params:
    """Parameters fitted to counts of adjacent classes by rounds of expectation and maximisation; words that the counts do not tell apart share their states."""
    p = initial(base, states)
    if not pairs.sum():
        return p
    k = len(pairs) - 2
    own = np.r_[base[:k], base[k:-1].sum(), base[-1]]
    emit = np.concatenate([p.emit[:k], p.emit[k:-1].sum(0, keepdims=True), p.emit[-1:]])
    both = p.step * p.start[:, None]  # of two adjacent words: the states of both
    for _ in range(rounds):
        r = pairs / np.maximum(emit @ both @ emit.T, 1e-300)
        right, left = r @ emit, r.T @ emit
        both, emit = both * (emit.T @ right) + 1, emit * (right @ both.T + left @ both) + 50 * own[:, None]
        both, emit = both / both.sum(), emit / emit.sum(0)
    start = both.sum(1)
    rest = base[k:-1, None] / own[k]
    return Params(start, both / start[:, None], np.concatenate([emit[:k], rest * emit[k], emit[-1:]]))


def train(texts: DataFrame, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES, head: int = HEAD, warm: int = WARM, passes: int = PASSES) -> Model:
    """Fit on all texts; without any, the parameters stay at their start."""
    m = Model(texts.sparkSession, counts, classes, head, states)
    if not m.ends:
        return m
    m.params = started(adjacent(texts.select(text_col), m), m.base, states, warm)
    for _ in range(passes):
        m.params = maximised(m.params, *summed(texts.select(text_col), m), m.base)
    return m


BLOCKS = "block int, task int, x binary"


def in_blocks(total: np.ndarray) -> pa.RecordBatch:
    """A task's numbers as a few rows."""
    from pyspark import TaskContext

    # about the root of the number of tasks at each of the two steps that add up
    task = math.isqrt(TaskContext.get().partitionId())
    k = range(0, len(total), BLOCK)
    return pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in k], pa.int32()), pa.array([task] * len(k), pa.int32()), pa.array([total[i : i + BLOCK].tobytes() for i in k], pa.binary())], names=["block", "task", "x"])


def added_up(parts: DataFrame, kind: type) -> np.ndarray:
    """The sum of all tasks' numbers of a kind, in two steps; single precision is added up in double."""
    wide = np.int64 if kind is np.int64 else np.float64

    def add(by: list[str]):
        def f(t: pa.Table) -> pa.Table:
            x = sum(np.frombuffer(v, kind).astype(wide) for v in t["x"].to_pylist())
            return pa.table({"block": t["block"].slice(0, 1), "task": t["task"].slice(0, 1), "x": pa.array([x.astype(kind).tobytes()], pa.binary())})

        return lambda d: d.groupBy(*by).applyInArrow(f, BLOCKS)

    got = {r["block"]: np.frombuffer(bytes(r["x"]), kind) for r in add(["block"])(add(["block", "task"])(parts)).collect()}  # as large as one task's numbers
    return np.concatenate([got[k] for k in sorted(got)]).astype(wide)


def summed(texts: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Baum-Welch expectation over all texts: counts of a task leave it as a few rows of single precision, and are added up in double, in two steps."""
    get, classes, states = m.in_worker(), m.classes, m.states
    raw = texts.sparkSession.sparkContext.broadcast(m.params.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = Params.unpack(raw.value, states), get()[0].__getitem__
        total = np.zeros(states + states * states + len(p.emit) * states)
        held: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        n = [0, 0]

        def add(k: int) -> None:
            start, step, emit, _ = expected(p, *runs(held[k]))
            total[:] += np.concatenate([start, step.ravel(), emit.ravel()])
            held[k].clear()
            n[k] = 0

        for b in pieces(batches):
            for text in utf8(b.column(0)):
                x = observed(ranks(at, text)[1], classes)
                long = int(len(x) > LONG)
                held[long].append(x)
                n[long] += len(x)
                if n[long] > TOGETHER[long]:
                    add(long)
        for k in (0, 1):
            add(k)
        yield in_blocks(total.astype(np.float32))

    x = added_up(texts.mapInArrow(run, BLOCKS), np.float32)
    s = states
    return x[:s], x[s : s + s * s].reshape(s, s), x[s + s * s :].reshape(-1, s)


def scored(docs: DataFrame, m: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row; null and empty texts are an end alone.

    Repeated rows and ids are scored row by row, very long texts as a whole; an empty table
    gives no rows, and extra columns are left out. Where nothing was learned, all words are
    unseen and scores are finite. Counts of words beyond the head are joined by word, one row
    for each text and word.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    get, classes, states = m.in_worker(), m.classes, m.states
    raw = docs.sparkSession.sparkContext.broadcast(m.params.pack())
    known_end, end_log = int(m.ends > 0), float(np.log10(m.ends + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in pieces(batches, 4096):
            # about so many tokens at once
            held, size, begin = [], 0, 0
            for i, text in enumerate(utf8(b.column(1))):
                held.append(text)
                size += len(text or b"")
                if size > 4_000_000 or i + 1 == b.num_rows:
                    yield made(b.column(0).slice(begin, len(held)), held, row + begin)
                    held, size, begin = [], 0, i + 1
            row += b.num_rows

    def made(ids: pa.Array, texts: list[bytes | None], row: int) -> pa.RecordBatch:
        p = Params.unpack(raw.value, states)
        index, logs = get()
        at = index.__getitem__
        obs, n, known, every, out, others, tails = [], [], [], [], [], [], []
        for text in texts:
            w, rank = ranks(at, text)
            o = observed(rank, classes)
            obs.append(o)
            n.append(len(o))
            inside = rank[rank >= 0]
            known.append(len(inside) + known_end)
            every.append(float(logs[inside].sum()) + end_log)
            out.append(float(logs[inside[inside >= classes]].sum()))
            others.append(int((o == classes).sum()))
            tails.append(Counter(w[i] for i in np.flatnonzero(rank < 0).tolist()) if len(inside) < len(rank) else {})
        ll = likelihood(p, obs) / LOG10
        words_ = pa.array([[x.decode() for x in t] for t in tails], pa.list_(pa.string()))
        times = pa.array([list(t.values()) for t in tails], pa.list_(pa.int64()))
        cols = [pa.array(range(row, row + len(texts)), pa.int64()), ids, pa.array(n, pa.int64()), pa.array(known, pa.int64()), *(pa.array(x, pa.float64()) for x in (every, out, ll.tolist())), pa.array(others, pa.int64()), words_, times]
        return pa.RecordBatch.from_arrays(cols, names=["row", id_col, "n", "known", "every", "out", "ll", "others", "words", "times"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    x = stored(src.mapInArrow(run, f"row long, `{id_col}` {id_type}, n long, known long, every double, out double, ll double, others long, words array<string>, times array<long>"), "hmm")
    tail = x.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("token"), F.col("w.times").alias("k"))
    tail = tail.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_log"))
    x = x.drop("words", "times").join(tail, "row", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("every") + log - F.col("n") * F.lit(float(np.log10(m.n + m.v + 1.0)))
    score = F.col("ll") + F.col("out") + log - F.col("others") * F.lit(float(np.log10(max(m.rest, 1.0))))
    return x.select(id_col, F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(m.n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: all documents outside the held-out fold train, all documents are scored."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    test = held_out("doc_id", 7, 2)
    learn = src.where(~test)
    counts = stored(counted(learn.select("text")), "counts")
    m = train(learn, counts)
    return scored(src, m, counts).select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
