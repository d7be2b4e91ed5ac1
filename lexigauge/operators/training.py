"""What tokenizer training needs from a corpus: counts of words, tokens and runs of single characters."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import entropy_of

END = "Ġ"


def word_counts(corpus: DataFrame) -> DataFrame:
    """word, cnt of the parts between single spaces."""
    return corpus.select(F.explode(F.split("text", " ", -1)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("cnt"))


def merged_runs(tokens: Column, end: str = END) -> Column:
    """Runs of two single-character tokens or more, joined; the end mark closes a run and belongs to it.

    Tokens of more characters become breaks, then the joined text is cut at them.
    """
    gap = "\x00"
    shown = F.array_join(F.transform(tokens, lambda t: F.when(t == end, F.concat(t, F.lit(gap))).when(F.length(t) == 1, t).otherwise(gap)), "")
    return F.filter(F.split(shown, gap, -1), lambda r: F.length(r) > 1)


def run_counts(words: DataFrame, tokens: Column, end: str = END) -> DataFrame:
    """seq, cnt over words weighted by their counts: each distinct word is tokenized once."""
    x = words.select("cnt", F.explode(merged_runs(tokens, end)).alias("seq"))
    return x.groupBy("seq").agg(F.sum("cnt").alias("cnt"))


def token_frequency(words: DataFrame, tokens: Column) -> DataFrame:
    return words.select("cnt", F.explode(tokens).alias("token")).groupBy("token").agg(F.sum("cnt").alias("cnt"))


def top(counts: DataFrame, k: int, item: str = "seq") -> DataFrame:
    """The k most frequent, ties by name: a top-k, not a full sort."""
    return counts.orderBy(F.desc("cnt"), item).limit(k)


def extended_vocabulary(base: dict[str, int], found: Sequence[str], size: int, cutoff: int | None = None) -> dict[str, int]:
    """The first cutoff entries of base, then found entries that are new, up to size."""
    out = {t: i for i, t in enumerate(t for t, i in sorted(base.items(), key=lambda x: x[1]) if cutoff is None or i < cutoff)}
    for t in found:
        if len(out) >= size:
            break
        out.setdefault(t, len(out))
    return out


def cutoff_sweep(counts: DataFrame, cutoffs: Sequence[int], item: str = "token") -> DataFrame:
    """cutoff, entropy, redundancy of the most frequent entries at each cutoff; one sorted pass over the top entries.

    The cutoffs are bounded by the vocabulary wanted, so the top entries are few.
    """
    from pyspark.sql import Window

    t = top(counts, max(cutoffs), item).withColumn("i", F.row_number().over(Window.orderBy(F.desc("cnt"), item)))
    x = t.join(F.broadcast(counts.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff int")), F.col("i") <= F.col("cutoff"))
    h = x.groupBy("cutoff").agg(entropy_of(F.col("cnt"), 1.0).alias("entropy"), F.count("*").alias("types"))
    return h.withColumn("redundancy", 1 - F.coalesce(F.try_divide(F.col("entropy"), F.log2(F.col("types").cast("double"))), F.lit(0.0)))


def piece_counts(corpus: DataFrame, pre) -> DataFrame:
    """word, cnt of the pieces that a pre-tokenizer of the tokenizers library makes of whole texts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "cnt"])
            held.clear()
            return b

        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    held.update(p for p, _ in pre.pre_tokenize_str(text.as_py()))
                if len(held) > 300_000:
                    yield flush()
        yield flush()

    return corpus.select(F.col("text").cast("string")).mapInArrow(run, "word string, cnt long").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def learned_merges(counts: Sequence[tuple[str, int]], size: int, special: Sequence[str], alphabet: Sequence[str], end_suffix: str | None = None) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges from pieces with their exact counts, by the steps of the library's own trainer.

    The most frequent pair is merged next, ties by ids; counts are not bounded.
    """
    names = list(dict.fromkeys(special))
    names += sorted({*alphabet, *(c for w, _ in counts for c in w)}.difference(names))
    ids = {t: i for i, t in enumerate(names)}

    def number(token: str) -> int:
        if token not in ids:
            ids[token] = len(names)
            names.append(token)
        return ids[token]

    words = [[number(c + end_suffix if end_suffix and i + 1 == len(w) else c) for i, c in enumerate(w)] for w, _ in counts]
    pairs: dict[tuple[int, int], int] = {}
    places: dict[tuple[int, int], set[int]] = {}
    for i, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] = pairs.get(p, 0) + counts[i][1]
            places.setdefault(p, set()).add(i)
    heap = [(-pairs[p], p, n, at) for n, (p, at) in enumerate(places.items())]
    heapq.heapify(heap)
    entries, merges = len(heap), []
    while len(names) < size and heap:
        c, (a, b), n, at = heapq.heappop(heap)
        if -c != pairs[a, b]:
            if pairs[a, b] > 0:
                heapq.heappush(heap, (-pairs[a, b], (a, b), n, at))
            continue
        new = number(names[a] + names[b])
        merges.append((names[a], names[b]))
        found: dict[tuple[int, int], set[int]] = {}

        def change(p: tuple[int, int], k: int, i: int) -> None:
            pairs[p] = pairs.get(p, 0) + k
            if k > 0:
                found.setdefault(p, set()).add(i)  # noqa: B023

        for i in at:
            w, k, j = words[i], counts[i][1], 0
            while j + 1 < len(w):
                if w[j] == a and w[j + 1] == b:
                    if j:
                        change((w[j - 1], a), -k, i)
                        change((w[j - 1], new), k, i)
                    w[j : j + 2] = [new]
                    if j + 1 < len(w):
                        change((b, w[j + 1]), -k, i)
                        change((new, w[j + 1]), k, i)
                j += 1
        for p, where in found.items():
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p, entries, where))
                entries += 1
    return ids, merges


def train_bpe(corpus: DataFrame, size: int, *, end_suffix: str | None = None, special: Sequence[str] = ("<unk>",), most_words: int | None = None):
    """A byte-level BPE of the tokenizers library, with the merges that its trainer learns from all whole texts.

    Pieces are counted in tasks; the driver learns the merges from all distinct pieces with
    their exact counts, or from the most_words most frequent if that is given.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    extra = {"end_of_word_suffix": end_suffix} if end_suffix else {}
    pre = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(use_regex=False)]) if end_suffix else pre_tokenizers.ByteLevel(add_prefix_space=True)
    counts = piece_counts(corpus, pre)
    counts = counts if most_words is None else top(counts, most_words, "word")
    rows = sorted((r["word"], r["cnt"]) for r in counts.toLocalIterator())
    vocab, merges = learned_merges(rows, size, special, pre_tokenizers.ByteLevel.alphabet(), end_suffix)
    tok = Tokenizer(models.BPE(vocab, merges, **({"unk_token": special[0]} if special else {}), **extra))
    tok.add_special_tokens(list(special))
    tok.pre_tokenizer = pre
    tok.decoder = decoders.ByteLevel()
    return tok
