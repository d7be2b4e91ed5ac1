"""Metrics over the fact tables. Every function takes Facts and key columns and returns a frame.

by names keys besides the tokenizer; where a metric has a value by language and one over
all languages, both come from one pass, and the column pooled tells them apart: language is null
in the row over all languages, and in the row of texts without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .facts import Facts

ALPHAS = (1.0, 2.0, 2.5, 3.0)
STATS = ("mean", "median", "std", "std_err", "min", "max", "count", "sum")


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


#: Bins in each doubling of a value, when its median is looked for.
BINS = 512


def statistics(df: DataFrame, x: Column, keys: Sequence[str], language: bool = True, sums: Sequence[str] = (), held: bool = False) -> DataFrame:
    """The eight statistics of x (not negative) by keys and language, and by keys alone (pooled); without language by keys alone.

    Values are summed up in bins in each task, so that only bins are shuffled; the moments of
    bins are merged around the common mean, and the median is looked for among the values of the middle
    bin. The standard error of one value is null. sums: columns whose totals are given too. held: df is cached
    or stored and may be read twice; else its values are stored first.
    """
    own = [*keys, "language"] if language else [*keys]
    by = [*own, "pooled"] if language else own
    values = df.select(*own, *sums, x.cast("double").alias("x"))
    values = (values if held else kept(values, "values")).withColumn("bin", F.coalesce(F.floor(F.log2("x") * BINS), F.lit(-1 << 40)).cast("bigint"))
    k = F.count("*")
    bins = values.groupBy(*own, "bin").agg(k.alias("k"), F.avg("x").alias("m"), (F.var_pop("x") * k).alias("m2"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"), *[F.sum(c).alias(c) for c in sums])
    if language:
        both = F.array(F.struct("language", F.lit(False).alias("pooled")), F.struct(F.lit(None).cast("string").alias("language"), F.lit(True).alias("pooled")))
        rest = [c for c in bins.columns if c not in own]
        bins = bins.withColumn("level", F.explode(both)).select(*keys, "level.*", *rest)
    group = Window.partitionBy(*by)
    n = F.sum("k")
    apart = F.col("m") - F.col("mean")
    spread = F.sum(F.col("m2") + F.col("k") * apart * apart) / n
    whole = bins.withColumn("mean", F.sum("sum").over(group) / F.sum("k").over(group))
    out = whole.groupBy(*by).agg(
        F.max("mean").alias("mean"),
        F.sqrt(spread).alias("std"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std_err"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        n.cast("bigint").alias("count"),
        F.sum("sum").alias("sum"),
        *[F.sum(c).alias(c) for c in sums],
    )
    out = out.join(F.broadcast(medians(values, bins, by).select(*[F.col(c).alias(f"__{c}") for c in by], "median")), _same(by), "left")
    return out.select(*by, *STATS, *sums)


def _same(by: Sequence[str]) -> Column:
    """by's columns equal those of the other side, named with underscores before, nulls too."""
    return reduce(and_, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.lit(True))


def medians(values: DataFrame, bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """median by by from values x with their bin, and counts k of bins by by; only values of middle bins are shuffled."""
    group = Window.partitionBy(*by)
    bins = bins.groupBy(*by, "bin").agg(F.sum("k").alias("k"))
    bins = bins.withColumn("upto", F.sum("k").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(group))
    # the two middle places, from 1; the same one for an odd number
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    holds = lambda place: (F.col("upto") >= place) & (F.col("upto") - F.col("k") < place)
    middle = bins.where(holds(low) | holds(high)).select(*[F.col(b).alias(f"__{b}") for b in [*by, "bin"]], (F.col("upto") - F.col("k")).alias("before"), low.alias("low"), high.alias("high"))
    match = _same([b for b in [*by, "bin"] if b not in ("language", "pooled")])
    if "pooled" in by:
        match &= F.col("__pooled") | F.col("language").eqNullSafe(F.col("__language"))
    # two bins a group, of groups that are few by nature
    near = values.join(F.broadcast(middle), match).select(*[F.col(f"__{b}").alias(b) for b in by], "bin", "x", "before", "low", "high")
    near = near.groupBy(*near.columns).agg(F.count("*").alias("k"))
    near = near.withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy(*by, "bin").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)))
    first = lambda place: F.min(F.when(F.col("upto") >= F.col(place), F.col("x")))
    return near.groupBy(*by).agg(((first("low") + first("high")) / 2).alias("median"))


def fertility(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Tokens per unit: the mean over texts, and the other statistics."""
    return statistics(f.docs.where("n_units > 0"), F.col("n_tokens") / F.col("n_units"), keys, held=f.held)


def token_length(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Characters per token over texts."""
    return statistics(f.docs.where("has_text and n_tokens > 0"), F.col("n_chars") / F.col("n_tokens"), keys, False, held=f.held)


def tokens_per_line(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    x = statistics(f.docs.where("has_text"), F.col("n_tokens") / F.col("n_lines"), keys, False, ["n_lines"], f.held)
    return x.withColumnRenamed("n_lines", "total_lines")


def compression(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Units per token; a mean of 1 where there are no texts."""
    x = statistics(f.docs.where("has_text and n_tokens > 0"), F.col("n_units") / F.col("n_tokens"), keys, held=f.held)
    return x.withColumn("mean", F.coalesce("mean", F.lit(1.0)))


#: Columns that tell rows by language from those over all languages.
LEVEL = ("language", "pooled")


def pooled(f: Facts, keys: Sequence[str]) -> DataFrame:
    """Counts by keys and language and by keys alone: token, cnt, and pooled, true for all languages together."""
    one = f.counts.select(*keys, "language", F.lit(False).alias("pooled"), "token", "cnt")
    every = one.groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt")).withColumns({"language": F.lit(None).cast("string"), "pooled": F.lit(True)})
    return one.unionByName(every)


def vocabulary_utilization(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """used_tokens, vocab_size, unused_tokens, utilization; without a vocabulary its size is null."""
    used = pooled(f, keys).groupBy(*keys, *LEVEL).agg(F.count("*").alias("used_tokens"))
    if f.tokenizers is None:
        return used.withColumns({"vocab_size": F.lit(None).cast("bigint"), "unused_tokens": F.lit(None).cast("bigint"), "utilization": F.lit(None).cast("double")})
    size = F.broadcast(f.tokenizers.select("tokenizer", "vocab_size"))
    return used.join(size, "tokenizer", "left").withColumn("unused_tokens", F.col("vocab_size") - F.col("used_tokens")).withColumn("utilization", ratio(F.col("used_tokens"), F.col("vocab_size"), None))


def type_token_ratio(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    x = pooled(f, keys).groupBy(*keys, *LEVEL).agg(F.count("*").alias("types"), F.sum("cnt").alias("tokens"))
    return x.withColumn("ttr", ratio(F.col("types"), F.col("tokens")))


def entropy_of(cnt: Column, alpha: float, times: Column | None = None) -> Column:
    """Rényi entropy in bits of the counts in a group, each occurring times times; alpha 1 is Shannon's. 0 without counts.

    Written over counts, so that their total needs no second pass.
    """
    m, c = times if times is not None else F.lit(1), cnt.cast("double")
    n = F.sum(c * m)
    if alpha == 1.0:
        return F.coalesce(F.log2(n) - F.sum(m * c * F.log2(c)) / n, F.lit(0.0))
    return F.coalesce((F.log2(F.sum(m * F.pow(c, F.lit(alpha)))) - alpha * F.log2(n)) / (1 - alpha), F.lit(0.0))


def renyi(f: Facts, alphas: Sequence[float] = ALPHAS, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """alpha, entropy by keys and language; all orders in one aggregation."""
    x = pooled(f, keys).groupBy(*keys, *LEVEL).agg(*[entropy_of(F.col("cnt"), a).alias(f"a{i}") for i, a in enumerate(alphas)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("entropy")) for i, a in enumerate(alphas)]))
    return x.select(*keys, *LEVEL, rows.alias("r")).select(*keys, *LEVEL, "r.*")


def unigram(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """unigram_entropy, avg_token_rank (over occurrences, ranks by falling count), total_tokens, unique_tokens.

    Tokens of one count share a sum of ranks whatever their order, so counts are grouped
    first: ranks are then numbered over distinct counts, not over the vocabulary.
    """
    by = [*keys, *LEVEL]
    same = pooled(f, keys).groupBy(*by, "cnt").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by).orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    m, cnt = F.col("m"), F.col("cnt")
    ranks = same.withColumn("above", F.coalesce(F.sum("m").over(w), F.lit(0))).withColumn("ranks", cnt * (m * F.col("above") + m * (m + 1) / 2))
    return ranks.groupBy(*by).agg(entropy_of(cnt, 1.0, m).alias("unigram_entropy"), (F.sum("ranks") / F.sum(cnt * m)).alias("avg_token_rank"), F.sum(cnt * m).alias("total_tokens"), F.sum("m").alias("unique_tokens"))


def language_costs(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Tokens per unit of all texts of a language together."""
    return f.docs.groupBy(*keys, "language").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_units").alias("units")).where("units > 0").withColumn("cost", F.col("tokens") / F.col("units"))


def gini(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Inequality of costs among languages, from one sorted pass; 0 for fewer than two languages."""
    c = language_costs(f, keys)
    w = Window.partitionBy(*keys).orderBy("cost", "language")
    c = c.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    g = c.groupBy(*keys).agg(
        F.when(F.max("n") < 2, 0.0).otherwise(ratio(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("cost")), F.max("n") * F.sum("cost"))).alias("gini_coefficient"),
        F.avg("cost").alias("mean_cost"),
        F.stddev_pop("cost").alias("std_cost"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
        F.when(F.min("cost") > 0, F.max("cost") / F.min("cost")).otherwise(float("inf")).alias("cost_ratio"),
        F.min_by("language", F.struct("cost", "language")).alias("most_efficient_language"),
        F.max_by("language", F.struct("cost", "language")).alias("least_efficient_language"),
        F.count("*").alias("num_languages"),
    )
    return g


def lorenz(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Points of the curve: i, x (share of languages), y (share of costs), language; the first is (0, 0). Two languages at least."""
    c = language_costs(f, keys)
    w = Window.partitionBy(*keys)
    up = w.orderBy("cost", "language").rowsBetween(Window.unboundedPreceding, 0)
    c = c.select(*keys, "language", "cost", F.row_number().over(w.orderBy("cost", "language")).cast("bigint").alias("i"), F.count("*").over(w).alias("n"), F.sum("cost").over(w).alias("all"), F.sum("cost").over(up).alias("sum")).where("n > 1")
    points = c.select(*keys, "i", (F.col("i") / F.col("n")).alias("x"), (F.col("sum") / F.col("all")).alias("y"), "language")
    zero = c.where("i = 1").select(*keys, F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("string").alias("language"))
    return points.unionByName(zero)


def unknown_share(tokens: DataFrame, tokenizers: DataFrame, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """Per cent of tokens that are the unknown one, over texts; only tokenizers that have it."""
    t = tokens.join(F.broadcast(tokenizers.where("unk_id is not null").select("tokenizer", F.col("unk_id").cast("string").alias("u"))), "tokenizer")
    return statistics(t, 100.0 * F.size(F.filter("tokens", lambda k: k == F.col("u"))) / F.size("tokens"), keys)


def redundancy(f: Facts, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """entropy H and redundancy 1 - H / log2(types)."""
    x = f.counts.groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt")).groupBy(*keys).agg(entropy_of(F.col("cnt"), 1.0).alias("entropy"), F.count("*").alias("types"))
    return x.withColumn("redundancy", 1 - F.coalesce(F.try_divide(F.col("entropy"), F.log2(F.col("types").cast("double"))), F.lit(0.0)))


def pairwise(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each two tokenizers' values compared (names in order); values has a row for each tokenizer, so it is small."""
    a = values.select(*keys, F.col("tokenizer").alias("tokenizer_1"), F.col(value).alias("value_1"))
    b = values.select(*keys, F.col("tokenizer").alias("tokenizer_2"), F.col(value).alias("value_2"))
    x = a.join(F.broadcast(b), [*keys]).where("tokenizer_1 < tokenizer_2") if keys else a.join(F.broadcast(b), F.col("tokenizer_1") < F.col("tokenizer_2"))
    v1, v2 = F.col("value_1"), F.col("value_2")
    return x.withColumns({"difference": v1 - v2, "ratio": ratio(v1, v2, 1.0), "percent_difference": ratio(F.abs(v1 - v2) * 100, (v1 + v2) / 2)})


def tidy(df: DataFrame, metric: str, stats: Sequence[str], keys: Sequence[str] = ("tokenizer", "language")) -> DataFrame:
    """metric, keys, stat, value: one row a number."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats]))
    have = [F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys]
    return df.select(F.lit(metric).alias("metric"), *have, rows.alias("r")).select("metric", *keys, "r.*")
