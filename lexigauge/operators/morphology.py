"""How well token boundaries agree with morpheme boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import SPACE

# Punctuation that word alignment ignores, and marks that tokenizers put on tokens.
PUNCTUATION = '.,!?;:"()[]{}'
# Two-letter and underscored language codes and their three-letter codes.
ISO_1_TO_2 = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "cs": "ces", "pl": "pol", "fi": "fin", "hu": "hun", "tr": "tur", "sv": "swe", "mn": "mon", "sr": "srp", "hr": "hrv", "ca": "cat"}
LEAST_WORD = 2


def cleaned(tokens: Column) -> Column:
    """Tokens without their marks: the first of a leading space mark, ##, </w>, @@; special tokens and empty ones go."""

    def one(t: Column) -> Column:
        return (
            F.when(F.regexp_like(t, F.lit("^[Ġ▁ ]")), F.substring(t, 2, 1 << 30))
            .when(F.startswith(t, F.lit("##")), F.substring(t, 3, 1 << 30))
            .when(F.endswith(t, F.lit("</w>")), F.regexp_replace(t, "</w>$", ""))
            .when(F.endswith(t, F.lit("@@")), F.regexp_replace(t, "@@$", ""))
            .when(F.regexp_like(t, F.lit(r"(?s)^(?:<\||\[).*(?:\|>|\])$")), F.lit(""))
            .otherwise(t)
        )

    return F.filter(F.transform(tokens, one), lambda t: t != "")


#: Of Python's white space, which words are split at.
WORDS = rf"(?U)[^{SPACE}]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case, without punctuation at their ends."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return F.transform(found, lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def _up_to_next(starts: Column, end: Column) -> Column:
    """Structs (s, e) of intervals that begin at starts, each up to the next; the last up to end."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(end))
    return F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def _part(tokens: Column, x: Column) -> Column:
    return F.slice(tokens, x["s"] + 1, x["e"] - x["s"])


def _punctuation(tokens: Column) -> Column:
    """Whether a group behind a text's first is punctuation alone, without its space mark and continuation marks."""
    shown = F.transform(tokens, lambda t, i: F.when(i == 0, F.substring(t, 2, 1 << 30)).when(F.startswith(t, F.lit("##")), F.substring(t, 3, 1 << 30)).otherwise(t))
    return F.btrim(F.array_join(shown, ""), F.lit(PUNCTUATION)) == ""


def aligned(df: DataFrame) -> DataFrame:
    """df (text, tokens) with pairs: words of the text with their tokens, array<struct<word, tokens>>, in expressions alone.

    A token that begins with a space mark begins a group; groups of punctuation alone join the one before;
    groups and words are paired in order, and what is left over goes to the last word. Groups are intervals of the
    token array, so a text costs time in proportion to its length.
    """
    tokens = F.col("tokens")
    n = F.size("tokens")
    begins = lambda i: (i == 0) | F.startswith(F.get(tokens, i), F.lit("Ġ")) | F.startswith(F.get(tokens, i), F.lit(" "))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    x = df.withColumns({"__words": words_of(F.col("text")), "__starts": F.filter(places, begins)})
    x = x.withColumn("__groups", _up_to_next(F.col("__starts"), n))
    own = F.filter("__groups", lambda g, k: (k == 0) | ~_punctuation(_part(tokens, g)))
    x = x.withColumn("__starts", F.transform(own, lambda g: g["s"])).withColumn("__m", F.least(F.size("__words"), F.size("__starts")))
    x = x.withColumn("__groups", _up_to_next(F.slice("__starts", 1, F.col("__m")), n))
    pairs = F.zip_with(F.slice("__words", 1, F.col("__m")), "__groups", lambda w, g: F.struct(w.alias("word"), _part(tokens, g).alias("tokens")))
    none = F.array().cast("array<struct<word:string,tokens:array<string>>>")
    return x.withColumn("pairs", F.when(F.coalesce(F.col("text") != "", F.lit(False)) & (F.col("__m") > 0), pairs).otherwise(none)).drop("__words", "__starts", "__groups", "__m")


def align_words(tokens: DataFrame) -> DataFrame:
    """tokenizer, language, word, tokens, n: distinct words (two letters at least) with their tokens (strings) and how often they occur."""
    # an outer one, as for the other the planner also filters by the size of pairs and so computes them many times; its rows without a word go below
    x = aligned(tokens.select("tokenizer", "language", "text", "tokens")).select("tokenizer", "language", F.explode_outer("pairs").alias("p")).select("tokenizer", "language", "p.word", "p.tokens")
    return x.where(F.length("word") >= LEAST_WORD).groupBy("tokenizer", "language", "word", "tokens").agg(F.count("*").alias("n"))


def _side_by_side(parts: Column, word: Column) -> Column:
    """Ends of parts that spell word, one after the other; null if they don't."""
    lengths = F.transform(parts, F.length)
    run = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), lambda s, k: F.struct((s["at"] + k).alias("at"), F.concat(s["ends"], F.array(s["at"] + k)).alias("ends")))
    spelled = (F.lower(F.array_join(parts, "")) == F.lower(word)) & ~F.exists(parts, lambda p: p == "") & (run["at"] <= F.length(word))
    return F.when(spelled, run["ends"])


def _as_found(parts: Column, word: Column, skip: bool) -> Column:
    """Ends of parts searched in word from left to right; null if none are found or one is empty. A part that is not there is skipped, or takes its length of what is left."""
    low, n = F.lower(word), F.length(word)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"), F.lit(True).alias("sound"))

    def step(s: Column, p: Column) -> Column:
        p = F.lower(p)
        found = F.position(p, low, s["at"] + 1)
        end = F.when(found > 0, found - 1 + F.length(p))
        if not skip:
            end = F.coalesce(end, F.least(n, s["at"] + F.length(p)))
        on = F.struct(end.alias("at"), F.concat(s["ends"], F.array(end)).alias("ends"), s["sound"].alias("sound"))
        past = F.lit(False) if skip else s["at"] >= n
        empty = F.struct(s["at"].alias("at"), s["ends"].alias("ends"), F.lit(False).alias("sound"))
        return F.when(past, s).when(p == "", empty).when(end.isNull(), s).otherwise(on)

    run = F.aggregate(parts, zero, step)
    return F.when(run["sound"] & (F.size(run["ends"]) > 0), run["ends"])


def boundaries(parts: Column, word: Column, morphemes: bool) -> Column:
    """Ends inside word of its tokens or morphemes: side by side if they spell it, else as found, else evenly."""
    n, k = F.length(word), F.size(parts)
    evenly = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.when(i >= k, n).otherwise(F.floor(i * n / k)).cast("int"))
    ends = F.coalesce(_side_by_side(parts, word), _as_found(parts, word, morphemes), evenly)
    return F.array_distinct(F.filter(ends, lambda e: e != n))


def scores(word: Column, tokens: Column, morphemes: Column, gold: Column, cut: Column | None = None) -> dict[str, Column]:
    """Alignment of clean tokens with morphemes, from the ends inside the word; gold: those of the morphemes, cut: of the tokens. Null without tokens, morphemes or word."""
    cut = boundaries(tokens, word, False) if cut is None else cut
    both = F.size(F.array_intersect(cut, gold)).cast("double")
    part = lambda n: F.coalesce(F.try_divide(both, n.cast("double")), F.lit(0.0))
    p, r, m = part(F.size(cut)), part(F.size(gold)), F.size(morphemes)
    made = {
        "boundary_precision": p,
        "boundary_recall": r,
        "boundary_f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)),
        "morpheme_preservation": F.size(F.filter(morphemes, lambda x: F.array_contains(tokens, x))) / m,
        "over_segmentation": F.greatest(F.lit(0), F.size(tokens) - m) / m,
    }
    known = (F.size(tokens) > 0) & (m > 0) & (word != "")
    return {k: F.when(known, v) for k, v in made.items()}


SCORES = ("boundary_precision", "boundary_recall", "boundary_f1", "morpheme_preservation", "over_segmentation")


def lexicon_key(language: Column, known: list[str]) -> Column:
    """The code to look a language up by: its own, its three-letter code or the code before an underscore, the first that is known; null without any."""
    iso = F.create_map(*[F.lit(x) for pair in ISO_1_TO_2.items() for x in pair])
    codes = [language, F.coalesce(F.try_element_at(iso, language), language), F.split(language, "_")[0]]
    return F.coalesce(*[F.when(c.isin(known), c) for c in codes])


#: Columns of a lexicon that scores carry on: how often a word occurs, and which part of the data it is of.
EXTRA = ("freq", "split")


def best_entries(lexicon: DataFrame) -> DataFrame:
    """One segmentation a word and language, that of the dataset of least priority number, with its boundaries."""
    w = Window.partitionBy("language", "word").orderBy("dataset_priority", "dataset")
    x = lexicon.withColumn("word", F.lower("word")).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return with_boundaries(x.select(F.col("language").alias("lang_key"), "word", "morphemes", *[c for c in EXTRA if c in lexicon.columns]))


def with_boundaries(lexicon: DataFrame) -> DataFrame:
    """lexicon with gold, the ends of morphemes inside each word, so that they are found once a row, not once a token sequence."""
    return lexicon.withColumn("gold", boundaries(F.col("morphemes"), F.col("word"), True))


def lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words that the lexicon has, with their morphemes. The join is left to the planner: a lexicon may be large."""
    known = [r[0] for r in lexicon.select("language").distinct().collect()]  # languages, a few
    x = words.withColumn("lang_key", lexicon_key(F.col("language"), known)).where("lang_key is not null").withColumn("__w", F.lower("word"))
    return x.join(best_entries(lexicon).withColumnRenamed("word", "__w"), ["lang_key", "__w"]).drop("__w", "lang_key")


def alignment(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Scores of each distinct word and its tokens, with n occurrences."""

    x = lookup(align_words(tokens), lexicon).withColumn("tokens", cleaned(F.col("tokens"))).where((F.size("tokens") > 0) & (F.size("morphemes") > 0))
    x = x.withColumn("cut", boundaries(F.col("tokens"), F.col("word"), False))  # once a row, not once a score
    made = scores(F.col("word"), F.col("tokens"), F.col("morphemes"), F.col("gold"), F.col("cut"))
    return x.select("tokenizer", "language", "word", "tokens", "morphemes", "n", *[c for c in EXTRA if c in x.columns], *[v.alias(k) for k, v in made.items()])


def by_language(scored: DataFrame) -> DataFrame:
    """metric, count, mean, std (population) by tokenizer and language, over occurrences of words.

    Equal scores are counted first, in tasks, since there are few; spreads are taken around the mean.
    """
    by = ["tokenizer", "language", "metric"]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("x")) for s in SCORES]))
    x = scored.select("tokenizer", "language", "n", rows.alias("r")).select("tokenizer", "language", "n", "r.*").groupBy(*by, "x").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    x = x.withColumn("mean", F.sum(F.col("n") * F.col("x")).over(w) / F.sum("n").over(w))
    spread = F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2) / F.sum("n")
    return x.groupBy(*by).agg(F.sum("n").alias("count"), F.max("mean").alias("mean"), F.sqrt(spread).alias("std"))


def summary(langs: DataFrame, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """By keys: means over languages, their standard errors (0 for one language), languages and words. langs is by_language(), also joined to groups."""
    pick = lambda m: F.when(F.col("metric") == m, F.col("mean"))
    f1, keep = pick("boundary_f1"), pick("morpheme_preservation")
    return langs.groupBy(*keys).agg(
        F.avg(f1).alias("avg_boundary_f1"),
        F.avg(keep).alias("avg_morpheme_preservation"),
        _error(f1).alias("boundary_f1_std_err"),
        _error(keep).alias("morpheme_preservation_std_err"),
        F.countDistinct("language").alias("languages_analyzed"),
        F.sum(F.when(F.col("metric") == "boundary_f1", F.col("count"))).alias("total_words_analyzed"),
    )


def _error(c: Column) -> Column:
    return F.when(F.count(c) > 1, F.stddev_pop(c) / F.sqrt(F.count(c))).otherwise(0.0)


def morph_score(tokens: DataFrame, lexicon: DataFrame, **options: bool) -> DataFrame:
    """The published MorphScore: recall and precision of boundaries at morpheme boundaries by language, over word types.

    Options are those of morph_scores(). There is no code to compare this with.
    """
    return morph_scores(alignment(tokens, lexicon), **options)


def morph_scores(s: DataFrame, *, skip_single: bool = True, freq_scale: bool = False, by_split: bool = False) -> DataFrame:
    """morph_score() of words that are aligned already.

    skip_single leaves out words that are one token or one morpheme; freq_scale weighs a word by the lexicon's freq (null as 1); by_split gives
    rows for each split of the lexicon.
    """
    if skip_single:
        s = s.where((F.size("tokens") > 1) & (F.size("morphemes") > 1))
    weight = F.coalesce(F.col("freq").cast("double"), F.lit(1.0)) if freq_scale else F.lit(1.0)
    gold, cut = (F.size("morphemes") - 1) * weight, (F.size("tokens") - 1) * weight
    mean = lambda c: F.try_divide(F.sum(F.col(c) * weight), F.sum(weight))
    return s.groupBy("tokenizer", "language", *(["split"] if by_split else [])).agg(
        mean("boundary_recall").alias("morphscore_recall"),
        mean("boundary_precision").alias("morphscore_precision"),
        F.try_divide(2 * F.sum(F.col("boundary_recall") * gold), F.sum(gold) + F.sum(cut)).alias("micro_f1"),
        mean("boundary_f1").alias("macro_f1"),
        F.count("*").alias("num_samples"),
    )


MORPH_SCORES = ("morphscore_recall", "morphscore_precision", "micro_f1", "macro_f1")


def morph_summary(scores: DataFrame, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """By keys: of each MorphScore number the mean over languages, its population deviation and standard error; total_samples."""
    each = [c for m in MORPH_SCORES for c in (F.avg(m).alias(f"avg_{m}"), F.stddev_pop(m).alias(f"avg_{m}_std"), (F.stddev_pop(m) / F.sqrt(F.count(m))).alias(f"avg_{m}_std_err"))]
    return scores.groupBy(*keys).agg(F.sum("num_samples").alias("total_samples"), *each)


def inferred_morphemes(base: str, derived: str) -> list[str]:
    """Morphemes of a word derived from base: what is added before or after it, or the shared stem and the rest."""
    b, d = base.lower(), derived.lower()
    if d.startswith(b):
        return [b, d[len(b) :]] if len(d) > len(b) else [b]
    if b.startswith(d):
        return [d]
    if d.endswith(b):
        return [d[: len(d) - len(b)], b]
    n = 0
    while n < min(len(b), len(d)) and b[n] == d[n]:
        n += 1
    if not n:
        return [d]
    rest, tail = d[n:], b[n:]
    if len(d) > len(b) and rest.endswith(tail):
        return [rest[: len(rest) - len(tail)] if tail else "", b] if tail and len(rest) > len(tail) else [b]
    return [b[:n], rest] if rest else [b[:n]]
