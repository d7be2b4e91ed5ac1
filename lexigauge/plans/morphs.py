"""Queries of morphology over running texts, each beside its SQL. Lexicons are made from the words of the documents table, so they grow with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import morphology
from ..operators.encode import Tokenizer, encode, tokenizer
from ..operators.facts import with_groups
from ..session import scratch
from ..sources import corpus as sources
from .corpus import documents
from .queries import GROUP_SQL, GROUPS, MARKS, query, rounded

#: Up to three letters with the space before them, or one other character.
BITS = r" ?[\p{L}\p{M}]{1,3}|[^\s\p{L}\p{M}]"


def _bits() -> Tokenizer:
    return tokenizer("regex", name="bits", pattern=BITS)


# Tokens numbered by the groups that begin at a space, groups of punctuation put to the one before, groups and words paired in order.
WORDS = rf"""tk AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{BITS}') AS t FROM documents)),
ga AS (SELECT *, sum(CASE WHEN i = 1 OR token[1] = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tk),
gb AS (SELECT doc_id, g, string_agg(CASE WHEN i = lo THEN substr(token, 2) ELSE token END, '' ORDER BY i) AS shown FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, g) AS lo FROM ga) GROUP BY doc_id, g),
gc AS (SELECT doc_id, g, sum(CASE WHEN g = 1 OR trim(shown, '{MARKS}') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) AS k FROM gb),
ws AS (SELECT doc_id, language, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n FROM (SELECT doc_id, lang AS language, list_transform(regexp_extract_all(lower(text), '[^\s\x1c-\x1f]+'), lambda x: trim(x, '{MARKS}')) AS w FROM documents)),
wt AS (SELECT ws.language, ws.word, list(token ORDER BY i) AS t FROM ga JOIN gc USING (doc_id, g) JOIN (SELECT DISTINCT doc_id, n FROM ws) USING (doc_id) JOIN ws ON ws.doc_id = ga.doc_id AND ws.k = least(gc.k, ws.n) GROUP BY ga.doc_id, ws.k, ws.language, ws.word),
al AS (SELECT language, word, t, count(*) AS n FROM wt WHERE length(word) >= 2 GROUP BY ALL)"""


@query(f"WITH {WORDS} SELECT 'bits' AS tokenizer, language, word, array_to_string(t, '|') AS tokens, n FROM al")
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole running texts with their tokens."""
    x = morphology.align_words(encode(documents(spark, sf_dir), [_bits()]))
    return x.select("tokenizer", "language", "word", F.array_join("tokens", "|").alias("tokens"), "n")


# A word of four letters or more has, by its length, two morphemes, three of which the middle one is not in it, or two that are not.
LEX = """lx AS (SELECT DISTINCT lang AS language, lower(w) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents)),
lex AS (SELECT language, word, CASE length(word) % 3 WHEN 0 THEN [word[1:2], word[3:]] WHEN 1 THEN [word[1:3], '0', word[-1:]] ELSE ['0', '1'] END AS m FROM lx)"""


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = documents(spark, sf_dir).select("language", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w")).select("language", F.lower("w").alias("word")).distinct()
    n, word = F.length("word"), F.col("word")
    two = F.array(F.substring(word, 1, 2), F.substring(word, 3, 1 << 30))
    three = F.array(F.substring(word, 1, 3), F.lit("0"), F.substring(word, -1, 1))
    m = F.when(n % 3 == 0, two).when(n % 3 == 1, three).otherwise(F.array(F.lit("0"), F.lit("1")))
    return w.select("language", F.lit("derived").alias("dataset"), "word", m.alias("morphemes"), F.lit(0).alias("dataset_priority"))


# Ends of parts in a word: side by side, as found from left to right by recursion over parts, or evenly.
SPANS = """both_ AS (SELECT language, word, list_filter(list_transform(t, lambda x: CASE WHEN x[1] = ' ' THEN x[2:] ELSE x END), lambda x: x <> '') AS t, m, n FROM al JOIN lex USING (language, word)),
todo AS (SELECT DISTINCT word, parts, skip FROM (SELECT word, t AS parts, false AS skip FROM both_ UNION ALL SELECT word, m, true FROM both_)),
fold AS (
  SELECT word, parts, skip, 0 AS i, 0 AS pos, CAST([] AS BIGINT[]) AS ends, true AS sound FROM todo
  UNION ALL SELECT word, parts, skip, i + 1, CASE WHEN past OR p = '' OR e IS NULL THEN pos ELSE e END, CASE WHEN past OR p = '' OR e IS NULL THEN ends ELSE list_append(ends, e) END, sound AND (past OR p <> '')
  FROM (SELECT *, NOT skip AND pos >= length(word) AS past, CASE WHEN instr(word[pos + 1:], p) > 0 THEN pos + instr(word[pos + 1:], p) - 1 + length(p) WHEN NOT skip THEN least(length(word), pos + length(p)) END AS e
    FROM (SELECT *, lower(parts[i + 1]) AS p FROM fold WHERE i < len(parts)))),
ends_ AS (SELECT word, parts, skip, CASE WHEN lower(array_to_string(parts, '')) = word THEN 1 WHEN sound AND len(ends) > 0 THEN 2 ELSE 3 END AS way, list_distinct(list_filter(CASE
    WHEN lower(array_to_string(parts, '')) = word THEN list_transform(range(1, len(parts) + 1), lambda i: CAST(length(array_to_string(parts[1:i], '')) AS BIGINT))
    WHEN sound AND len(ends) > 0 THEN ends
    ELSE list_transform(range(1, len(parts) + 1), lambda i: CAST(floor(i * length(word) / len(parts)) AS BIGINT)) END, lambda e: e <> length(word))) AS cut FROM fold WHERE i = len(parts)),
hit AS (SELECT b.*, x.cut, g.cut AS gold, x.way AS cut_way, g.way AS gold_way, len(list_intersect(x.cut, g.cut)) AS hit FROM both_ b JOIN ends_ x ON x.word = b.word AND x.parts = b.t AND NOT x.skip JOIN ends_ g ON g.word = b.word AND g.parts = b.m AND g.skip),
pr AS (SELECT *, coalesce(hit / nullif(len(cut), 0), 0.0) AS p, coalesce(hit / nullif(len(gold), 0), 0.0) AS r, len(list_filter(m, lambda x: list_contains(t, x))) / len(m) AS kept, greatest(0, len(t) - len(m)) / len(m) AS over_ FROM hit),
sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr),
mx AS (SELECT language, n, unnest(['boundary_precision', 'boundary_recall', 'boundary_f1', 'morpheme_preservation', 'over_segmentation']) AS metric, unnest([CAST(p AS DOUBLE), r, f1, kept, over_]) AS x FROM sc),
lm AS (SELECT *, sum(n * x) OVER w / sum(n) OVER w AS mean FROM mx WINDOW w AS (PARTITION BY language, metric)),
langs AS (SELECT language, metric, CAST(sum(n) AS BIGINT) AS count, max(mean) AS mean, sqrt(sum(n * (x - mean) ** 2) / sum(n)) AS std FROM lm GROUP BY language, metric)"""
SCORED = f"WITH RECURSIVE {WORDS}, {LEX}, {SPANS}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.alignment(encode(documents(spark, sf_dir), [_bits()]), _derived(spark, sf_dir))


@query(f"{SCORED} SELECT language, word, array_to_string(t, '|') AS tokens, array_to_string(m, '|') AS morphemes, CAST(sum(n) AS BIGINT) AS n, round(p, 6) AS boundary_precision, round(r, 6) AS boundary_recall, round(f1, 6) AS boundary_f1, round(kept, 6) AS morpheme_preservation, round(over_, 6) AS over_segmentation FROM sc GROUP BY ALL")
def text_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary scores of words in running texts: parts that spell the word, that are found in it, and that are not."""
    x = _scored(spark, sf_dir).withColumn("tokens", F.array_join("tokens", "|")).withColumn("morphemes", F.array_join("morphemes", "|"))
    return rounded(x.groupBy("language", "word", "tokens", "morphemes", *morphology.SCORES).agg(F.sum("n").alias("n")))


@query(f"{SCORED} SELECT 'bits' AS tokenizer, language, metric, count, round(mean, 6) AS mean, round(std, 6) AS std FROM langs")
def text_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(morphology.by_language(_scored(spark, sf_dir)))


PICK = lambda m: f"FILTER (metric = '{m}')"
ERR = lambda m: f"round(CASE WHEN count(*) {PICK(m)} > 1 THEN stddev_pop(mean) {PICK(m)} / sqrt(count(*) {PICK(m)}) ELSE 0.0 END, 6)"


@query(
    f"""{SCORED}, {GROUP_SQL} SELECT 'bits' AS tokenizer, group_type, group_name, round(avg(mean) {PICK('boundary_f1')}, 6) AS avg_boundary_f1, round(avg(mean) {PICK('morpheme_preservation')}, 6) AS avg_morpheme_preservation,
  {ERR('boundary_f1')} AS boundary_f1_std_err, {ERR('morpheme_preservation')} AS morpheme_preservation_std_err, count(DISTINCT language) AS languages_analyzed, CAST(sum(count) {PICK('boundary_f1')} AS BIGINT) AS total_words_analyzed
FROM langs JOIN groups USING (language) GROUP BY group_type, group_name"""
)
def grouped_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two types of groups at once: rows of languages join their groups, words are scored once."""
    groups = spark.createDataFrame(GROUPS, "group_type string, group_name string, language string")
    langs = with_groups(morphology.by_language(_scored(spark, sf_dir)), groups)
    return rounded(morphology.summary(langs, ("tokenizer", "group_type", "group_name")))


@query(
    """WITH x AS (SELECT lang AS language, lower(w) AS word, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents) GROUP BY ALL),
s AS (SELECT language, word, freq, CASE WHEN length(word) % 2 = 0 THEN 'train' ELSE 'test' END AS split, CAST(ceil(length(word) / 3) AS BIGINT) - 1 AS cuts, CAST(word[1] IN ('a', 'e', 'i', 'o', 'u') AS INT) AS hit FROM x),
r AS (SELECT *, hit / cuts AS p, CAST(hit AS DOUBLE) AS r, 2.0 * hit / (cuts + 1) AS f FROM s)
SELECT 'bits' AS tokenizer, language, split, round(sum(freq * r) / sum(freq), 6) AS morphscore_recall, round(sum(freq * p) / sum(freq), 6) AS morphscore_precision,
  round(2 * sum(freq * hit) / (sum(freq) + sum(freq * cuts)), 6) AS micro_f1, round(sum(freq * f) / sum(freq), 6) AS macro_f1, count(*) AS num_samples FROM r GROUP BY language, split"""
)
def morphscore_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each language, with how often a word occurs and its part of the data, read back and scored by part with weights.

    Words have two morphemes, the first of three letters if it begins with a vowel, else of two, so that tokens of three letters hit some.
    """
    w = documents(spark, sf_dir).select("language", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    x = w.groupBy("language", F.lower("w").alias("word")).agg(F.count("*").alias("freq"))
    parts = F.regexp_replace("word", "^([aeiou]..|[^aeiou].)(.*)$", "$1-$2")
    x = x.select("language", "word", parts.alias("morphemes"), "freq", F.when(F.length("word") % 2 == 0, "train").otherwise("test").alias("split"))
    top = scratch(spark, "morphscore")
    for lang in [r[0] for r in x.select("language").distinct().collect()]:  # languages, a few
        x.where(F.col("language") == lang).drop("language").write.option("header", True).csv(f"{top}/{lang}.csv")
    lexicon = sources.read_morphscore(spark, top)
    texts = lexicon.select("language", F.col("word").alias("doc_id"), F.col("word").alias("text"))
    return rounded(morphology.morph_score(encode(texts, [_bits()]), lexicon, freq_scale=True, by_split=True))
