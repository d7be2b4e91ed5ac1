"""Queries over the shared tables, each beside the SQL that gives the same rows.

Computed fractions are rounded to six places on both sides, so that summing in another
order does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script, text
from ..functions.measure import PRESETS, Measure, n_units
from ..operators import metrics as M
from ..operators import morphology, training, validate
from ..operators.encode import BEFORE_SPACE, encode, tokenizer
from ..operators.facts import Facts, facts, with_groups
from ..operators.pieces import encoded_characters, facts_by_pieces
from ..operators.vocab import numbered
from .analyzer import name_conflicts
from .corpus import capped, document_facts, documents, native_tokenizers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD, SPLIT = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+", r"\S+"
TOKENS = f"""tok AS (
  SELECT 'word_punct' AS tokenizer, lang AS language, source, doc_id, text, regexp_extract_all(text, '{WORD}') AS tokens FROM documents
  UNION ALL SELECT 'whitespace', lang, source, doc_id, text, regexp_extract_all(text, '{SPLIT}') FROM documents),
facts AS (
  SELECT *, CAST(len(tokens) AS DOUBLE) AS n_tokens, CAST(strlen(text) AS DOUBLE) AS n_bytes, CAST(length(text) AS DOUBLE) AS n_chars,
    CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines FROM tok WHERE len(tokens) > 0),
counts AS (SELECT tokenizer, language, token, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT tokenizer, language, unnest(tokens) AS token FROM tok) GROUP BY ALL)"""
STATS = """round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(stddev_samp(x) / sqrt(count(x)), 6) AS std_err,
  round(min(x), 6) AS min, round(max(x), 6) AS max, CAST(count(x) AS BIGINT) AS count, round(sum(x), 6) AS sum"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stats_sql(x: str, by: str, where: str = "true", more: str = "") -> str:
    return f"WITH {TOKENS}, r AS (SELECT *, {x} AS x FROM facts WHERE {where}) SELECT tokenizer, language, grouping(language) = 1 AS pooled, {STATS}{more} FROM r GROUP BY {by}"


SETS = "GROUPING SETS ((tokenizer, language), (tokenizer))"


@query(stats_sql("n_tokens / n_bytes", SETS))
def fertility_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(document_facts(spark, sf_dir)))


@query(stats_sql("n_tokens / n_chars", SETS))
def fertility_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(document_facts(spark, sf_dir, PRESETS["characters"])))


@query(stats_sql("n_tokens / n_lines", SETS))
def fertility_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(document_facts(spark, sf_dir, PRESETS["newlines"])))


@query(stats_sql(f"n_tokens / len(regexp_extract_all(text, '{SPLIT}'))", SETS))
def fertility_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(document_facts(spark, sf_dir, PRESETS["words"])))


@query(stats_sql(f"n_tokens / (strlen(regexp_replace(text, '\\s+', '', 'g')) + len(regexp_extract_all(text, '{WORD}')))", SETS))
def fertility_bytes_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(document_facts(spark, sf_dir, PRESETS["bytes_hf"])))


@query(f"WITH {TOKENS}, r AS (SELECT *, n_chars / n_tokens AS x FROM facts) SELECT tokenizer, {STATS} FROM r GROUP BY tokenizer")
def token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.token_length(document_facts(spark, sf_dir)))


@query(f"WITH {TOKENS}, r AS (SELECT *, n_tokens / n_lines AS x FROM facts) SELECT tokenizer, {STATS}, CAST(sum(n_lines) AS BIGINT) AS total_lines FROM r GROUP BY tokenizer")
def tokens_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.tokens_per_line(document_facts(spark, sf_dir)))


@query(stats_sql("n_bytes / n_tokens", SETS))
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.compression(document_facts(spark, sf_dir)))


POOLED = "pool AS (SELECT tokenizer, language, false AS pooled, token, cnt FROM counts UNION ALL SELECT tokenizer, NULL, true, token, CAST(sum(cnt) AS BIGINT) FROM counts GROUP BY tokenizer, token)"


@query(f"WITH {TOKENS}, {POOLED} SELECT tokenizer, language, pooled, count(*) AS types, CAST(sum(cnt) AS BIGINT) AS tokens, round(count(*) / sum(cnt), 6) AS ttr FROM pool GROUP BY tokenizer, language, pooled")
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.type_token_ratio(document_facts(spark, sf_dir)))


@query(f"WITH {TOKENS}, {POOLED} SELECT tokenizer, language, pooled, count(*) AS used_tokens, CAST(200000 AS BIGINT) AS vocab_size, 200000 - count(*) AS unused_tokens, round(count(*) / 200000, 6) AS utilization FROM pool GROUP BY tokenizer, language, pooled")
def vocabulary_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_facts(spark, sf_dir)
    sizes = spark.createDataFrame([(t.name, 200_000) for t in native_tokenizers()], "tokenizer string, vocab_size long")
    return rounded(M.vocabulary_utilization(type(f)(f.docs, f.counts, sizes)))


@query(f"WITH {TOKENS} SELECT tokenizer, language, token, cnt FROM counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_facts(spark, sf_dir).counts


@query(f"WITH {TOKENS} SELECT token, cnt FROM (SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts WHERE tokenizer = 'word_punct' GROUP BY token) ORDER BY cnt DESC, token LIMIT 100")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_facts(spark, sf_dir, tokenizers=[tokenizer("word_punct")]).counts
    return c.groupBy("token").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(100)


PROBS = f"{POOLED}, p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY tokenizer, language, pooled) AS p FROM pool)"


@query(
    f"""WITH {TOKENS}, {PROBS}, e AS (SELECT tokenizer, language, pooled, -sum(p * log2(p)) AS e1, log2(sum(p ** 2)) / -1 AS e2, log2(sum(p ** 2.5)) / -1.5 AS e25, log2(sum(p ** 3)) / -2 AS e3 FROM p GROUP BY tokenizer, language, pooled)
SELECT tokenizer, language, pooled, CAST(unnest([1, 2, 2.5, 3]) AS DOUBLE) AS alpha, round(unnest([e1, e2, e25, e3]), 6) AS entropy FROM e"""
)
def renyi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.renyi(document_facts(spark, sf_dir)))


@query(
    f"""WITH {TOKENS}, {PROBS}, k AS (SELECT *, row_number() OVER (PARTITION BY tokenizer, language, pooled ORDER BY cnt DESC, token) AS rank FROM p)
SELECT tokenizer, language, pooled, round(-sum(p * log2(p)), 6) AS unigram_entropy, round(sum(cnt * rank) / sum(cnt), 6) AS avg_token_rank, CAST(sum(cnt) AS BIGINT) AS total_tokens, count(*) AS unique_tokens FROM k GROUP BY tokenizer, language, pooled"""
)
def unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.unigram(document_facts(spark, sf_dir)))


@query(f"WITH {TOKENS} SELECT tokenizer, language, token, cnt FROM counts")
def dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts with each distinct piece encoded once."""
    return facts_by_pieces(documents(spark, sf_dir), native_tokenizers()).counts


@query(stats_sql("n_tokens / n_bytes", SETS))
def dictionary_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility with the texts' lengths from their pieces."""
    return rounded(M.fertility(facts_by_pieces(documents(spark, sf_dir), native_tokenizers())))


@query(
    """WITH p AS (SELECT unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS piece FROM documents), d AS (SELECT piece, count(*) AS n FROM p GROUP BY piece)
SELECT unnest(['whitespace', 'word_punct']) AS tokenizer, CAST(sum(n * length(piece)) AS BIGINT) AS in_texts, CAST(sum(length(piece)) AS BIGINT) AS in_pieces, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS pieces FROM d"""
)
def dictionary_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that are encoded text by text, and by the dictionary."""
    return encoded_characters(documents(spark, sf_dir), native_tokenizers())


#: The corpus with one language taken from its texts.
UNTOLD = TOKENS.replace("lang AS language", "nullif(lang, 'fr') AS language").replace("'whitespace', lang,", "'whitespace', nullif(lang, 'fr'),")


def _untold(spark: SparkSession, sf_dir: str) -> Facts:
    ts = native_tokenizers()
    x = documents(spark, sf_dir).withColumn("language", F.nullif("language", F.lit("fr")))
    sizes = spark.createDataFrame([(t.name, 200_000) for t in ts], "tokenizer string, vocab_size long")
    return facts(encode(x, ts), sizes)


@query(
    f"""WITH {UNTOLD}, {PROBS}, k AS (SELECT *, row_number() OVER (PARTITION BY tokenizer, language, pooled ORDER BY cnt DESC, token) AS rank FROM p)
SELECT tokenizer, language, pooled, count(*) AS types, CAST(sum(cnt) AS BIGINT) AS tokens, round(count(*) / 200000, 6) AS utilization, round(-sum(p * log2(p)), 6) AS unigram_entropy, round(sum(cnt * rank) / sum(cnt), 6) AS avg_token_rank, round(log2(sum(p ** 2)) / -1, 6) AS renyi_2
FROM k GROUP BY tokenizer, language, pooled"""
)
def untold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of counts where texts have no language: these texts have rows of their own beside those over all."""
    f, by = _untold(spark, sf_dir), ["tokenizer", "language", "pooled"]
    x = M.type_token_ratio(f).select(*by, "types", "tokens")
    more = [M.vocabulary_utilization(f).select(*by, "utilization"), M.unigram(f).select(*by, "unigram_entropy", "avg_token_rank"), M.renyi(f, (2.0,)).select(*by, F.col("entropy").alias("renyi_2"))]
    for m in more:
        m = m.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in m.columns if c not in by])
        x = x.join(m, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])
    return rounded(x)


@query(f"WITH {UNTOLD}, r AS (SELECT *, n_tokens / n_bytes AS x FROM facts) SELECT tokenizer, language, grouping(language) = 1 AS pooled, {STATS} FROM r GROUP BY {SETS}")
def untold_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fertility(_untold(spark, sf_dir)))


COSTS = "costs AS (SELECT tokenizer, language, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_bytes) AS BIGINT) AS units, sum(n_tokens) / sum(n_bytes) AS cost FROM facts GROUP BY tokenizer, language)"


@query(f"WITH {TOKENS}, {COSTS} SELECT tokenizer, language, tokens, units, round(cost, 6) AS cost FROM costs")
def language_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.language_costs(document_facts(spark, sf_dir)))


@query(
    f"""WITH {TOKENS}, {COSTS}, s AS (SELECT tokenizer, avg(cost) AS m, stddev_pop(cost) AS sd, min(cost) AS lo, max(cost) AS hi, count(*) AS n, arg_min(language, cost) AS best, arg_max(language, cost) AS worst FROM costs GROUP BY tokenizer),
d AS (SELECT a.tokenizer, sum(abs(a.cost - b.cost)) AS d FROM costs a JOIN costs b USING (tokenizer) GROUP BY a.tokenizer)
SELECT tokenizer, round(d / (2 * n * n * m), 6) AS gini_coefficient, round(m, 6) AS mean_cost, round(sd, 6) AS std_cost, round(lo, 6) AS min_cost, round(hi, 6) AS max_cost, round(hi / lo, 6) AS cost_ratio,
  best AS most_efficient_language, worst AS least_efficient_language, n AS num_languages FROM s JOIN d USING (tokenizer)"""
)
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gini(document_facts(spark, sf_dir)))


@query(
    f"""WITH {TOKENS}, {COSTS}, o AS (SELECT tokenizer, row_number() OVER w AS i, count(*) OVER (PARTITION BY tokenizer) AS n, sum(cost) OVER w AS s, sum(cost) OVER (PARTITION BY tokenizer) AS t, language FROM costs WINDOW w AS (PARTITION BY tokenizer ORDER BY cost, language))
SELECT tokenizer, i, round(i / n, 6) AS x, round(s / t, 6) AS y, language FROM o UNION ALL SELECT DISTINCT tokenizer, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, NULL FROM o"""
)
def lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.lorenz(document_facts(spark, sf_dir)))


def pair_sql(values: str) -> str:
    return f"""WITH {TOKENS}, {PROBS}, v AS ({values})
SELECT a.tokenizer AS tokenizer_1, b.tokenizer AS tokenizer_2, round(a.v, 6) AS value_1, round(b.v, 6) AS value_2, round(a.v - b.v, 6) AS difference, round(a.v / b.v, 6) AS ratio, round(abs(a.v - b.v) / ((a.v + b.v) / 2) * 100, 6) AS percent_difference
FROM v a JOIN v b ON a.tokenizer < b.tokenizer"""


def _pairs(df: DataFrame, value: str) -> DataFrame:
    x = M.pairwise(df.where("pooled").select("tokenizer", value), value)
    return rounded(x.select("tokenizer_1", "tokenizer_2", "value_1", "value_2", "difference", "ratio", "percent_difference"))


@query(pair_sql("SELECT tokenizer, avg(n_tokens / n_bytes) AS v FROM facts GROUP BY tokenizer"))
def pairwise_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(M.fertility(document_facts(spark, sf_dir)), "mean")


@query(pair_sql("SELECT tokenizer, avg(n_bytes / n_tokens) AS v FROM facts GROUP BY tokenizer"))
def pairwise_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(M.compression(document_facts(spark, sf_dir)), "mean")


@query(pair_sql("SELECT tokenizer, -sum(p * log2(p)) AS v FROM p WHERE pooled GROUP BY tokenizer"))
def pairwise_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(M.unigram(document_facts(spark, sf_dir)), "unigram_entropy")


GROUPS = [("family", "germanic", "de"), ("family", "germanic", "en"), ("family", "romance", "es"), ("family", "romance", "fr"), ("resource", "high", "en"), ("resource", "high", "de"), ("resource", "mid", "es"), ("resource", "mid", "fr"), ("resource", "mid", "de")]
GROUP_SQL = "groups(group_type, group_name, language) AS (VALUES " + ", ".join(map(str, GROUPS)) + ")"
GROUP_KEYS = ("tokenizer", "group_type", "group_name")


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "group_type string, group_name string, language string")


@query(f"WITH {TOKENS}, {GROUP_SQL}, r AS (SELECT *, n_tokens / n_bytes AS x FROM facts JOIN groups USING (language)) SELECT tokenizer, group_type, group_name, language, grouping(language) = 1 AS pooled, {STATS} FROM r GROUP BY GROUPING SETS ((tokenizer, group_type, group_name, language), (tokenizer, group_type, group_name))")
def grouped_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_facts(spark, sf_dir)
    return rounded(M.fertility(type(f)(with_groups(f.docs, _groups(spark)), f.counts), GROUP_KEYS))


@query(
    f"""WITH {TOKENS}, {GROUP_SQL}, {COSTS}, c AS (SELECT * FROM costs JOIN groups USING (language)),
s AS (SELECT tokenizer, group_type, group_name, avg(cost) AS m, count(*) AS n FROM c GROUP BY ALL),
d AS (SELECT a.tokenizer, a.group_type, a.group_name, sum(abs(a.cost - b.cost)) AS d FROM c a JOIN c b USING (tokenizer, group_type, group_name) GROUP BY ALL)
SELECT tokenizer, group_type, group_name, round(d / (2 * n * n * m), 6) AS gini_coefficient, n AS num_languages FROM s JOIN d USING (tokenizer, group_type, group_name)"""
)
def grouped_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_facts(spark, sf_dir)
    return rounded(M.gini(type(f)(with_groups(f.docs, _groups(spark)), f.counts), GROUP_KEYS).select(*GROUP_KEYS, "gini_coefficient", "num_languages"))


@query("SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 50")
def corpus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a cap: the first 50 texts of each language."""
    return capped(documents(spark, sf_dir), 50, ["doc_id"]).select("doc_id", "language")


@query(f"SELECT tokenizer FROM (VALUES ('word_punct'), ('whitespace')) t(tokenizer) INTERSECT SELECT * FROM (VALUES ('word_punct'), ('other')) t(tokenizer)")
def conflict_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that encoded and given tokens have both."""
    given = documents(spark, sf_dir).select(F.explode(F.array(F.lit("word_punct"), F.lit("other"))).alias("tokenizer"))
    return spark.createDataFrame([(x,) for x in name_conflicts(native_tokenizers(), given)], "tokenizer string")


@query("WITH want(language) AS (VALUES ('de'), ('en'), ('sr')) SELECT 'whitespace' AS tokenizer, language, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT lang FROM documents) UNION ALL SELECT 'whitespace', lang, 'unexpected' FROM (SELECT lang FROM documents EXCEPT SELECT * FROM want)")
def missing_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame([("whitespace", x) for x in ("de", "en", "sr")], "tokenizer string, language string")
    return validate.coverage(encode(documents(spark, sf_dir), [tokenizer("whitespace")]), want).select("tokenizer", "language", "problem")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


@query(
    f"""WITH {TOKENS}, t AS (SELECT tokenizer, language, len(tokens) AS n FROM tok WHERE len(tokens) > 0)
SELECT tokenizer, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT language) AS languages, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, 1.0::DOUBLE AS text_share FROM t GROUP BY tokenizer"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.statistics(encode(documents(spark, sf_dir), native_tokenizers()))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


def parts_sql(parts: str) -> str:
    return f"SELECT doc_id, part FROM (SELECT doc_id, {STRIP('p')} AS part FROM (SELECT doc_id, unnest({parts}) AS p FROM documents)) WHERE length(part) >= 5"


@query(parts_sql("CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE [] END"))
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(text.lines(F.col("text"))).alias("part"))


@query(parts_sql("CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) ELSE [] END"))
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(text.paragraphs(F.col("text"))).alias("part"))


@query(parts_sql("string_split_regex(text, '[.!?]+\\s+')"))
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(text.sentences(F.col("text"))).alias("part"))


@query(
    f"""WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 500), 1) AS BIGINT))) AS i FROM documents),
s AS (SELECT doc_id, i, CASE WHEN length(text) <= 500 THEN text ELSE {STRIP("substr(text, i * 500 + 1, 500)")} END AS part FROM c)
SELECT doc_id, part FROM s WHERE part <> ''"""
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(text.chunks(F.col("text"), most=None)).alias("part"))


@query(f"SELECT doc_id, {STRIP('''replace(replace(regexp_replace(text, ' +', ' ', 'g'), chr(10) || ' ', chr(10)), ' ' || chr(10), chr(10))''')} AS normal FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query(
    f"""SELECT doc_id, CAST(1 AS BIGINT) AS lines, CAST(len(string_split(text, chr(10))) AS BIGINT) AS newlines, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS characters,
  CAST(len(regexp_extract_all(text, '{SPLIT}')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS words_hf, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words_regex,
  CAST(len(string_split(text, ' ')) AS BIGINT) AS words_kept_empty FROM documents"""
)
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lines", "newlines", "bytes", "characters", "words", "words_hf", "words_regex")
    return documents(spark, sf_dir).select("doc_id", *[n_units(F.col("text"), PRESETS[n]).alias(n) for n in names], n_units(F.col("text"), Measure("words", include_empty=True)).alias("words_kept_empty"))


TRANSLIT = "text"
for _two, _one in (("lj", "љ"), ("nj", "њ"), ("dž", "џ")):
    for _a, _b in ((_two, _one), (_two.capitalize(), _one.upper()), (_two.upper(), _one.upper())):
        TRANSLIT = f"replace({TRANSLIT}, '{_a}', '{_b}')"
BACK = "text"
for _two in ("LJ", "NJ", "DŽ"):
    BACK = f"replace({BACK}, '{_two}', '{_two.capitalize()}')"


@query(f"SELECT doc_id, translate(text, '{script.LATIN}', '{script.CYRILLIC}') AS cyrillic FROM documents")
def translit_to_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", script.to_cyrillic(F.col("text")).alias("cyrillic"))


@query(f"SELECT doc_id, translate({TRANSLIT}, '{script.LATIN}', '{script.CYRILLIC}') AS cyrillic, {BACK} AS latin FROM documents")
def translit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To Cyrillic with digraphs as one letter and back; digraphs in capitals come back with one capital."""
    c = script.to_cyrillic(F.col("text"), digraphs=True)
    return documents(spark, sf_dir).select("doc_id", c.alias("cyrillic"), script.to_latin(c).alias("latin"))


@query(f"WITH {TOKENS}, v AS (SELECT tokenizer, token, CAST(row_number() OVER (PARTITION BY tokenizer ORDER BY sum(cnt) DESC, token) - 1 AS BIGINT) AS token_id FROM counts GROUP BY tokenizer, token) SELECT c.tokenizer, c.language, v.token_id, c.cnt FROM counts c JOIN v USING (tokenizer, token)")
def vocab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by frequency joined to counts."""
    c = document_facts(spark, sf_dir).counts
    return c.join(numbered(c), ["tokenizer", "token"]).select("tokenizer", "language", "token_id", "cnt")


@query(f"WITH {TOKENS}, {POOLED}, p AS (SELECT tokenizer, cnt / sum(cnt) OVER (PARTITION BY tokenizer) AS p FROM pool WHERE pooled) SELECT tokenizer, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS types, round(1 + sum(p * log2(p)) / log2(count(*)), 6) AS redundancy FROM p GROUP BY tokenizer")
def entropy_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.redundancy(document_facts(spark, sf_dir)))


# A small lexicon for the joins below.
LEXICON = [("en", "nation", "na-tion"), ("en", "eating", "eat-ing"), ("en", "than", "than"), ("en", "thing", "th-ing"), ("de", "einheit", "ein-heit"), ("de", "verkeit", "ver-keit"), ("de", "unter", "unter"), ("fr", "aire", "aire"), ("fr", "mention", "men-tion"), ("es", "mente", "mente"), ("es", "estado", "est-ado")]
LEXICON_SQL = "lexicon(language, word, parts) AS (VALUES " + ", ".join(map(str, LEXICON)) + ")"
MARKS = ".,!?;:\"()[]{}"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, "small", w, p.split("-"), 0) for a, w, p in LEXICON], "language string, dataset string, word string, morphemes array<string>, dataset_priority int")


@query(
    f"""WITH {LEXICON_SQL}, w AS (SELECT language, trim(lower(unnest(tokens)), '{MARKS}') AS word FROM (SELECT lang AS language, regexp_extract_all(text, '{SPLIT}') AS tokens FROM documents))
SELECT w.language, w.word, count(*) AS n, CAST(len(string_split(parts, '-')) AS BIGINT) AS morphemes FROM w JOIN lexicon USING (language, word) GROUP BY w.language, w.word, parts"""
)
def word_morpheme_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted before they meet the lexicon."""
    word = F.regexp_replace(F.lower(F.col("t")), r"^[.,!?;:\"()\[\]{}]+|[.,!?;:\"()\[\]{}]+$", "")
    t = encode(documents(spark, sf_dir), [tokenizer("whitespace")]).select("language", F.explode("tokens").alias("t")).select("language", word.alias("word"))
    x = morphology.lookup(t.groupBy("language", "word").agg(F.count("*").alias("n")), _lexicon(spark))
    return x.select("language", "word", "n", F.size("morphemes").cast("bigint").alias("morphemes"))


@query()
def morphological_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by tokenizer and language: alignment is no SQL; it is tested on written cases."""
    return rounded(morphology.by_language(morphology.alignment(encode(documents(spark, sf_dir), [tokenizer("char"), tokenizer("whitespace")]), _lexicon(spark))))


@query(
    f"""WITH {TOKENS}, r AS (SELECT unnest(string_split(array_to_string(list_transform(tokens, lambda t: CASE WHEN length(t) = 1 THEN t ELSE chr(1) END), ''), chr(1))) AS seq FROM tok WHERE tokenizer = 'word_punct')
SELECT seq, count(*) AS cnt FROM r WHERE length(seq) > 1 GROUP BY seq"""
)
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = encode(documents(spark, sf_dir), [tokenizer("word_punct")]).withColumn("cnt", F.lit(1).cast("bigint"))
    return training.run_counts(t, F.col("tokens"))


@query(f"SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY cnt DESC, word LIMIT 1000")
def training_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a top-k: the 1000 most frequent words."""
    return training.top(training.word_counts(documents(spark, sf_dir)), 1000, "word")


def _stored() -> list:
    import public_tokenizers as P

    return [tokenizer("huggingface", name="byte_bpe", path=P.path("byte_bpe_50k.json"), cut=BEFORE_SPACE, parts=True), tokenizer("sentencepiece", name="piece_bpe", path=P.path("piece_bpe_32k.model"), parts=True)]


@query()
def stored_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizers from files: no SQL has them; tests compare ids with the libraries."""
    return rounded(M.fertility(document_facts(spark, sf_dir, tokenizers=_stored())))


@query()
def stored_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.vocabulary_utilization(document_facts(spark, sf_dir, tokenizers=_stored())))


@query()
def factored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casing and script marks: a text function in Python, tested on written cases."""
    from ..functions.factor import factored

    return documents(spark, sf_dir).select("doc_id", factored(F.col("text"), True)["text"].alias("factored"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
