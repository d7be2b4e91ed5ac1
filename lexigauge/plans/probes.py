"""Queries that run sources, sinks, tokenizers from files, morphology, validation and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script, text
from ..functions.factor import casing_of_words
from ..functions.measure import Measure, n_units, not_blank
from ..operators import metrics as M
from ..operators import morphology, sketches, training, validate
from ..operators.encode import BEFORE_SPACE, Tokenizer, decoded, encode, spelled, tokenizer, tokenizers_table
from ..operators.facts import Facts, doc_facts
from ..operators.library_facts import numbers
from ..session import kept, scratch
from ..sources import corpus as sources
from ..sources import sinks
from . import report
from .analyzer import Analyzer
from .corpus import document_facts, documents, native_tokenizers
from .store import FactStore, shared_tokens, side_by_side
from .queries import COSTS, GROUP_SQL, GROUPS, LEXICON, LEXICON_SQL, ORACLES, POOLED, PROBS, SPLIT, STATS, STRIP, TOKENS, WORD, _lexicon, query, rounded

LANGS = ("de", "en", "es", "fr")
#: White space runs as one space, none at the ends: a text on one line.
ONE_LINE = "trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g'))"


def _one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "language", text.clean(F.col("text")).alias("text"))


# Sources and sinks


@query(f"SELECT language, text, count(*) AS n FROM (SELECT lang AS language, {ONE_LINE} AS text FROM documents) WHERE text <> '' GROUP BY language, text")
def scan_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines into a folder for each language, scanned by a language configuration."""
    top = scratch(spark, "lines")
    x = _one_line(spark, sf_dir)
    for lang in LANGS:
        x.where(F.col("language") == lang).select("text").write.text(f"{top}/{lang}")
    meta = sources.LanguageMetadata({"languages": {lang: f"{top}/{lang}" for lang in LANGS}})
    return sources.read_corpus(spark, meta, None).where("text <> ''").groupBy("language", "text").agg(F.count("*").alias("n"))


@query(f"SELECT lang AS language, count(*) AS texts, CAST(sum(length({ONE_LINE})) AS BIGINT) AS chars FROM documents WHERE lang IN ('de', 'en') AND {ONE_LINE} <> '' GROUP BY lang")
def scan_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of one group of languages alone."""
    top = scratch(spark, "json")
    x = _one_line(spark, sf_dir)
    for lang in LANGS:
        x.where(F.col("language") == lang).select("text").write.json(f"{top}/{lang}")
    meta = sources.LanguageMetadata({"languages": {lang: {"data_path": f"{top}/{lang}"} for lang in LANGS}, "analysis_groups": {"script_families": {"germanic": ["de", "en"], "romance": ["es", "fr"]}}})
    return sources.read_corpus(spark, meta, None, ("script_family", "germanic")).groupBy("language").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT text, count(*) AS n FROM (SELECT {STRIP('text')} AS text FROM documents) WHERE text <> '' AND text <> 'nan' GROUP BY text")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text column is found by its name; only it is read."""
    return sources.read_file(spark, f"{sf_dir}/documents.parquet").groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT text, count(*) AS n FROM (SELECT {STRIP('text')} AS text FROM conversations) WHERE text <> '' GROUP BY text")
def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scratch(spark, "json")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text").write.json(top)
    return sources.read_json(spark, top).groupBy("text").agg(F.count("*").alias("n"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized records whose ids are the lengths of words, capped at 30."""
    ids = F.transform(F.regexp_extract_all(F.col("text"), F.lit(SPLIT), F.lit(0)), lambda w: F.least(F.length(w), F.lit(30)))
    x = documents(spark, sf_dir).select(F.lit("lengths").alias("tokenizer_name"), "language", ids.alias("tokens"), "text", F.map_from_arrays(F.array(F.lit("source")), F.array("source")).alias("metadata"))
    return x.where(F.size("tokens") > 0)


LENGTHS = f"lengths AS (SELECT lang AS language, doc_id, text, source, list_transform(regexp_extract_all(text, '{SPLIT}'), lambda w: least(length(w), 30)) AS tokens FROM documents)"


@query(f"WITH {LENGTHS} SELECT 'lengths' AS tokenizer, language, source, count(*) AS texts, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(sum(list_sum(tokens)) AS BIGINT) AS ids FROM lengths WHERE len(tokens) > 0 GROUP BY language, source")
def tokenized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized records written as Parquet and read back."""
    path = scratch(spark, "tokenized") + ".parquet"
    sinks.write_records(_lengths(spark, sf_dir), path)
    return _read_records(spark, path)


def _read_records(spark: SparkSession, path: str) -> DataFrame:
    x = sources.read_tokenized(spark, path)
    total = F.aggregate(F.transform("tokens", lambda t: t.cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return x.groupBy("tokenizer", "language", F.col("metadata")["source"].alias("source")).agg(F.count("*").alias("texts"), F.sum(F.size("tokens").cast("bigint")).alias("tokens"), F.sum(total).alias("ids"))


def _write_arrays(rows: DataFrame, path: str, last: str = "null", files: int = 16) -> None:
    """Rows (key, value) as files of one JSON array each, dealt by key; each ends with the element last."""
    parts = rows.sparkSession.range(files).select(F.col("id").alias("part"))
    marks = parts.select("part", F.lit(0).alias("at"), F.lit("[").alias("value")).unionByName(parts.select("part", F.lit(2).alias("at"), F.lit(f"{last}]").alias("value")))
    x = rows.select(F.pmod("key", F.lit(files)).alias("part"), F.lit(1).alias("at"), F.concat("value", F.lit(",")).alias("value")).unionByName(marks)
    x.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").option("lineSep", " ").text(path)


@query(ORACLES["tokenized_records"])
def tokenized_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as 16 files of one JSON array each, read by byte range."""
    path = scratch(spark, "tokenized") + ".json"
    _write_arrays(_lengths(spark, sf_dir).select(F.xxhash64("text").alias("key"), F.to_json(F.struct("tokenizer_name", "language", "tokens", "text", "metadata")).alias("value")), path)
    return _read_records(spark, path)


@query(f"SELECT text FROM (SELECT {STRIP('text')} AS text, doc_id FROM documents) WHERE text <> '' AND text <> 'nan' ORDER BY doc_id LIMIT 100")
def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a cap: the first 100 texts of Parquet files in order, of which only the first are opened."""
    top = scratch(spark, "files")
    documents(spark, sf_dir).repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").select("text").write.parquet(top)
    return sources.read_language(spark, top, "all", 100).select("text")


@query(f"WITH {TOKENS} SELECT tokenizer, language, count(*) AS texts, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM tok WHERE len(tokens) > 0 GROUP BY tokenizer, language")
def tokens_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written as JSON lines, a folder for each tokenizer, and read back."""
    path = scratch(spark, "tokens")
    sinks.write_tokens(encode(documents(spark, sf_dir), native_tokenizers()), path, "json")
    x = spark.read.schema("tokenizer string, language string, tokens array<string>").json(path)
    return x.groupBy("tokenizer", "language").agg(F.count("*").alias("texts"), F.sum(F.size("tokens").cast("bigint")).alias("tokens"))


@query(f"SELECT language, count(*) AS texts FROM (SELECT lang AS language, text FROM documents) JOIN ({GROUP_SQL.partition(' AS (')[2][:-1]}) g(group_type, group_name, language) USING (language) WHERE group_type = 'family' AND group_name = 'romance' GROUP BY language")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a language configuration's groups joined to texts."""
    kinds: dict[str, dict[str, list[str]]] = {}
    for kind, name, lang in GROUPS:
        kinds.setdefault(kind, {}).setdefault(name, []).append(lang)
    meta = sources.LanguageMetadata({"languages": dict.fromkeys(LANGS, ""), "analysis_groups": kinds})
    members = meta.table(spark).where("group_type = 'family' and group_name = 'romance'")
    return documents(spark, sf_dir).join(F.broadcast(members), "language").groupBy("language").agg(F.count("*").alias("texts"))


#: Words of the table as entries of the four lexicon formats, one format a length of the word modulo four; derived words have one of these endings.
LEXICON_WORDS = """x AS (SELECT DISTINCT lang AS language, lower(w) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM documents)),
e AS (SELECT CASE length(word) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en' ELSE language END AS language, ['ladec', 'morpholex', 'morphynet', 'dagobert'][1 + length(word) % 4] AS dataset, word, word[1:3] || '-' || word[4:] AS parts, CAST(length(word) % 4 AS INTEGER) AS priority FROM x)"""


def _lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's words written as files of the four formats, and read by their readers."""
    top = scratch(spark, "lexicons")
    w = documents(spark, sf_dir).select("language", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w")).select("language", F.lower("w").alias("word")).distinct()
    w = w.select("*", F.substring("word", 1, 3).alias("a"), F.substring("word", 4, 1 << 30).alias("b"), (F.length("word") % 4).alias("kind"))
    of = lambda k: w.where(F.col("kind") == k)
    of(0).select(F.concat_ws("", F.initcap("word"), F.lit("\t"), "a", F.lit("-"), "b").alias("value")).write.text(f"{top}/ladec")
    of(1).select(F.initcap("word").alias("Word"), F.concat_ws(".", "a", "b").alias("MorphoLexSegm")).write.option("header", True).csv(f"{top}/morpholex")
    of(2).select(F.concat_ws("", "language", F.lit("\t"), "word", F.lit("\t"), "a", F.lit("→"), "word", F.lit(":N")).alias("value")).write.text(f"{top}/morphynet")
    _write_arrays(of(3).select(F.xxhash64("word").alias("key"), F.to_json(F.struct("word", F.array("a", "b").alias("morphemes"), "language")).alias("value")), f"{top}/dagobert", "{}")
    return sources.read_lexicons(spark, {n: f"{top}/{n}" for n in ("ladec", "morpholex", "morphynet", "dagobert")})


@query(f"WITH {LEXICON_WORDS} SELECT DISTINCT language, dataset, word, parts, priority FROM e")
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lexicon formats, read from files of the table's words."""
    return _lexicons(spark, sf_dir).select("language", "dataset", "word", F.array_join("morphemes", "-").alias("parts"), F.col("dataset_priority").alias("priority"))


CLEAN = STRIP("replace(replace(text, '<s>', ''), '</s>', '')")


@query(f"""WITH x AS (SELECT 'corpus_' || substr(md5(t), 1, 16) AS id, t AS text FROM (SELECT {CLEAN} AS t FROM documents) WHERE t <> '')
SELECT CASE WHEN ('0x' || substr(md5('23:' || id), 1, 8))::BIGINT < {int(0.75 * 2**32)} THEN 'train' ELSE 'test' END AS side, id, text FROM x""")
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set's sides, written as JSON lines and read back."""
    top = scratch(spark, "training")
    train, test = sources.split(sources.training_set(documents(spark, sf_dir), "corpus"))
    sinks.write_training(train, test, top)
    read = lambda side: spark.read.schema("id string, text string").json(f"{top}/{side}").select(F.lit(side).alias("side"), "id", "text")
    return read("train").unionByName(read("test"))


# Text measures and functions


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]'), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS lines, CAST(len(string_split_regex(text, '[.!?]')) AS BIGINT) AS lines_kept_empty,
  CAST(len(list_filter(string_split_regex(text, '[ ,]+'), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS words FROM documents"""
)
def custom_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words by patterns of one's own, from configurations."""
    made = {
        "lines": Measure.from_dict({"method": "lines", "custom_regex": "[.!?]"}),
        "lines_kept_empty": Measure.from_dict({"method": "lines", "custom_regex": "[.!?]", "include_empty_splits": True}),
        "words": Measure.from_dict({"method": "words", "custom_regex": "[ ,]+"}),
    }
    return documents(spark, sf_dir).select("doc_id", *[n_units(F.col("text"), m).alias(n) for n, m in made.items()])


TWO_SCRIPTS = f"CASE WHEN doc_id % 2 = 0 THEN translate(text, '{script.LATIN}', '{script.CYRILLIC}') ELSE text END"


@query(f"SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^а-яА-ЯёЁђЂљЉњЊћЋџЏјЈ]', '', 'g')) > length(regexp_replace(t, '[^a-zA-ZčćđšžČĆĐŠŽ]', '', 'g')) THEN 'cyrillic' ELSE 'latin' END AS script FROM (SELECT doc_id, {TWO_SCRIPTS} AS t FROM documents)")
def script_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text in Cyrillic letters."""
    t = F.when(F.col("doc_id") % 2 == 0, script.to_cyrillic(F.col("text"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", script.dominant_script(t).alias("script"))


OWN_CHARS = """own AS (SELECT list(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(CAST(b AS INTEGER)) ELSE chr(CAST(256 + (SELECT count(*) FROM range(0, b) r(x) WHERE NOT (x BETWEEN 33 AND 126 OR x BETWEEN 161 AND 172 OR x BETWEEN 174 AND 255)) AS INTEGER)) END ORDER BY b) AS shown FROM range(0, 256) t(b))"""
SHOWN = lambda h: f"array_to_string(list_transform(range(0, CAST(length({h}) / 2 AS BIGINT)), lambda i: shown[1 + ('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2))::INTEGER]), '')"


@query(
    f"""WITH b AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '[\\s\\x1c-\\x1f]+'), lambda w: w <> ''), lambda w: hex(encode(w))) AS words FROM documents),
{OWN_CHARS}
SELECT doc_id, array_to_string(list_transform(words, lambda h: {SHOWN('h')}), ' ') AS shown FROM b, own"""
)
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as the printable characters of their bytes, by the registry's name."""
    return documents(spark, sf_dir).select("doc_id", script.PREPROCESS["bytes"](F.col("text")).alias("shown"))


MARKED = r"array_to_string(list_transform(regexp_extract_all(text, '\s?[\p{L}\p{M}\p{Nd}_]+|[\s\S]'), lambda w: CASE WHEN regexp_full_match(w, '\s?\p{Lu}{2,}') THEN '<uppe>' || lower(w) WHEN regexp_full_match(w, '\s?\p{Lu}\p{Ll}+') THEN '<capi>' || lower(w) ELSE w END), '')"


@query(f"SELECT doc_id, marked, replace(replace(marked, '<capi>', ''), '<uppe>', '') AS plain FROM (SELECT doc_id, {MARKED} AS marked FROM documents)")
def casing_marks_there_and_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks before capitalised words, and texts with the marks taken off; the tables hold no Cyrillic letters."""
    m = script.mark_casing(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", m.alias("marked"), script.without_marks(m).alias("plain"))


STRETCH = f"regexp_replace(translate(text, '{script.LATIN}', '{script.CYRILLIC}'), '\\s?\\p{{Cyrillic}}[^\\p{{Latin}}]*', '<csta>\\0<cend>', 'g')"


@query(f"SELECT doc_id, regexp_replace(translate({STRETCH}, '{script.CYRILLIC}', '{script.LATIN}'), '(\\s+)<cend>', '<cend>\\1', 'g') AS marked FROM documents")
def cyrillic_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in Cyrillic letters, but for letters that Serbian lacks, with Cyrillic stretches marked and in Latin letters again."""
    return documents(spark, sf_dir).select("doc_id", script.mark_cyrillic(script.to_cyrillic(F.col("text"))).alias("marked"))


@query(
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{Lu}\p{Ll}]+')) AS word FROM documents),
l AS (SELECT word, length(word) AS n, list_filter(range(0, CAST(length(word) AS BIGINT)), lambda i: regexp_full_match(substr(word, i + 1, 1), '\p{Lu}')) AS up FROM w)
SELECT word, CASE WHEN len(up) = 0 THEN '' WHEN up = [0] THEN '<|CAP|>' WHEN len(up) = n THEN '<|UPPER|>' ELSE '<|CASE|>' || array_to_string(up, ',') END AS mark FROM l"""
)
def word_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casing marks of all distinct words of cased letters."""
    w = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{Lu}\p{Ll}]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", casing_of_words(F.col("word")).alias("mark"))


# Tokenizers from files

def from_files() -> list[Tokenizer]:
    import public_tokenizers as P

    return [
        tokenizer("huggingface", name="byte_bpe", path=P.path("byte_bpe_50k.json"), cut=BEFORE_SPACE, parts=True),
        tokenizer("huggingface", name="word_bpe", path=P.path("word_bpe_49k.json"), parts=True),
        tokenizer("ranked", name="multi", path=P.path("byte_bpe_multi_50k.tiktoken"), pattern=P.PATTERN, parts=True),
        tokenizer("sentencepiece", name="piece_bpe", path=P.path("piece_bpe_32k.model"), parts=True),
    ]


@query(
    f"""WITH {OWN_CHARS}, b AS (SELECT doc_id, text, hex(encode(lower(regexp_replace(nfc_normalize(text), '\\s+', '', 'g')))) AS h FROM documents WHERE regexp_matches(text, '\\S'))
SELECT tokenizer, doc_id, CASE WHEN tokenizer = 'word_bpe' THEN {SHOWN('h')} ELSE text END AS decoded, CASE WHEN tokenizer = 'byte_bpe' THEN true END AS equal FROM b, own, (VALUES ('byte_bpe'), ('word_bpe'), ('multi'), ('piece_bpe')) t(tokenizer)"""
)
def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts by tokenizers of three libraries, decoded (word_bpe: the printable characters of the bytes of all words); equal: another library gives the same ids for the vocabulary."""
    import public_tokenizers as P

    ranks = tokenizer("ranked", name="ranks", path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, parts=True)
    x = decoded(documents(spark, sf_dir).where(not_blank(F.col("text"))), from_files(), {"byte_bpe": ranks})
    bare = F.regexp_replace("decoded", r"</w>|\s+", "")
    return x.select("tokenizer", "doc_id", F.when(F.col("tokenizer") == "word_bpe", bare).otherwise(F.col("decoded")).alias("decoded"), "equal")


@query("SELECT tokenizer, vocab_size, unk_id, count(*) AS texts, true AS inside FROM documents, (VALUES ('byte_bpe', CAST(50257 AS BIGINT), CAST(NULL AS INTEGER)), ('word_bpe', 49408, NULL), ('multi', 50256, NULL), ('piece_bpe', 32000, 0)) t(tokenizer, vocab_size, unk_id) WHERE regexp_matches(text, '\\S') GROUP BY tokenizer, vocab_size, unk_id")
def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary sizes and unknown ids, and whether the ids of all texts are below the size."""
    ts = from_files()
    by = numbers(documents(spark, sf_dir), ts).select(F.explode("by").alias("t")).select("t.*")
    ids = by.groupBy("tokenizer").agg(F.count("*").alias("texts"), F.max("most").alias("most"))
    return ids.join(F.broadcast(tokenizers_table(spark, ts)), "tokenizer").select("tokenizer", "vocab_size", "unk_id", "texts", (F.col("most") < F.col("vocab_size")).alias("inside"))


@query("SELECT tokenizer, doc_id, text AS decoded FROM documents, (VALUES ('byte_bpe'), ('multi'), ('piece_bpe')) t(tokenizer)")
def stored_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding gives the texts back, of the tokenizers that drop nothing."""
    return decoded(documents(spark, sf_dir), [t for t in from_files() if t.name != "word_bpe"]).drop("equal")


@query(f"WITH {OWN_CHARS}, b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents) SELECT doc_id, {SHOWN('h')} AS joined FROM b, own")
def stored_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens of a tokenizer from a file, side by side: the printable characters of the text's bytes."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(from_files()[0].pieces(F.col("text")), "").alias("joined"))


@query(f"SELECT lang AS language, token, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(text, '[aeiou]+|[^aeiou\\s]+')) AS token FROM documents) GROUP BY lang, token")
def pattern_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer of one's own pattern, from a configuration."""
    t = tokenizer("regex", name="vowels", pattern=r"[aeiou]+|[^aeiou\s]+")
    return document_facts(spark, sf_dir, tokenizers=[t]).counts.select("language", "token", "cnt")


# Morphology over distinct words

# How the byte-level tokenizer cuts the words of the small lexicon at a text's start.
BYTE_WORDS = [("nation", "nation"), ("eating", "eating"), ("than", "than"), ("thing", "thing"), ("einheit", "e-in-heit"), ("verkeit", "ver-ke-it"), ("unter", "un-ter"), ("aire", "aire"), ("mention", "ment-ion"), ("mente", "ment-e"), ("estado", "est-ado")]
INNER = lambda x: f"list_transform(range(1, len({x})), lambda i: list_sum(list_transform(list_slice({x}, 1, i), lambda y: length(y))))"
SCORED = f"""{LEXICON_SQL}, byte_words(word, cuts) AS (VALUES {", ".join(map(str, BYTE_WORDS))}),
seen AS (SELECT DISTINCT lang AS language, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents),
pieces AS (SELECT 'char' AS tokenizer, word, regexp_extract_all(word, '.') AS t FROM byte_words UNION ALL SELECT 'byte_bpe', word, string_split(cuts, '-') FROM byte_words),
both_ AS (SELECT tokenizer, language, word, t, string_split(parts, '-') AS m FROM seen JOIN lexicon USING (language, word) JOIN pieces USING (word)),
inner_ AS (SELECT *, {INNER("t")} AS cut, {INNER("m")} AS gold FROM both_),
hits AS (SELECT *, len(list_intersect(cut, gold)) AS hit FROM inner_),
scored AS (SELECT tokenizer, language, word, t, m, cut, gold, hit, CASE WHEN len(cut) > 0 THEN hit / len(cut) ELSE 0.0 END AS p, CASE WHEN len(gold) > 0 THEN hit / len(gold) ELSE 0.0 END AS r,
  len(list_filter(m, lambda x: list_contains(t, x))) / len(m) AS kept, greatest(0, len(t) - len(m)) / len(m) AS over_ FROM hits),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM scored),
rows_ AS (SELECT tokenizer, language, unnest(['boundary_precision', 'boundary_recall', 'boundary_f1', 'morpheme_preservation', 'over_segmentation']) AS metric, unnest([CAST(p AS DOUBLE), r, f1, kept, over_]) AS x FROM f),
langs AS (SELECT tokenizer, language, metric, count(*) AS count, avg(x) AS mean, stddev_pop(x) AS std FROM rows_ GROUP BY ALL)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment scores of all distinct words of the corpus, each as a text, by single characters and by a tokenizer that gives ids."""
    word = F.explode(F.transform(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("text")
    words = documents(spark, sf_dir).select("language", word).distinct().withColumn("doc_id", F.col("text"))
    made = [tokenizer("char"), from_files()[0]]
    return morphology.alignment(spelled(encode(words, made), made), _lexicon(spark))


@query(f"WITH {SCORED} SELECT tokenizer, language, metric, count, round(mean, 6) AS mean, round(std, 6) AS std FROM langs")
def morphology_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(morphology.by_language(_scored(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT tokenizer, language, word, array_to_string(t, '-') AS tokens, array_to_string(m, '-') AS morphemes, round(p, 6) AS boundary_precision, round(r, 6) AS boundary_recall, round(f1, 6) AS boundary_f1 FROM f")
def morphology_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids spelled, cleaned, and put against morphemes, word by word."""
    x = _scored(spark, sf_dir)
    return rounded(x.select("tokenizer", "language", "word", F.array_join("tokens", "-").alias("tokens"), F.array_join("morphemes", "-").alias("morphemes"), "boundary_precision", "boundary_recall", "boundary_f1"))


ERR = lambda m: f"CASE WHEN count(*) FILTER (metric = '{m}') > 1 THEN stddev_pop(mean) FILTER (metric = '{m}') / sqrt(count(*) FILTER (metric = '{m}')) ELSE 0.0 END"


@query(
    f"""WITH {SCORED} SELECT tokenizer, round(avg(mean) FILTER (metric = 'boundary_f1'), 6) AS avg_boundary_f1, round(avg(mean) FILTER (metric = 'morpheme_preservation'), 6) AS avg_morpheme_preservation,
  round({ERR('boundary_f1')}, 6) AS boundary_f1_std_err, round({ERR('morpheme_preservation')}, 6) AS morpheme_preservation_std_err,
  count(DISTINCT language) AS languages_analyzed, CAST(sum(count) FILTER (metric = 'boundary_f1') AS BIGINT) AS total_words_analyzed FROM langs GROUP BY tokenizer"""
)
def morphology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(morphology.summary(morphology.by_language(_scored(spark, sf_dir))))


@query(
    f"""WITH {SCORED} SELECT tokenizer, language, round(avg(r), 6) AS morphscore_recall, round(avg(p), 6) AS morphscore_precision,
  round(2 * sum(hit) / (sum(len(m) - 1) + sum(len(t) - 1)), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1, count(*) AS num_samples FROM f WHERE len(t) > 1 AND len(m) > 1 GROUP BY tokenizer, language"""
)
def morphscore_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(morphology.morph_scores(_scored(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT tokenizer, language || chr(9) || word || chr(9) || array_to_string(t, ' ') || chr(9) || array_to_string(m, ' ') AS line FROM f")
def morphology_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their tokens and morphemes, written as text for each tokenizer and read back."""
    path = scratch(spark, "examples")
    sinks.write_examples(_scored(spark, sf_dir), path)
    return spark.read.schema("value string, tokenizer string").text(path).select("tokenizer", F.col("value").alias("line"))


# Validation, facts without text, unknown tokens, plug-ins


@query(
    f"""WITH {LENGTHS}, r AS (SELECT language NOT IN ('de', 'en', 'es') AS a, len(list_filter(tokens, lambda x: x >= 12)) > 0 AS b, len(tokens) > length(text) AS c, text = '' OR len(tokens) = 0 AS d FROM lengths),
n AS (SELECT count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c, count(*) FILTER (d) AS d FROM r)
SELECT 'lengths' AS tokenizer, severity, rule, n FROM (SELECT 'warning' AS severity, 'unexpected_language' AS rule, a AS n FROM n UNION ALL SELECT 'error', 'id_beyond_vocabulary', b FROM n UNION ALL SELECT 'warning', 'more_tokens_than_characters', c FROM n UNION ALL SELECT 'error', 'no_tokens', d FROM n) WHERE n > 0"""
)
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of tokenized data whose vocabulary is said to have 12 entries."""
    ids = F.transform(F.regexp_extract_all(F.col("text"), F.lit(SPLIT), F.lit(0)), lambda w: F.least(F.length(w), F.lit(30)).cast("string"))
    t = documents(spark, sf_dir).select(F.lit("lengths").alias("tokenizer"), "language", "doc_id", "text", ids.alias("tokens"))
    sizes = spark.createDataFrame([("lengths", 12, None)], "tokenizer string, vocab_size long, unk_id int")
    return validate.violations(t, sizes, ["de", "en", "es"])


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lengths(spark, sf_dir)
    return x.select(F.col("tokenizer_name").alias("tokenizer"), "language", F.monotonically_increasing_id().alias("doc_id"), "text", F.col("tokens").cast("array<string>").alias("tokens"))


@query(f"WITH {LENGTHS} SELECT 'lengths' AS tokenizer, CAST(max(list_max(tokens)) + 1 AS BIGINT) AS vocab_size FROM lengths")
def estimated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.estimated_vocabulary(_ids(spark, sf_dir))


@query(f"WITH {LENGTHS}, r AS (SELECT language, 100.0 * len(list_filter(tokens, lambda k: k = 3)) / len(tokens) AS x FROM lengths WHERE len(tokens) > 0) SELECT 'lengths' AS tokenizer, language, grouping(language) = 1 AS pooled, {STATS} FROM r GROUP BY GROUPING SETS ((language), ())")
def unknown_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent of unknown tokens, here id 3."""
    sizes = spark.createDataFrame([("lengths", 31, 3)], "tokenizer string, vocab_size long, unk_id int")
    return rounded(M.unknown_share(_ids(spark, sf_dir), sizes))


@query(f"WITH {TOKENS}, r AS (SELECT tokenizer, language, n_tokens / CASE WHEN doc_id % 2 = 0 THEN greatest(1, floor(n_tokens * 0.5)) ELSE len(regexp_extract_all(text, '{SPLIT}')) END AS x FROM facts) SELECT tokenizer, language, grouping(language) = 1 AS pooled, {STATS} FROM r GROUP BY GROUPING SETS ((tokenizer, language), (tokenizer))")
def fertility_without_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text is missing beside its tokens: half of them stand for its words."""
    t = encode(documents(spark, sf_dir), native_tokenizers())
    t = t.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("text")))
    m = Measure("words")
    return rounded(M.fertility(Facts(doc_facts(t, m), t, None, m)))


@query(f"WITH {TOKENS} SELECT tokenizer, CAST(max(n_tokens) AS BIGINT) AS longest, CAST(min(n_tokens) AS BIGINT) AS shortest FROM facts GROUP BY tokenizer")
def plugged_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of one's own among the analyzer's."""
    own = lambda f, keys: f.docs.groupBy(*keys).agg(F.max("n_tokens").alias("longest"), F.min("n_tokens").alias("shortest"))
    return Analyzer.of_corpus(documents(spark, sf_dir), native_tokenizers(), plugins={"extremes": own}).frames()["extremes"]


@query(
    f"""WITH {TOKENS}, {LENGTHS}, given AS (SELECT 'lengths' AS tokenizer, language, len(tokens) AS n FROM lengths WHERE len(tokens) > 0 UNION ALL SELECT tokenizer, language, n_tokens FROM facts)
SELECT tokenizer, language, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens FROM given GROUP BY tokenizer, language"""
)
def mixed_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded texts beside records that came tokenized, in one analyzer."""
    f = Analyzer.mixed(documents(spark, sf_dir), native_tokenizers(), _ids(spark, sf_dir)).facts
    return f.docs.groupBy("tokenizer", "language").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))


# Facts that are stored, sketches, checks in passing


def _stored_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return FactStore(spark, scratch(spark, "store"), "probe").save("native", document_facts(spark, sf_dir), 8)


@query(f"""WITH {TOKENS}, r AS (SELECT a.language, a.n_tokens / b.n_tokens AS x FROM facts a JOIN facts b USING (doc_id) WHERE a.tokenizer = 'word_punct' AND b.tokenizer = 'whitespace')
SELECT language, count(*) AS texts, round(avg(x), 6) AS mean_ratio, round(max(x), 6) AS max_ratio FROM r GROUP BY language""")
def stored_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers document by document, from bucketed facts."""
    x = side_by_side(_stored_facts(spark, sf_dir), "word_punct", "whitespace").withColumn("x", F.col("first") / F.col("second"))
    return rounded(x.groupBy("language").agg(F.count("*").alias("texts"), F.avg("x").alias("mean_ratio"), F.max("x").alias("max_ratio")))


@query(f"""WITH {TOKENS}, t AS (SELECT tokenizer, token, sum(cnt) AS n FROM counts GROUP BY ALL)
SELECT a.token, CAST(a.n AS BIGINT) AS first, CAST(b.n AS BIGINT) AS second FROM t a JOIN t b USING (token) WHERE a.tokenizer = 'word_punct' AND b.tokenizer = 'whitespace'""")
def stored_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that two tokenizers share, from bucketed counts."""
    return shared_tokens(_stored_facts(spark, sf_dir), "word_punct", "whitespace")


@query(f"WITH {TOKENS}, {POOLED} SELECT tokenizer, language, pooled, CAST(sum(cnt) AS BIGINT) AS tokens, true AS within FROM pool GROUP BY tokenizer, language, pooled")
def sketched_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from sketches that roll up over languages; within: no further from the exact number than four times the stated error."""
    t = encode(documents(spark, sf_dir), native_tokenizers())
    x = sketches.rolled_up(kept(sketches.type_sketches(t), "sketches"))
    exact = M.type_token_ratio(document_facts(spark, sf_dir)).select(F.col("tokenizer").alias("t"), F.col("language").alias("l"), F.col("pooled").alias("p"), F.col("types").alias("exact"))
    x = x.join(exact, F.col("tokenizer").eqNullSafe(F.col("t")) & F.col("language").eqNullSafe(F.col("l")) & (F.col("pooled") == F.col("p")))
    near = F.abs(F.col("types") - F.col("exact")) <= 4 * sketches.relative_error() * F.col("exact") + 1
    return x.select("tokenizer", "language", "pooled", "tokens", near.alias("within"))


# Vocabularies

BASE = f"base AS (SELECT token, row_number() OVER (ORDER BY sum(cnt) DESC, token) - 1 AS id FROM counts WHERE tokenizer = 'word_punct' GROUP BY token QUALIFY id < 300)"


@query(
    f"""WITH {TOKENS}, {BASE}, new AS (SELECT word AS token, row_number() OVER (ORDER BY c DESC, word) - 1 AS k FROM (SELECT word, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word) QUALIFY k < 1000),
fresh AS (SELECT token, 200 + row_number() OVER (ORDER BY k) - 1 AS id FROM new WHERE token NOT IN (SELECT token FROM base WHERE id < 200))
SELECT token, id FROM (SELECT token, id FROM base WHERE id < 200 UNION ALL SELECT token, id FROM fresh) WHERE id < 500"""
)
def vocabulary_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of 300 entries and then the most frequent words that are new, up to 500; sizes are the feature."""
    c = document_facts(spark, sf_dir, tokenizers=[tokenizer("word_punct")]).counts
    base = {r["token"]: i for i, r in enumerate(training.top(c.groupBy("token").agg(F.sum("cnt").alias("cnt")), 300, "token").collect())}
    found = [r["word"] for r in training.top(training.word_counts(documents(spark, sf_dir)), 1000, "word").collect()]
    made = training.extended_vocabulary(base, found, 500, 200)
    return spark.createDataFrame(list(made.items()), "token string, id long")


@query(
    f"""WITH {TOKENS}, o AS (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, token) AS i FROM (SELECT token, sum(cnt) AS cnt FROM counts WHERE tokenizer = 'word_punct' GROUP BY token)),
c AS (SELECT cutoff, cnt, cnt / sum(cnt) OVER (PARTITION BY cutoff) AS p FROM o, (VALUES (50), (100), (400)) t(cutoff) WHERE i <= cutoff)
SELECT cutoff, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS types, round(1 + sum(p * log2(p)) / log2(count(*)), 6) AS redundancy FROM c GROUP BY cutoff"""
)
def cutoff_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and redundancy of the most frequent tokens at some cutoffs."""
    c = document_facts(spark, sf_dir, tokenizers=[tokenizer("word_punct")]).counts
    return rounded(training.cutoff_sweep(c.groupBy("token").agg(F.sum("cnt").alias("cnt")), [50, 100, 400]))


@query("SELECT token, CAST(sum(len(w) * 0 + 1) AS BIGINT) AS cnt FROM (SELECT w, unnest(regexp_extract_all(w, '.')) AS token FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '') GROUP BY token")
def character_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of distinct words, weighted by the words' counts."""
    words = training.word_counts(documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))))
    return training.token_frequency(words, tokenizer("char").encode(F.col("word")))


# Reports


def _results(spark: SparkSession, sf_dir: str, **kw) -> dict:
    a = Analyzer.of_corpus(documents(spark, sf_dir), native_tokenizers(), **kw)
    out = a.results()
    a.close()
    return out


CELL = lambda v, form, best: f"CASE WHEN row_number() OVER (ORDER BY {v} {best}, tokenizer) = 1 THEN '\\textbf{{' || printf('{form}', {v}) || '}}' ELSE printf('{form}', {v}) END"


@query(
    f"""WITH {TOKENS}, {PROBS}, {COSTS}, ttr AS (SELECT tokenizer, count(*) / sum(cnt) AS ttr, -sum(p * log2(p)) AS h FROM p WHERE pooled GROUP BY tokenizer),
d AS (SELECT a.tokenizer, sum(abs(a.cost - b.cost)) / (2 * count(DISTINCT a.language) * sum(a.cost)) * count(DISTINCT a.language) AS g FROM costs a JOIN costs b USING (tokenizer) GROUP BY a.tokenizer),
g AS (SELECT tokenizer, sum(abs(x.cost - y.cost)) / (2 * 16 * avg(x.cost)) AS g FROM costs x JOIN costs y USING (tokenizer) GROUP BY tokenizer),
body AS (SELECT replace(tokenizer, '_', '\\_') || ' & ' || {CELL('ttr', '%.4f', 'DESC')} || ' & ' || {CELL('h', '%.2f', 'DESC')} || ' & ' || {CELL('g', '%.3f', 'ASC')} || ' \\\\' AS line, 4 + row_number() OVER (ORDER BY tokenizer DESC) AS i FROM ttr JOIN g USING (tokenizer))
SELECT CAST(i AS BIGINT) AS i, line FROM (VALUES (0, '% Requires \\usepackage{{makecell}} in preamble'), (1, '\\begin{{tabular}}{{lccc}}'), (2, '\\toprule'), (3, 'Tokenizer & \\makecell{{Type-Token \\\\ Ratio}} & \\makecell{{Rényi Entropy \\\\ ($\\alpha$=1)}} & \\makecell{{Gini \\\\ Coefficient}} \\\\'), (4, '\\midrule'), (7, '\\bottomrule'), (8, '\\end{{tabular}}')) t(i, line) UNION ALL SELECT i, line FROM body"""
)
def latex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of three columns, line by line; the best cells are bold."""
    x = report.table(_results(spark, sf_dir), ["word_punct", "whitespace"], ["type_token_ratio", "renyi_1.0", "tokenizer_fairness_gini"], errors=False)
    return spark.createDataFrame(list(enumerate(x.split("\n"))), "i long, line string")


@query(
    f"""WITH {TOKENS}, {POOLED}, t AS (SELECT tokenizer, count(*) AS types, sum(cnt) AS tokens FROM pool WHERE pooled GROUP BY tokenizer)
SELECT tokenizer, name, round(value, 6) AS value FROM (SELECT tokenizer, 'global_types' AS name, CAST(types AS DOUBLE) AS value FROM t UNION ALL SELECT tokenizer, 'global_tokens', tokens FROM t UNION ALL SELECT tokenizer, 'global_ttr', types / tokens FROM t)"""
)
def results_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested results as JSON text, read again by Spark."""
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # a report is written by the driver, for people
        report.write_json(_results(spark, sf_dir), f"{d}/results.json")
        with open(f"{d}/results.json", encoding="utf-8") as f:
            raw = f.read()
    got = spark.createDataFrame([(raw,)], "value string").select(F.from_json("value", "type_token_ratio struct<per_tokenizer map<string, map<string, double>>>").alias("r"))
    x = got.select(F.explode("r.type_token_ratio.per_tokenizer").alias("tokenizer", "values")).select("tokenizer", F.explode("values").alias("name", "value"))
    return rounded(x)


@query(
    f"""WITH {TOKENS}, v AS (SELECT tokenizer, 'fertility' AS name, avg(n_tokens / n_bytes) AS value, stddev_samp(n_tokens / n_bytes) / sqrt(count(*)) AS error FROM facts GROUP BY tokenizer UNION ALL
SELECT tokenizer, 'token_length', avg(n_chars / n_tokens), stddev_samp(n_chars / n_tokens) / sqrt(count(*)) FROM facts GROUP BY tokenizer)
SELECT name, tokenizer, round(value, 6) AS value, round(error, 6) AS error, round(avg(value) OVER (PARTITION BY name), 6) AS mean FROM v"""
)
def plotted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two of the figures show, with errors and the line of the mean."""
    bars = report.plot_data(_results(spark, sf_dir), ["whitespace", "word_punct"])["bars"]
    rows = [(n, b["tokenizer"], b["value"], b["error"], bars[n]["mean"]) for n in ("fertility", "token_length") for b in bars[n]["bars"]]
    return rounded(spark.createDataFrame(rows, "name string, tokenizer string, value double, error double, mean double"))


@query(f"WITH {TOKENS} SELECT 'fertility' AS name, language, tokenizer, round(avg(n_tokens / n_bytes), 6) AS value FROM facts GROUP BY language, tokenizer")
def plotted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the figure of fertility by language shows."""
    by = report.plot_data(_results(spark, sf_dir), ["whitespace", "word_punct"])["by_language"]
    rows = [("fertility", lang, t, v) for lang, x in by["fertility"].items() for t, v in x.items()]
    return rounded(spark.createDataFrame(rows, "name string, language string, tokenizer string, value double"))


@query(f"WITH {TOKENS}, {GROUP_SQL} SELECT group_type, group_name, tokenizer, round(avg(n_tokens / n_bytes), 6) AS value FROM facts JOIN groups USING (language) GROUP BY group_type, group_name, tokenizer")
def plotted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the figures of groups of languages show."""
    groups = spark.createDataFrame(GROUPS, "group_type string, group_name string, language string")
    got = report.plot_data(_results(spark, sf_dir, groups=groups), ["whitespace", "word_punct"])["grouped"]
    rows = [(k, g, b["tokenizer"], b["value"]) for k, gs in got.items() for g, x in gs.items() for b in x["fertility"]["bars"]]
    return rounded(spark.createDataFrame(rows, "group_type string, group_name string, tokenizer string, value double"))


@query(f"SELECT doc_id, part FROM (SELECT doc_id, {STRIP('p')} AS part FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p FROM documents WHERE contains(text, chr(10)))) WHERE length(part) >= 5")
def blank_line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of texts whose lines are set apart by blank ones."""
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.explode(text.paragraphs(t)).alias("part"))


__all__ = ["from_files", "WORD"]
