"""Corpora, tokenized data, vocabularies and lexicons as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, strip, without_sentence_tags
from ..operators.morphology import inferred_morphemes
from .records import json_records

# Column names that hold text, best first, and file endings.
TEXT_COLUMNS = ("text", "content", "sentence", "document", "passage")
RANK = {"json": 0, "jsonl": 0, "parquet": 1, "txt": 2, "text": 2}
TOKENIZED = T.StructType(
    [
        T.StructField("tokenizer_name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _kept(df: DataFrame, text: Column) -> DataFrame:
    x = df.select(strip(text.cast("string")).alias("text"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("pos"))
    return x.where(F.col("text").isNotNull() & (F.col("text") != ""))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One text a line; blank lines stay as empty texts, which encoding drops."""
    return spark.read.text(path).select(normalize(F.col("value")).alias("text"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("pos"))


def read_json(spark: SparkSession, path: str | list[str], lines: bool | None = None) -> DataFrame:
    """An array of objects with text, one such object, or one object a line; lines that are no JSON are skipped.

    lines None: the first character of the file's first line that is not blank decides.
    """
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    if lines is None:
        head = [r[0].strip() for r in spark.read.text(path).limit(50).collect() if r[0].strip()]
        lines = bool(head) and not head[0].startswith("[") and head[0].startswith("{") and head[0].endswith("}")
    return _kept(spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path), F.col("text"))


def text_column(schema: T.StructType, wanted: str | None = None) -> str:
    names = schema.fieldNames()
    if wanted:
        if wanted not in names:
            raise ValueError(f"no column {wanted!r} among {names}")
        return wanted
    found = next((c for c in TEXT_COLUMNS if c in names), None) or next((f.name for f in schema.fields if isinstance(f.dataType, T.StringType)), None)
    if found is None:
        raise ValueError(f"no text column among {names}")
    return found


def read_parquet(spark: SparkSession, path: str | list[str], column: str | None = None) -> DataFrame:
    """Only the text column is read. Null, blank and `nan` texts go."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    c = F.col(f"`{text_column(df.schema, column)}`")
    return _kept(df.where(c.isNotNull()), c).where("text <> 'nan'")


def _kind(name: str) -> str:
    return name.rpartition(".")[2].lower()


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """By ending; an unknown one is tried as JSON and, without texts, read as text."""
    kind = _kind(path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in ("txt", "text"):
        return read_text(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, True if kind == "jsonl" else None)
    found = read_json(spark, path)
    return found if found.limit(1).count() else read_text(spark, path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder by format and name (any file system Spark reads), the file itself, or nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isFile():
        return [path]
    names = [str(s.getPath().toString()) for s in fs.listStatus(p)]
    if any(n.rpartition("/")[2] == "_SUCCESS" for n in names) and any(_kind(n) == "parquet" for n in names):
        return [path if path.endswith(".parquet") else f"{path}/*.parquet"]
    return sorted((n for n in names if _kind(n) in RANK), key=lambda n: (RANK[_kind(n)], n))


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def parquet_files(spark: SparkSession, files: list[str]) -> list[str]:
    """Files, with those in folders and patterns named one by one, in order of their names."""
    return [f for x in files for f in ([x] if "*" not in x and not _is_folder(spark, x) else sorted(spark.read.parquet(x).inputFiles()))]


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def rows_of(spark: SparkSession, file: str) -> int:
    """Rows of a Parquet file, from its footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


def first_files(spark: SparkSession, files: list[str], most: int) -> list[str]:
    """The first of some Parquet files that hold most texts that are kept, or all. Footers say how many rows
    are worth counting, and only texts of files that are taken are read; as many rows again are added while blank ones are missing."""
    taken, rows, wanted = 0, 0, most
    while taken < len(files):
        while taken < len(files) and rows < wanted:
            rows += rows_of(spark, files[taken])
            taken += 1
        if read_parquet(spark, files[:taken]).limit(most).count() >= most:
            break
        wanted = 2 * max(rows, 1)
    return files[:taken]


def read_language(spark: SparkSession, path: str, language: str, most: int | None = None) -> DataFrame:
    """All texts under path, or the first most by format, file and place. Files of one format are one scan, but for JSON, whose form each file has for itself."""
    scans: list[tuple[int, DataFrame]] = []
    files = listed(spark, path)
    if most is not None and files and all(_kind(f) == "parquet" for f in files):
        files = first_files(spark, parquet_files(spark, files), most)
    for kinds, read in ((("jsonl",), lambda fs: read_json(spark, fs, True)), (("parquet",), lambda fs: read_parquet(spark, fs)), (("txt", "text"), lambda fs: read_text(spark, fs))):
        if mine := [f for f in files if _kind(f) in kinds]:
            scans.append((RANK[kinds[0]], read(mine)))
    scans += [(RANK.get(_kind(f), 0), read_file(spark, f)) for f in files if _kind(f) not in ("jsonl", "parquet", "txt", "text")]
    out = spark.createDataFrame([], "text string, source string, pos long, rank int")
    for rank, x in scans:
        out = out.unionByName(x.withColumn("rank", F.lit(rank)))
    if most is not None:
        out = out.orderBy("rank", "source", "pos").limit(most)
    return out.select(F.lit(language).alias("language"), "text", "source", F.struct("rank", "pos").alias("place"))


def read_corpus(spark: SparkSession, metadata: LanguageMetadata, most: int | None = 100, group: tuple[str, str] | None = None) -> DataFrame:
    """language, doc_id, text, source of all languages that have a path, or of one group's; languages without texts are left out."""
    langs = metadata.group_members(*group) if group else list(metadata.languages)
    out = None
    for code in langs:
        if path := metadata.languages[code].get("data_path"):
            x = read_language(spark, path, code, most)
            out = x if out is None else out.unionByName(x)
    if out is None:
        return spark.createDataFrame([], "language string, doc_id string, text string, source string")
    name = F.substring_index("source", "/", -1)
    return out.select("language", F.concat_ws("-", "language", "place.rank", "place.pos", name).alias("doc_id"), "text", "source")


class LanguageMetadata:
    """Languages (name, iso_code, data_path) and groups of them. A language may also be given as its path alone."""

    def __init__(self, config: dict[str, Any] | str):
        if isinstance(config, str):
            with open(config, encoding="utf-8") as f:
                config = json.load(f)
        self.languages: dict[str, dict[str, Any]] = {c: {"name": c, "iso_code": c, "data_path": v} if isinstance(v, str) else {"name": c, "iso_code": c, "data_path": None} | v for c, v in config.get("languages", {}).items()}
        self.groups: dict[str, dict[str, list[str]]] = config.get("analysis_groups", {})
        wrong = sorted({x for g in self.groups.values() for m in g.values() for x in m} - set(self.languages))
        if wrong:
            raise ValueError(f"groups name unknown languages: {wrong}")

    def group_type(self, name: str) -> str:
        """The name as given, or its plural."""
        for n in (name, name + "s", name[:-1] + "ies" if name.endswith("y") else name):
            if n in self.groups:
                return n
        raise ValueError(f"no groups of type {name!r}; there are {sorted(self.groups)}")

    def group_members(self, kind: str, name: str) -> list[str]:
        return list(self.groups[self.group_type(kind)][name])

    def groups_of(self, language: str, kind: str) -> list[str]:
        return [g for g, m in self.groups[self.group_type(kind)].items() if language in m]

    def statistics(self) -> dict[str, dict[str, int]]:
        return {t: {g: len(m) for g, m in gs.items()} for t, gs in self.groups.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, g, x) for t, gs in self.groups.items() for g, m in gs.items() for x in m]
        return spark.createDataFrame(rows, "group_type string, group_name string, language string")


def read_tokenized(spark: SparkSession, path: str) -> DataFrame:
    """Tokenized records: a JSON array, an object of tokenizer to array, or Parquet of such rows. Ids are places in files."""
    if _kind(path) in ("pkl", "pickle"):
        raise ValueError("pickles are not read, since they can run code; store Parquet instead")
    if _kind(path) == "parquet":
        df = spark.read.parquet(path)
        place = F.concat_ws("-", F.substring_index(F.col("_metadata.file_path"), "/", -1), F.col("_metadata.row_index"))
        df = df.select("*", place.alias("place"))
    elif _kind(path) == "json":
        x = json_records(spark, path).withColumn("r", F.from_json("record", TOKENIZED))
        place = F.concat_ws("-", F.substring_index("file", "/", -1), "block", "i")
        df = x.select("r.*", "key", place.alias("place")).withColumn("tokenizer_name", F.coalesce("key", "tokenizer_name"))
    else:
        raise ValueError(f"no reader of tokenized data for {path!r}")
    return df.select(F.col("tokenizer_name").alias("tokenizer"), "language", F.concat_ws("-", "language", "place").alias("doc_id"), "text", F.col("tokens").cast("array<string>").alias("tokens"), "metadata")


def read_vocabulary(path: str, tokenizer: str) -> dict[str, int]:
    """One token a line, blank lines left out; ids by place. The file is small and read on the driver."""
    with open(path, encoding="utf-8") as f:
        return {t: i for i, t in enumerate(x for x in map(str.strip, f) if x)}


LEXICON = "language string, dataset string, word string, morphemes array<string>"


def _lexicon(df: DataFrame, language: Column | str, dataset: str, word: Column, morphemes: Column) -> DataFrame:
    lang = F.lit(language) if isinstance(language, str) else language
    x = df.select(lang.alias("language"), F.lit(dataset).alias("dataset"), F.lower(word).alias("word"), morphemes.alias("morphemes"))
    return x.where(F.col("word").isNotNull() & (F.size("morphemes") > 0))


def _segments(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), F.trim), lambda x: x != "")


def read_ladec(spark: SparkSession, path: str) -> DataFrame:
    """word TAB a-b-c; lines that begin with # are comments; English."""
    f = F.split("value", "\t")
    x = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#"))).where(F.size(f) >= 2)
    return _lexicon(x, "en", "ladec", f[0], F.split(F.trim(f[1]), "-"))


def read_morpholex(spark: SparkSession, path: str) -> DataFrame:
    """CSV with Word (or word) and MorphoLexSegm (or morphemes), split at dots, pluses and hyphens; English."""
    x = spark.read.option("header", True).csv(path)
    pick = lambda names: next((F.col(f"`{c}`") for c in names if c in x.columns), None)
    word, seg = pick(("Word", "word")), pick(("MorphoLexSegm", "morphemes"))
    if word is None or seg is None:
        raise ValueError(f"columns of a word and its morphemes are missing in {x.columns}")
    return _lexicon(x.where(word.isNotNull() & seg.isNotNull()), "en", "morpholex", word, _segments(seg, r"[.+\-]"))


def read_morphynet(spark: SparkSession, path: str) -> DataFrame:
    """language TAB word TAB base→derived:POS; morphemes follow from base and derived."""

    @F.pandas_udf("array<string>")
    def morphemes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for base, derived in batches:
            yield pd.Series([inferred_morphemes(b, d) for b, d in zip(base, derived, strict=True)])

    f = F.split("value", "\t")
    x = spark.read.text(path).where((F.size(f) >= 3) & F.regexp_like(F.try_element_at(f, F.lit(3)), F.lit("→.*:")))
    base = F.substring_index(f[2], "→", 1)
    derived = F.substring_index(F.substring_index(f[2], "→", -1), ":", 1)
    return _lexicon(x, f[0], "morphynet", f[1], morphemes(base, derived))


def read_dagobert(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of word, morphemes and language, which is German if missing."""
    x = spark.read.schema("word string, morphemes array<string>, language string").option("multiLine", True).json(path)
    return _lexicon(x.where("word is not null and morphemes is not null"), F.coalesce("language", F.lit("de")), "dagobert", F.col("word"), F.col("morphemes"))


def read_morphscore(spark: SparkSession, folder: str, languages: list[str] | None = None) -> DataFrame:
    """A folder of a CSV file (or folder of them) for each language, all in one scan: word, morphemes (split at white space, pluses and hyphens), and freq and split if there are such columns.

    languages: those to read, all by default. The file's name is its language.
    """
    names = [n for n in files_in(spark, folder) if n.endswith(".csv") and (languages is None or n[:-4] in languages)]
    schema = "language string, dataset string, word string, morphemes array<string>, freq double, split string"
    if not names:
        return spark.createDataFrame([], schema)
    x = spark.read.option("header", True).csv([f"{folder.rstrip('/')}/{n}" for n in names])
    if missing := {"word", "morphemes"} - set(x.columns):
        raise ValueError(f"columns {sorted(missing)} are missing in {x.columns}")
    own = lambda c, kind: F.col(c).try_cast(kind) if c in x.columns else F.lit(None).cast(kind)
    language = F.regexp_extract(F.input_file_name(), r"/([^/]+)\.csv(?:/[^/]*)?$", 1)
    x = x.select(language.alias("language"), F.lit("morphscore").alias("dataset"), F.lower("word").alias("word"), _segments(F.col("morphemes"), r"[\s+\-]+").alias("morphemes"), own("freq", "double").alias("freq"), own("split", "string").alias("split"))
    return x.where(F.col("word").isNotNull() & (F.size("morphemes") > 0)).withColumn("dataset_priority", F.lit(0))


LEXICONS = {"ladec": read_ladec, "morpholex": read_morpholex, "morphynet": read_morphynet, "dagobert": read_dagobert}


def read_lexicons(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """All datasets of {name: path}; earlier ones come first on lookup. Of one dataset's entries of a word one stays."""
    out = spark.createDataFrame([], LEXICON + ", dataset_priority int")
    for k, (name, path) in enumerate(config.items()):
        if name not in LEXICONS:
            raise ValueError(f"unknown lexicon {name!r}; there are {sorted(LEXICONS)}")
        x = LEXICONS[name](spark, path).groupBy("language", "dataset", "word").agg(F.max("morphemes").alias("morphemes"))
        out = out.unionByName(x.withColumn("dataset_priority", F.lit(k)))
    return out


def training_set(df: DataFrame, name: str) -> DataFrame:
    """id (name_ and a digest of the text) and text without sentence tags; empty texts go."""
    x = df.select(strip(without_sentence_tags(F.col("text"))).alias("text")).where("text <> ''")
    return x.select(F.concat(F.lit(f"{name}_"), F.substring(F.md5("text"), 1, 16)).alias("id"), "text")


def split(df: DataFrame, share: float = 0.75, seed: int = 23, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a digest of seed and by: the same row is always on the same side."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string"))), 1, 8), 16, 10).cast("bigint")
    low = number < int(share * (1 << 32))
    return df.where(low), df.where(~low)
