"""Tokenizers as Columns, and the encode operator.

A tokenizer turns a text column into a column of tokens: native ones by regular
expression, stored ones (tokenizers JSON, SentencePiece, ranks) by Arrow UDFs that load
the file once a worker, where its path must be readable.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import SPACE, WORD_PUNCT, not_blank
from ..functions.script import PREPROCESS
from .parts import AT_ONCE, SHOWN, Encoder, encoded, portions


@dataclass(frozen=True)
class Tokenizer:
    """name, tokens(text column), vocabulary (token to id; None if open), unknown id, preprocessor name.

    spell gives the strings of a list of ids; tokenizers without it have strings as tokens. cut is a pattern
    to split texts by into pieces whose tokens, one after the other, are the text's; None if there is none.
    """

    name: str
    tokens: Callable[[Column], Column]
    vocab: dict[str, int] | None = field(default=None, compare=False, repr=False)
    unk_id: int | None = None
    preprocess: str | None = None
    decode: Callable[[Column], Column] | None = None
    pieces: Callable[[Column], Column] | None = None
    spell: Callable[[list[int]], list[str]] | None = field(default=None, compare=False, repr=False)
    cut: str | None = None
    #: Of stored tokenizers: texts to lists of ids, and back, in a worker.
    ids: Callable[[list[str]], list] | None = field(default=None, compare=False, repr=False)
    back: Callable[[list], list[str]] | None = field(default=None, compare=False, repr=False)
    #: Of those whose texts fall into parts (see parts.py): parts to lists of ids.
    parts: Encoder | None = field(default=None, compare=False, repr=False)

    @property
    def vocab_size(self) -> int | None:
        return len(self.vocab) if self.vocab is not None else None

    def encode(self, text: Column) -> Column:
        return self.tokens(PREPROCESS[self.preprocess](text) if self.preprocess else text)


#: ASCII white space, which no token of the native tokenizers but char holds, and the place before white space behind a character of another kind.
GAPS, BEFORE_GAPS = r"[ \t\n\x0B\f\r]+", r"(?<=[^ \t\n\x0B\f\r])(?=[ \t\n\x0B\f\r])"


def _pattern(name: str, pattern: str, cut: str = GAPS) -> Callable[..., Tokenizer]:
    """A native tokenizer; a pattern of one's own has pieces only where its cut is given too."""

    def make(config: dict[str, Any] | None = None) -> Tokenizer:
        c = config or {}
        f = lambda t: F.regexp_extract_all(t, F.lit(c.get("pattern", pattern)), F.lit(0))
        return Tokenizer(c.get("name", name), f, preprocess=c.get("preprocess"), pieces=f, cut=c.get("cut", None if "pattern" in c else cut))

    return make


@lru_cache(maxsize=8)
def _hf(path: str):
    # a task has one core: threads of its own would only hold more memory
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@lru_cache(maxsize=8)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=8)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _arrow(f: Callable[[list[str]], list], kind: str) -> Callable[[Column], Column]:
    """A function over lists of texts (or id lists) as an Arrow UDF; nulls stay null. Ids are held as arrays, four bytes each."""
    held = (lambda x: np.array(x, np.int32)) if kind == "array<int>" else (lambda x: x)

    @F.pandas_udf(kind)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            items = s.tolist()
            made = (held(x) for few in portions(items) for x in f(few))
            yield pd.Series([None if x is None else next(made) for x in items], index=s.index, dtype=object)

    return udf


#: Pieces of texts that a worker keeps with their ids, for each tokenizer: about 35 MB.
KEEP = 200_000
#: A cut for tokenizers whose pre-tokens begin at a space: before each space behind a letter of Latin script or an ASCII character that shows.
BEFORE_SPACE = rf"(?<=[{SHOWN}])(?= )"


@lru_cache(maxsize=8)
def _known(path: str, special: bool, cut: str) -> dict[str, bytes]:
    return {}


def by_pieces(encode: Callable[[list[str]], list], cut: str, known: dict[str, bytes]) -> Callable[[list[str]], list]:
    """encode for texts that can be cut: a piece is encoded once while it is among the known ones."""
    split = re.compile(cut).split

    def run(texts: list[str]) -> list[np.ndarray]:
        each = [split(t) for t in texts]
        if len(known) > KEEP:
            known.clear()
        new = list({p for ps in each for p in ps if p not in known})
        known.update((p, np.array(x, np.int32).tobytes()) for p, x in zip(new, encode(new), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, ps)), np.int32) for ps in each]

    return run


def _plain(ids: Any) -> list[int]:
    return ids if isinstance(ids, list) else [int(i) for i in ids]


@dataclass(frozen=True)
class ByLibrary:
    """Ids of parts by a tokenizers JSON file: those of texts."""

    path: str

    def __call__(self, parts: list[str], begins: list[bool]) -> list:
        return [e.ids for e in _hf(self.path).encode_batch_fast(parts, add_special_tokens=False)]


@dataclass(frozen=True)
class ByRanks:
    path: str
    pattern: str

    def __call__(self, parts: list[str], begins: list[bool]) -> list:
        return list(map(_ranks(self.path, self.pattern).encode_ordinary, parts))


@dataclass(frozen=True)
class BySentencePiece:
    """The model puts a space before what it gets: the part's own, or one that is none of its."""

    path: str

    def __call__(self, parts: list[str], begins: list[bool]) -> list:
        sp = _pieces(self.path)
        found = sp.encode([x[1:] if x[0] == " " and not b else x for x, b in zip(parts, begins, strict=True)], num_threads=1)
        space = sp.piece_to_id("▁")
        # before a line's end that space is a token of its own; a space alone is no text to the model
        return [ids if b else [space] if x == " " else ids[1:] if x[0] == "\n" else ids for x, b, ids in zip(parts, begins, found, strict=True)]


def _falls_apart(sp: Any) -> bool:
    """Whether no piece goes on behind a space or holds a line's end, and texts are taken as they are, behind one space."""
    probe = "a  b \nc "
    held = not any(re.search("[^▁]▁|\n", sp.id_to_piece(i)) for i in range(sp.vocab_size()))
    return held and sp.is_byte(sp.piece_to_id("<0x0A>")) and sp.encode("\na")[:2] == [sp.piece_to_id(p) for p in ("▁", "<0x0A>")] and sp.decode(sp.encode(probe)) == probe


def _named(token: str | None, i: int) -> str:
    return token if token is not None else f"<UNK_{i}>"


def huggingface(config: dict[str, Any]) -> Tokenizer:
    """A tokenizers JSON file at path; special tokens that its post-processor adds are counted (special=False leaves them out).

    parts=True: its tokens end before a space or a line's end behind a character that shows (see parts.py).
    """
    path, special = config["path"], config.get("special", True)
    tok = _hf(path)
    cut = config.get("cut")

    def encode(texts: list[str]) -> list:
        whole = lambda xs: [e.ids for e in _hf(path).encode_batch_fast(xs, add_special_tokens=special)]
        # other cuts are Spark's patterns, which Python's may not read
        return (by_pieces(whole, cut, _known(path, special, cut)) if cut == BEFORE_SPACE else whole)(texts)

    decode = lambda ids: _hf(path).decode_batch(list(map(_plain, ids)), skip_special_tokens=False)

    def pieces(texts: list[str]) -> list[list[str]]:
        p = _hf(path).pre_tokenizer
        return [[x for x, _ in p.pre_tokenize_str(t)] if p else [t] for t in texts]

    if config.get("parts") and special and tok.encode("").ids:
        raise ValueError(f"{path} adds tokens to every text, so its parts do not make one up")
    vocab = tok.get_vocab()
    unk = next((vocab[u] for u in (config.get("unk"), getattr(tok.model, "unk_token", None), "<unk>", "[UNK]", "<UNK>") if u and u in vocab), None)
    return Tokenizer(config.get("name", "huggingface"), _arrow(encode, "array<int>"), vocab, unk, config.get("preprocess"), _arrow(decode, "string"), _arrow(pieces, "array<string>"), lambda ids: [_named(_hf(path).id_to_token(i), i) for i in ids], cut, encode, decode, ByLibrary(path) if config.get("parts") else None)


def sentencepiece(config: dict[str, Any]) -> Tokenizer:
    """A SentencePiece model at path; bos and eos add their ids. parts=True: texts are encoded by parts (see parts.py), if the model allows it."""
    path, bos, eos = config["path"], config.get("bos", False), config.get("eos", False)
    sp = _pieces(path)
    encode = lambda texts: _pieces(path).encode(texts, add_bos=bos, add_eos=eos, num_threads=1)
    decode = lambda ids: [_pieces(path).decode(_plain(x)) for x in ids]

    def pieces(texts: list[str]) -> list[list[str]]:
        out = []
        for ps in _pieces(path).encode(texts, out_type=str, num_threads=1):
            words: list[str] = []
            for p in ps:
                if p.startswith("▁") or not words:
                    words.append(p)
                else:
                    words[-1] += p
            out.append(words)
        return out

    if config.get("parts") and (bos or eos or not _falls_apart(sp)):
        raise ValueError(f"texts by {path} do not fall into parts")
    vocab = {sp.id_to_piece(i): i for i in range(sp.vocab_size())}
    return Tokenizer(config.get("name", "sentencepiece"), _arrow(encode, "array<int>"), vocab, sp.unk_id() if sp.unk_id() >= 0 else None, config.get("preprocess"), _arrow(decode, "string"), _arrow(pieces, "array<string>"), lambda ids: _pieces(path).id_to_piece(ids), ids=encode, back=decode, parts=BySentencePiece(path) if config.get("parts") else None)


def ranked(config: dict[str, Any]) -> Tokenizer:
    """Byte-level BPE from a ranks file and its pattern; parts as for huggingface."""
    path, pattern = config["path"], config["pattern"]
    enc = _ranks(path, pattern)
    encode = lambda texts: [_ranks(path, pattern).encode_ordinary(t) for t in texts]
    decode = lambda ids: [_ranks(path, pattern).decode(_plain(x)) for x in ids]
    vocab = {token.decode("latin-1"): i for token, i in enc._mergeable_ranks.items()} if config.get("vocab", True) else None
    spell = lambda ids: [_ranks(path, pattern).decode_single_token_bytes(i).decode("utf-8", "replace") for i in ids]
    return Tokenizer(config.get("name", "ranked"), _arrow(encode, "array<int>"), vocab, None, config.get("preprocess"), _arrow(decode, "string"), spell=spell, ids=encode, back=decode, parts=ByRanks(path, pattern) if config.get("parts") else None)


def bpe_files(config: dict[str, Any]) -> Tokenizer:
    """vocab.json and merges.txt, with <s> and </s> around each text, which count as tokens."""
    vocab_file, merges_file = config["vocab"], config["merges"]

    @lru_cache(maxsize=2)
    def build(vocab_path: str, merges_path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers import models, pre_tokenizers, processors

        t = Library(models.BPE.from_file(vocab_path, merges_path))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(use_regex=False)])
        v = t.get_vocab()
        if "<s>" in v and "</s>" in v:
            t.post_processor = processors.TemplateProcessing(single="<s> $A </s>", special_tokens=[("<s>", v["<s>"]), ("</s>", v["</s>"])])
        return t

    encode = lambda texts: [e.ids for e in build(vocab_file, merges_file).encode_batch(texts)]
    with open(vocab_file, encoding="utf-8") as f:
        vocab = json.load(f)
    spell = lambda ids: [_named(build(vocab_file, merges_file).id_to_token(i), i) for i in ids]
    return Tokenizer(config.get("name", "bpe_files"), _arrow(encode, "array<int>"), vocab, vocab.get("<unk>"), config.get("preprocess"), spell=spell, ids=encode)


def by_language(config: dict[str, Any]) -> Tokenizer:
    """Several unigram SentencePiece models of one vocabulary: each text gets the ids of the model that scores it best, the first on ties."""
    paths = list(config["paths"])

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            scored = []
            for k, p in enumerate(paths):
                sp = _pieces(p)
                ids = sp.encode(t)
                scored.append((sum(sp.get_score(i) for i in ids), -k, ids))
            out.append(max(scored, key=lambda x: x[:2])[2])
        return out

    first = _pieces(paths[0])
    vocab = {first.id_to_piece(i): i for i in range(first.vocab_size())}
    for p in paths[1:]:
        other = _pieces(p)
        if [other.id_to_piece(i) for i in range(other.vocab_size())] != [first.id_to_piece(i) for i in range(first.vocab_size())]:
            raise ValueError(f"{p} has another vocabulary than {paths[0]}")
    return Tokenizer(config.get("name", "by_language"), _arrow(encode, "array<int>"), vocab, first.unk_id(), config.get("preprocess"), spell=lambda ids: _pieces(paths[0]).id_to_piece(ids), ids=encode)


def pretokenized(config: dict[str, Any]) -> Tokenizer:
    """A vocabulary alone: its rows come with tokens (ids, if a vocabulary is given) and it encodes nothing."""

    def refuse(_: Column) -> Column:
        raise NotImplementedError(f"{config.get('name')} has tokens already")

    vocab = config.get("vocab")
    names = {i: t for t, i in vocab.items()} if vocab else {}
    return Tokenizer(config["name"], refuse, vocab, config.get("unk_id"), spell=(lambda ids: [_named(names.get(i), i) for i in ids]) if vocab else None)


REGISTRY: dict[str, Callable[[dict[str, Any]], Tokenizer]] = {
    "whitespace": _pattern("whitespace", rf"(?U)[^{SPACE}]+"),
    "word_punct": _pattern("word_punct", r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"),
    "hf_whitespace": _pattern("hf_whitespace", WORD_PUNCT),
    "char": _pattern("char", r"(?s).", BEFORE_GAPS),
    "regex": _pattern("regex", r"\S+"),
    "huggingface": huggingface,
    "sentencepiece": sentencepiece,
    "ranked": ranked,
    "bpe_files": bpe_files,
    "by_language": by_language,
    "pretokenized": pretokenized,
}


def register_tokenizer(name: str, factory: Callable[[dict[str, Any]], Tokenizer]) -> None:
    if not callable(factory):
        raise TypeError("a tokenizer is registered by a function of its configuration")
    REGISTRY[name] = factory


def tokenizer(kind: str = "huggingface", **config: Any) -> Tokenizer:
    if kind not in REGISTRY:
        raise ValueError(f"unknown tokenizer {kind!r}; there are {sorted(REGISTRY)}")
    config.setdefault("name", kind)
    return REGISTRY[kind](config)


def from_config(config: dict[str, Any]) -> tuple[list[Tokenizer], list[str]]:
    """Tokenizers of {name: {class, ...}}, and the names under plot_tokenizers (all by default)."""
    config = dict(config)
    shown = config.pop("plot_tokenizers", None)
    made = [tokenizer(c.get("class", "huggingface"), **{k: v for k, v in c.items() if k != "class"} | {"name": n}) for n, c in config.items()]
    names = [t.name for t in made]
    if shown and (wrong := set(shown) - set(names)):
        raise ValueError(f"plot_tokenizers names unknown tokenizers: {sorted(wrong)}")
    return made, list(shown or names)


TOKEN_COLUMNS = ["tokenizer", "language", "doc_id", "text", "tokens"]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 * AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of a string column, a row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = (np.flatnonzero(np.diff((np.cumsum(n) - n) // size)) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(i, j - i)


def _by_library(src: DataFrame, tokenizers: list[Tokenizer]) -> DataFrame:
    """tokenizer, language, doc_id, text, ids of texts that are not null: one Python worker a task has all tokenizers, and holds little of a batch at once."""
    names, of = [t.name for t in tokenizers], [(t.ids, t.parts) for t in tokenizers]
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("language", "doc_id", "text")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for name, (ids, n) in zip(names, encoded(b["text"].to_pylist(), of), strict=True):
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), *b.columns, lists], names=["tokenizer", *kinds, "ids"])

    return src.select(*kinds).mapInArrow(run, f"tokenizer string, {', '.join(f'{c} {k}' for c, k in kinds.items())}, ids array<int>")


def decoded(corpus: DataFrame, tokenizers: list[Tokenizer], same: dict[str, Tokenizer] | None = None) -> DataFrame:
    """tokenizer, doc_id, decoded, equal: every text encoded and decoded by stored tokenizers, null texts as null.

    equal: whether the tokenizer that same has for one's name gives the same ids; null without one.
    """
    others = [(same or {}).get(t.name) for t in tokenizers]
    names, backs, there = [t.name for t in tokenizers], [t.back for t in tokenizers], [o is not None for o in others]
    of = [(t.ids, t.parts) for t in [*tokenizers, *filter(None, others)]]
    kind = corpus.schema["doc_id"].dataType.simpleString()

    def lists(ids: np.ndarray, n: np.ndarray) -> Iterator[list[int]]:
        upto = np.cumsum(n).tolist()
        return (ids[i:j].tolist() for i, j in zip([0, *upto], upto, strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b["text"].drop_null().to_pylist()
            null = b["text"].is_null().to_pylist()
            found = encoded(texts, of)
            second = iter(found[len(names) :])
            for name, back, other, (ids, n) in zip(names, backs, there, found, strict=False):
                made = (x for few in portions(list(lists(ids, n))) for x in back(few))
                shown = pa.array((None if x else next(made) for x in null), pa.string())
                alike = (x == y for x, y in zip(lists(ids, n), lists(*next(second)), strict=True)) if other else None
                equal = pa.array([None if x or alike is None else next(alike) for x in null], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(null)), b["doc_id"], shown, equal], names=["tokenizer", "doc_id", "decoded", "equal"])

    return corpus.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"tokenizer string, doc_id {kind}, decoded string, equal boolean")


def encode(corpus: DataFrame, tokenizers: list[Tokenizer], *, strict: bool = False) -> DataFrame:
    """tokenizer, language, doc_id, text, tokens (strings): every text that is not blank, by every tokenizer.

    Texts without tokens are dropped; strict raises on them instead.
    """
    if len({t.name for t in tokenizers}) < len(tokenizers):
        raise ValueError("tokenizer names repeat")
    if not tokenizers:
        raise ValueError("no tokenizers given")
    src = corpus.where(F.col("text").isNotNull() & not_blank(F.col("text")))
    stored = [t for t in tokenizers if t.ids is not None and not t.preprocess]
    columns = [t for t in tokenizers if t not in stored]
    out = None
    if columns:  # all of them in one pass over the texts
        each = F.array(*[F.struct(F.lit(t.name).alias("tokenizer"), t.encode(F.col("text")).cast("array<string>").alias("tokens")) for t in columns])
        out = src.select("language", "doc_id", "text", F.explode(each).alias("e")).select("e.tokenizer", "language", "doc_id", "text", "e.tokens")
    if stored:
        x = _by_library(src, stored).select("tokenizer", "language", "doc_id", "text", F.col("ids").cast("array<string>").alias("tokens"))
        out = x if out is None else out.unionByName(x)
    if strict:
        return out.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("no tokens for a text of "), F.col("language")))))
    return out.where(F.size("tokens") > 0)


def tokenizers_table(spark, tokenizers: list[Tokenizer]) -> DataFrame:
    return spark.createDataFrame([(t.name, t.vocab_size, t.unk_id) for t in tokenizers], "tokenizer string, vocab_size long, unk_id int")


def vocabulary(spark, tokenizers: list[Tokenizer]) -> DataFrame:
    """tokenizer, token_id, token of all that have a vocabulary."""
    return spark.createDataFrame([(t.name, i, s) for t in tokenizers if t.vocab for s, i in t.vocab.items()], "tokenizer string, token_id int, token string")


def spelled(tokens: DataFrame, tokenizers: list[Tokenizer]) -> DataFrame:
    """tokens with strings in place of ids, for tokenizers that have ids; the others' rows stay as they are.

    A worker loads a tokenizer's file once, so a vocabulary is neither joined nor sent.
    """
    of = {t.name: t.spell for t in tokenizers if t.spell is not None}
    if not of:
        return tokens

    @F.pandas_udf("array<string>")
    def strings(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, lists in batches:
            yield pd.Series([x if x is None or n not in of else of[n]([int(i) for i in x]) for n, x in zip(names, lists, strict=True)], index=names.index, dtype=object)

    return tokens.withColumn("tokens", strings("tokenizer", "tokens"))


def spelled_counts(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """counts with token, its string, and token_id: a join on the vocabulary's few rows a tokenizer; tokens without one stay, with a null id."""
    v = vocabulary.select("tokenizer", F.col("token_id").cast("string").alias("__id"), F.col("token").alias("__token"))
    x = counts.join(v, (counts["tokenizer"] == v["tokenizer"]) & (counts["token"] == v["__id"]), "left").drop(v["tokenizer"])
    return x.withColumn("token_id", F.col("__id").cast("int")).withColumn("token", F.coalesce("__token", "token")).drop("__id", "__token")
