"""Tokens written for later use."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import Tokenizer


def write_tokens(tokens: DataFrame, path: str, kind: str = "parquet") -> None:
    """tokenizer, language, doc_id, text, tokens as Parquet or JSON lines, a folder for each tokenizer."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"tokens are written as parquet or json, not {kind!r}")
    tokens.write.mode("overwrite").partitionBy("tokenizer").format(kind).save(path)


def write_records(records: DataFrame, path: str) -> None:
    """Tokenized records (tokenizer_name, language, tokens as ids, text, metadata) as Parquet, for read_tokenized()."""
    records.select("tokenizer_name", "language", F.col("tokens").cast("array<int>").alias("tokens"), "text", "metadata").write.mode("overwrite").parquet(path)


def write_cache(tokens: DataFrame, tokenizers: list[Tokenizer], folder: str) -> dict[str, str]:
    """Tokens, each vocabulary as one token a line by id, and a configuration that names the vocabularies."""
    write_tokens(tokens, f"{folder}/tokens")
    files = {}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for t in tokenizers:
        if t.vocab is not None:
            p = Path(folder, f"{t.name}_vocab.txt")
            p.write_text("\n".join(s for s, _ in sorted(t.vocab.items(), key=lambda x: x[1])), encoding="utf-8")
            files[t.name] = str(p)
    Path(folder, "tokenized_data_config.json").write_text(json.dumps({"vocabulary_files": files}, indent=2), encoding="utf-8")
    return files


def write_training(train: DataFrame, test: DataFrame, folder: str) -> None:
    """id and text as JSON lines, training and test apart."""
    for name, d in (("train", train), ("test", test)):
        d.select("id", "text").write.mode("overwrite").json(f"{folder}/{name}")


def write_examples(scored: DataFrame, folder: str) -> None:
    """Words with their tokens and morphemes, a folder of text for each tokenizer."""
    line = F.concat_ws("\t", "language", "word", F.array_join("tokens", " "), F.array_join("morphemes", " "))
    scored.select("tokenizer", line.alias("value")).write.mode("overwrite").partitionBy("tokenizer").text(folder)
