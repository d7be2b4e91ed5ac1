"""Token ids as Parquet list columns.

Documents are range partitioned by id, encoded after that one shuffle (of text, which is
smaller than ids) and written as lists with delta encoding, bounded row groups and pages,
and page indexes, so that a reader can take a range of documents or the lengths alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, portions, scratch
from .encode import default_tokenizer, encoder

END = 2


def encoded(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end: int | None = END) -> DataFrame:
    """id_col, n_tokens, ids: each whole text's ids and the end id; null and empty texts have the end id alone."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        last = b"" if end is None else np.array([end], "<u4").tobytes()
        for b in portions(batches, 1):
            raw = [enc.encode(x or "") + last for x in b.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in raw], np.int64)
            ids = np.frombuffer(b"".join(raw), "<i4")
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=[id_col, "n_tokens", "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, row_group_mb: int = 32, page_kb: int = 256, encoding: str = "delta", compression: str = "zstd", partitions: int | None = None
) -> None:
    """Write docs' ids in ascending id order (nulls first); files in name order, rows in file order.

    encoding: "delta" (DELTA_BINARY_PACKED, format v2 pages) or "dictionary". Page indexes
    are always written. Null and empty texts have the end id alone; repeated ids stay, ordered by
    text; very long texts are one row; an empty table gives files without rows; extra columns are left out.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding must be delta or dictionary, not {encoding!r}")
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    # the second key splits a hot id over several ranges
    keys = [F.col(id_col), F.xxhash64("__text")]
    ranged = src.repartitionByRange(partitions, *keys) if partitions else src.repartitionByRange(*keys)
    out = encoded(ranged.sortWithinPartitions(F.col(id_col), "__text"), id_col, "__text", tokenizer or default_tokenizer())
    (
        out.write.option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("compression", compression)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote, with file and row (the place in the file) for order."""
    meta = F.col("_metadata")
    return spark.read.parquet(path).select("*", meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def catalog(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files.

    Only one row a file is gathered to add up what stands before each file, in the order
    of the files' numbers; within a file the running sum goes by row.
    """
    raw = spark.read.parquet(path)
    id_type = raw.schema[id_col].dataType.simpleString()
    at = read_tokens(spark, path)
    name = F.substring_index("file", "/", -1)
    src = at.select(id_col, F.xxhash64(name).alias("file"), "row", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2048):
            lists = b.column(3)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(crc, pa.int64())], names=[id_col, "file", "row", "n_tokens", "ids_crc32"])

    rows = src.mapInArrow(run, f"`{id_col}` {id_type}, file long, row long, n_tokens long, ids_crc32 long")
    totals = at.groupBy(name.alias("name")).agg(F.sum("n_tokens").alias("n"))
    number = lambda p: F.regexp_extract("name", p, 1).try_cast("long")  # noqa: E731  as text, part-100000 is before part-99999
    order = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), "name")
    before = totals.select(F.xxhash64("name").alias("file"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("start", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    return within.join(before, "file").select(F.col(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """The contract's rows: write to the shared folder, read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path)
    return catalog(spark, path)

