"""Helpers shared by the operators: row-wise Arrow passes, shared scratch tables, byte tables.

Row-wise passes keep every input row and column, so they need no join on an id
and behave alike for null and repeated ids.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Prefix of columns added beside a caller's own columns, so that names cannot clash.
OWN = "__lx_"

#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A-Z to a-z; bytes that are neither ASCII letters or digits nor part of a longer UTF-8 character become spaces.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

ARROW = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what is decoded at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of a string column, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // size)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes objects; null stays None."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    return column.cast(pa.binary()).to_pylist()


def annotate(df: DataFrame, text_col: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[list[bytes | None]], list[list]]]) -> DataFrame:
    """df with the columns that make()'s function returns for each batch of texts.

    make runs once a task; fields are (name, kind) with kind a key of ARROW, and are
    added under OWN + name.
    """
    fields = list(fields)
    schema = T.StructType([*df.schema.fields, *(T.StructField(OWN + n, ARROW[k][0]) for n, k in fields)])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches):
            made = f(utf8(b.column(at)))
            arrays = [pa.array(x, type=ARROW[k][1]) for x, (_, k) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *(OWN + n for n, _ in fields)])

    return df.mapInArrow(run, schema)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/lexigauge/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process, else ValueError."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lexigauge-")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result that reads them is needed any more."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/lexigauge/{sc.applicationId}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the session's folder, which is set here only where it is unset (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(True)


def cached_in_worker(key: str, build: Callable[[], object], keep: dict = {}) -> object:  # noqa: B006
    """build()'s result, kept while this Python worker lives or until it needs another: what an operator is done with takes no room from the next one."""
    if key not in keep:
        keep.clear()
        keep[key] = build()
    return keep[key]
