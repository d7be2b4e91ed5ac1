"""A session with the settings the library is tuned for; any session works."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lexigauge", cores: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own session to the library."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for k, v in base.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process, else ValueError."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lexigauge-")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lexigauge/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has in the shared folder; call it when no result that reads it is needed any more."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/lexigauge/{sc.applicationId}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once a session: their path need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lexigauge-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
