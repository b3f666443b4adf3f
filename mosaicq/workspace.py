"""Shared scratch space: tables that cut lineage live where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one (tests) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaicq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables and files written inside the block are deleted at its end: nothing lazy may outlive it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            discard(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most so many rows for what Python runs inside the block; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before) if int(before) > 0 else most)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: short lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memoised(df: DataFrame, path: str) -> DataFrame:
    """The table at path if it was written to its end, else df, written there: what exists is not computed again."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Partitions, at most, to which groups of much work are dealt by their number.
MOST_PARTS = 2000

#: Rows up to which a side of a join is called few.
FEW_ROWS = 100_000


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df, with a broadcast hint if a count finds it small enough; else the planner decides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a table that materialise() wrote, once nothing will read it again."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
