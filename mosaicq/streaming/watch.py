"""Incremental folders: a cycle is taken up when its completion marker appears, once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "finish.txt"


def finished_cycles(spark: SparkSession, folder: str, marker: str = MARKER) -> DataFrame:
    """A stream of (cycle, path) of the cyc_N folders whose marker has appeared; cycle 0 never counts."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", marker).option("recursiveFileLookup", True).load(folder)
    cycle = F.regexp_extract("path", r"/cyc_(\d+)/[^/]*$", 1)
    return files.select(cycle.alias("cycle"), F.regexp_replace("path", "/[^/]*$", "").alias("path")).where("cycle <> ''").withColumn("cycle", F.col("cycle").cast("int")).where("cycle <> 0")


def run_available(cycles: DataFrame, process: Callable[[SparkSession, int, str], None], done: Callable[[int], bool], checkpoint: str) -> None:
    """Process the cycles that are finished now and not done; the checkpoint and done() make a repeat harmless."""

    def batch(df: DataFrame, _: int) -> None:
        for row in sorted(df.select("cycle", "path").distinct().collect()):  # a row a cycle: few
            if not done(row["cycle"]):
                process(df.sparkSession, row["cycle"], row["path"])

    cycles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_until_idle(cycles: DataFrame, process, done, checkpoint: str, every_s: float = 300, idle_s: float = 10_800, clock=time.monotonic, sleep=time.sleep) -> int:
    """Poll until nothing new has come for idle_s; returns how many cycles were processed."""
    seen = 0
    last = clock()

    def counted(spark, cycle, path):
        nonlocal seen, last
        process(spark, cycle, path)
        seen += 1
        last = clock()

    while True:
        run_available(cycles, counted, done, checkpoint)
        if clock() - last >= idle_s:
            return seen
        sleep(every_s)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage table was committed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    """Retention: remove intermediate stage tables."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
