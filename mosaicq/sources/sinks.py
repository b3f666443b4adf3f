"""Sinks of the engine: tables, integer text, images, parameters, provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """Parquet; with partition_by only the partitions in df are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, mode="append")


def write_ints(df: DataFrame, path: str) -> None:
    """Headerless integers, rounded half to even."""
    write_csv(df.select(*[F.rint(F.col(c).cast("double")).cast("long").alias(c) for c in df.columns]), path, header=False)


def write_positions(positions: DataFrame, path: str) -> None:
    """One 'file: ...; corr: ...; position: (x, y); grid: (c, r);' line a tile; NaN correlation is -1."""
    corr = F.when(F.isnan("corr") | F.col("corr").isNull(), -1.0).otherwise(F.col("corr"))
    line = F.format_string("file: %s; corr: %.10f; position: (%d, %d); grid: (%d, %d);", "file", corr, "x", "y", "grid_c", "grid_r")
    positions.select(line.alias("value")).write.mode("overwrite").text(path)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """(name, bytes) of the files, PNG or TIFF by their names, that executors wrote from rows (name, height, width, pixels)."""
    from mosaicq.sources.images import encode_png, encode_tiff, to_array

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in batches:
            sizes = []
            for row in frame.itertuples():
                raw = (encode_png if row.name.lower().endswith(".png") else encode_tiff)(to_array(row.pixels, row.height, row.width))
                with store.open_output_stream(f"{base}/{row.name}", compression=None) as f:
                    f.write(raw)
                sizes.append(len(raw))
            yield pd.DataFrame({"name": list(frame["name"]), "bytes": sizes})

    return images.select("name", "height", "width", "pixels").mapInPandas(run, "name string, bytes long")


def write_translations(translations: DataFrame, path: str) -> None:
    """One 'side-file: ...; corr: ...; position: (dx, dy); grid: (c, r);' line a pair of neighbouring tiles; NaN correlation is -1."""
    corr = F.when(F.isnan("corr") | F.col("corr").isNull(), -1.0).otherwise(F.col("corr"))
    line = F.format_string("%s-file: %s; corr: %.10f; position: (%d, %d); grid: (%d, %d);", "side", "file", corr, "dx", "dy", "grid_c", "grid_r")
    translations.select(line.alias("value")).write.mode("overwrite").text(path)


def write_parameters(spark: SparkSession, values: dict, path: str) -> None:
    """Nested parameters as one JSON row."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run_metadata(spark: SparkSession, run_id: str, stage: str, settings: dict, path: str) -> None:
    """Provenance: a row for each stage of a run."""
    row = spark.createDataFrame([(run_id, stage, json.dumps(settings, sort_keys=True, default=str))], "run_id string, stage string, settings string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Provenance of many stages at once: rows (run_id, stage, settings as JSON), stamped with the time."""
    runs.select("run_id", "stage", "settings").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_cells(obs: DataFrame, var: DataFrame, expr: DataFrame, folder: str) -> None:
    """The annotated matrix as three tables: cells, genes, and counts in long form."""
    for name, df in (("obs", obs), ("var", var), ("expr", expr)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("obs", "var", "expr"))
