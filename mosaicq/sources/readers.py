"""Sources of the engine: text tables, file names, position records, images, parameters."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSETS = "cycle int, file string, dy int, dx int"
SPOTS = "y int, x int, channel string, r int, ye int, g int, b int"
LOCALISATIONS = "x_in_pix double, y_in_pix double, z_in_pix double, integratedIntensity double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, index: bool = False, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV table; index: its first column is an unnamed index, which is dropped."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is None:
        found = reader.option("inferSchema", True).csv(path)
        return without_unnamed(found) if index else found
    out = reader.schema(f"_index string, {schema}" if index else schema).csv(path)
    return out.drop("_index") if index else out


def without_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns that other writers leave without a name."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c and not c.startswith(("Unnamed", "_c0"))])


def read_indexed(spark: SparkSession, path: str, name: str = "index") -> DataFrame:
    """A CSV table whose unnamed first column is kept under a name."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed(df.columns[0], name) if df.columns[0] in ("_c0", "Unnamed: 0") else df


def read_localisations(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """Tab-separated localisations as integer pixels, counted from 0."""
    df = spark.read.option("sep", "\t").option("header", True).schema(LOCALISATIONS).csv(path)
    pixel = {o: (F.rint(F.col(c)) - first).cast("int") for c, o in (("x_in_pix", "x"), ("y_in_pix", "y"), ("z_in_pix", "z"))}
    return df.select(*[c.alias(o) for o, c in pixel.items()], "integratedIntensity")


def read_int_blocks(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """Headerless integer blocks; empty files have no rows."""
    return spark.read.schema(", ".join(f"{c} int" for c in columns)).csv(glob)


def read_codebook(spark: SparkSession, path: str, key: str = "code", name: str = "gene_name") -> DataFrame:
    """(code, gene_name) of a CSV, Parquet or spreadsheet codebook."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        frame = pd.read_excel(path)
        return spark.createDataFrame(frame.rename(columns={frame.columns[0]: key})[[key, name]])
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return df.withColumnRenamed(df.columns[0], key).select(key, name)


def parsed_names(df: DataFrame, name: str | Column = "name", with_channel: bool = True) -> DataFrame:
    """cycle, tile, channel, z of names like C001-T0002-cy3-Z003.tif; others are dropped."""
    name = F.col(name) if isinstance(name, str) else name
    pattern = r"C(\d+)-T(\d+)-(\w+)-Z(\d+)\.tiff?$" if with_channel else r"C(\d+)-T(\d+)-(?:(\w+)-)?Z(\d+)\.tiff?$"
    out = df.withColumns({
        "cycle": F.regexp_extract(name, pattern, 1), "tile": F.regexp_extract(name, pattern, 2),
        "channel": F.regexp_extract(name, pattern, 3), "z": F.regexp_extract(name, pattern, 4),
    })
    return out.where("cycle <> ''").withColumns({c: F.col(c).cast("int") for c in ("cycle", "tile", "z")})


def list_files(spark: SparkSession, path: str, glob: str = "*.tif", recursive: bool = False) -> DataFrame:
    """(path, name, length) of files, without their content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def tile_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return parsed_names(list_files(spark, path, "*.tif*", recursive))


def paired_files(spark: SparkSession, images: str, masks: str, glob: str = "*.tif") -> DataFrame:
    """Training pairs: image and mask of the same name."""
    a = list_files(spark, images, glob).select("name", F.col("path").alias("image"))
    return a.join(list_files(spark, masks, glob).select("name", F.col("path").alias("mask")), "name")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """file, corr, x, y, grid_c, grid_r of lines 'file: a.tif; corr: 0.9; position: (1, 2); grid: (0, 0);'."""
    return parsed_positions(spark.read.text(path).withColumnRenamed("value", "line"))


def parsed_positions(lines: DataFrame, line: str = "line") -> DataFrame:
    pairs = F.transform(F.filter(F.split(F.col(line), ";"), lambda x: x.contains(":")), lambda x: F.split(x, ":", 2))
    record = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v"))))
    out = lines.where(F.col(line).contains(":")).select(record.alias("m"))

    def number(key: str, n: int) -> Column:
        return F.regexp_extract(F.try_element_at("m", F.lit(key)), r"(-?\d+)\s*,\s*(-?\d+)", n).cast("int")

    return out.select(
        F.try_element_at("m", F.lit("file")).alias("file"), F.try_element_at("m", F.lit("corr")).try_cast("double").alias("corr"),
        number("position", 1).alias("x"), number("position", 2).alias("y"), number("grid", 1).alias("grid_c"), number("grid", 2).alias("grid_r"),
    )


def offsets_long(wide: DataFrame, cycle: str = "cycle") -> DataFrame:
    """cycle, file, dy, dx of a wide table whose cells are 'dy dx', blanks irregular."""
    files = [c for c in wide.columns if c != cycle]
    long = wide.unpivot([cycle], [F.col(f"`{c}`") for c in files], "file", "cell").where("cell is not null")
    parts = F.split(F.trim("cell"), r"\s+")
    return long.select(F.col(cycle).alias("cycle"), "file", F.rint(F.element_at(parts, 1).cast("double")).cast("int").alias("dy"), F.rint(F.element_at(parts, 2).cast("double")).cast("int").alias("dx"))


def offsets_wide(long: DataFrame, files: list[str]) -> DataFrame:
    return long.groupBy("cycle").pivot("file", files).agg(F.first(F.concat_ws(" ", "dy", "dx")))


#: Numeric element types of the version 5 MAT format.
_MAT_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _mat_elements(raw: bytes, order: str):
    """(type, data) of consecutive elements; small ones hold their data in the tag."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # size and type share a word
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + (size if kind == 15 else -(-size // 8) * 8)


def decode_mat(raw: bytes) -> dict[str, list[float]]:
    """The real numeric arrays of a version 5 MAT file by name, each as a list of numbers, column by column."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    for kind, data in _mat_elements(raw[128:], order):
        if kind == 15:  # a compressed element
            kind, data = next(_mat_elements(zlib.decompress(data), order))
        parts = list(_mat_elements(data, order)) if kind == 14 else []
        if len(parts) >= 4 and 6 <= parts[0][1][0 if order == "<" else 3] <= 15:
            form = order + _MAT_KINDS[parts[3][0]]
            out[parts[2][1].decode()] = [float(v) for v in np.frombuffer(parts[3][1], form)]
    return out


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, values) of the numeric arrays of MAT files."""

    def run(batches):
        for batch in batches:
            rows = [(p, k, v) for p, raw in zip(*(c.to_pylist() for c in batch.columns)) for k, v in decode_mat(raw).items()]
            cols = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.float64())))], names=["path", "name", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, name string, values array<double>")


def read_parameters(path: str | None = None, defaults: dict | None = None, overrides: dict | None = None) -> dict:
    """Parameters in layers: defaults, then the file, then overrides (YAML through the safe loader)."""
    out = dict(defaults or {})
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            out |= yaml.safe_load(f) or {}
    return out | (overrides or {})


def files_of(parameters: dict, mode_key: str = "fileProcessingMode", file_key: str = "dataFileName", threshold_key: str = "threshLevel") -> list[str]:
    """The image files that parameters name: one, or in a batch one below the folder for each channel with a threshold."""
    mode, place = parameters[mode_key], parameters[file_key]
    if mode == "singleFile":
        return [place]
    if mode == "batch":
        return [f"{place.rstrip('/')}/{channel}.tif" for channel in parameters[threshold_key]]
    raise ValueError(f"unknown {mode_key}: {mode}")
