"""Exact dedup by deterministic block naming.

A text (A-Z lower-cased, UTF-8) is cut into blocks of a fixed size. Equal blocks get one integer name by
sorting: a name is a slice of the order (by 64-bit hash, then bytes) and the block's rank in it, so it
doesn't depend on partitions. Adjacent names are paired and the pairs named likewise, level by level, until
a document has one name. Names stand for contents, never for hashes: equal (level, name) means equal text.

Blocks travel once, to their slice. Blocks of many documents are known beforehand from counts of hashes; the
MOST_HEAVY heaviest are named on their own, sent to the rows (at most MOST_HEAVY * BLOCK_BYTES bytes), and
their rows go on without the text, dealt by document. Pairs and groups meet their names the same way. A row
is (id, SHA-256 of its text): repeated rows are counted, not carried apart, and rows of one id stay apart.

Defined results: a null text counts as empty, and an empty text is a text; null ids keep their rows but
never beat an id; of repeated rows with the kept id one stays; only the id and text columns are read; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import arrow_rows, materialise

BLOCK_BYTES = 1024
#: Bits of the hash that choose a slice of the order; ranks in a slice have 32 bits below.
SLICE_BITS = 24
#: A key is heavy from so many rows; so many keys, the heaviest ones, meet their rows by broadcast.
HEAVY_ROWS, MOST_HEAVY = 64, 10_000
#: Rows of an Arrow batch: a batch holds its texts whole.
BATCH_ROWS = 256
#: Rows up to which one sequence repeats a repeated row.
_REPEATS = 1 << 16


def _cut(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, digests: bool) -> DataFrame:
    """(id, digest, n, pos, block) of every block of every row, the digest null if it isn't asked for."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            raw = text.cast(pa.large_string())
            ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            data, size = raw.buffers()[2], np.diff(ends)
            n = np.maximum(1, -(-size // block_bytes))
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.append(ends[row] + pos * block_bytes, ends[-1] if len(ends) else 0)
            blocks = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(starts.astype(np.int64)), data or pa.py_buffer(b"")]).cast(pa.binary())
            take = pa.array(row)
            if digests:
                view = memoryview(data or b"")
                digest = pa.array([hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1], ends[1:])], pa.binary()).take(take)
            else:
                digest = pa.nulls(len(row), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), digest, pa.array(n[row], pa.int64()), pa.array(pos, pa.int64()), blocks], names=["id", "digest", "n", "pos", "block"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, digest binary, n long, pos long, block binary")


def _slice(h: Column) -> Column:
    """The slice of the order of hashes, from 1."""
    return F.shiftrightunsigned(h, 64 - SLICE_BITS) + 1


def _name(slice_: Column, rank: Column) -> Column:
    return F.shiftleft(slice_, 32).bitwiseOR(rank.cast("long"))


def _met(rows: DataFrame, each: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """rows with the columns of each (one row a combination of keys, its rows counted): the heaviest by broadcast, the rest by a shuffle."""
    heavy = materialise(each.where(F.col(count_col) >= HEAVY_ROWS).orderBy(F.desc(count_col)).limit(MOST_HEAVY), "naming-heavy")
    new = [c for c in each.columns if c not in (*keys, count_col)]
    if heavy.isEmpty():
        return rows.join(each.drop(count_col), keys)
    h = heavy.drop(count_col).withColumn("_heavy", F.lit(True)).alias("h")
    told = rows.alias("r").join(F.broadcast(h), [F.col(f"r.{k}") == F.col(f"h.{k}") for k in keys], "left")
    here = told.where("_heavy").select("r.*", *[F.col(f"h.{c}") for c in new])
    light = each.drop(count_col).join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    rest = told.where("_heavy is null").select("r.*").join(light, keys)
    return here.unionByName(rest.select(*here.columns))


def named_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(id, digest, n, copies, pos, name) of every block of every row."""
    plain = _cut(docs, id_col, text_col, block_bytes, False).select(F.xxhash64("block").alias("h"), "block")
    heavy = materialise(plain.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= HEAVY_ROWS).orderBy(F.desc("c")).limit(MOST_HEAVY).select("h"), "naming-hashes")
    rows = _cut(docs, id_col, text_col, block_bytes, True).withColumn("h", F.xxhash64("block"))
    if heavy.isEmpty():
        told = rows.withColumns({"name": F.lit(None).cast("long"), "slice": _slice(F.col("h"))})
    else:
        blocks = materialise(plain.join(F.broadcast(heavy), "h", "left_semi").distinct(), "naming-blocks")
        # As many rows as heavy blocks: one task may order them. Slice 0 is theirs.
        known = blocks.select(F.col("h").alias("kh"), F.col("block").alias("kb"), F.row_number().over(Window.orderBy("h", "block")).cast("long").alias("name"))
        told = rows.join(F.broadcast(known), (F.col("h") == F.col("kh")) & (F.col("block") == F.col("kb")), "left")
        light = F.col("name").isNull()
        dealt = -_slice(F.xxhash64("id", "digest", "pos"))
        told = told.select("id", "digest", "n", "pos", "name", F.when(light, _slice(F.col("h"))).otherwise(dealt).alias("slice"), F.when(light, F.col("h")).alias("h"), F.when(light, F.col("block")).alias("block"))
    rank = F.dense_rank().over(Window.partitionBy("slice").orderBy("h", "block"))
    return told.select("id", "digest", "n", F.lit(1).cast("long").alias("copies"), "pos", F.coalesce("name", _name(F.col("slice"), rank)).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, digest, copies, level, name) of all rows, the repeated ones counted: texts are equal where level and name are."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = materialise(named_blocks(docs, id_col, text_col, block_bytes), "naming-0")
    found, level = [], 0
    while True:
        found.append(rows.where("n = 1").select("id", "digest", "copies", F.lit(level).alias("level"), "name"))
        rest = rows.where("n > 1")
        if rest.isEmpty():
            break
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = rest.groupBy("id", "digest", "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(even, F.col("copies"))).alias("copies")
        )
        pairs = materialise(pairs, f"naming-pairs-{level}")
        kinds = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).withColumn("slice", _slice(F.xxhash64("a", "b")))
        rank = F.row_number().over(Window.partitionBy("slice").orderBy("a", "b"))
        kinds = materialise(kinds.select("a", "b", "c", _name(F.col("slice"), rank).alias("name")), f"naming-kinds-{level}")
        rows = materialise(_met(pairs, kinds, ["a", "b"], "c").select("id", "digest", F.floor((F.col("n") + 1) / 2).alias("n"), "copies", "pos", "name"), f"naming-{level}")
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("id", "digest", "level", "name").agg(F.sum("copies").alias("copies"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row: the largest id of equal texts stays."""
    each = materialise(identities(docs, id_col, text_col, block_bytes), "naming-documents")
    groups = materialise(each.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("c")), "naming-groups")
    told = _met(each, groups, ["level", "name"], "c")
    # A repeated row comes back as often as it was there, from short sequences.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _REPEATS))).alias("chunk")
    told = told.select("id", "digest", "copies", "keep_id", "group_size", chunk)
    left = F.least(F.col("copies") - F.col("chunk") * _REPEATS, F.lit(_REPEATS))
    told = told.select("id", "digest", "keep_id", "group_size", "chunk", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("nth"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chunk") == 0) & (F.col("nth") == 1)
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were; ids must be unique and not null."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept"))
    return docs.join(stay, F.col(id_col) == F.col("_kept"), "left_semi")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
