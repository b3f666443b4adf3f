"""Approximate nearest neighbours for tables beyond block products: neighbours of neighbours, round by round.

Every row starts with the nearest of a few random blocks. In a round a row's neighbours, and the nearest of the
rows that name it theirs, are compared with each other: who is near to one place is likely near to each other.
A round moves at most two lists of vectors a row and one of candidates for each of them; no pair of blocks is
multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import discard, materialise

#: Rows of a random block, and of a group of places that a task compares.
START_ROWS, GROUP_ROWS = 256, 512


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, squared distance) of each row's k nearest others."""
    square = (x * x).sum(1)
    d2 = square[:, None] + square[None] - 2 * x @ x.T
    np.fill_diagonal(d2, np.inf)
    n = min(k, len(x) - 1)
    if n < 1:
        return np.array([], int), np.array([], int), np.array([])
    near = np.argpartition(d2, n - 1, axis=1)[:, :n]
    i, j = np.repeat(np.arange(len(x)), n), near.ravel()
    return i, j, ((x[i] - x[j]) ** 2).sum(1)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest (src, dst, d2) of each src, every pair once, with their rank."""
    once = pairs.groupBy("src", "dst").agg(F.min("d2").alias("d2"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("rank") <= k)


def knn_descended(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "v", starts: int = 2, rounds: int = 10, enough: float = 0.002, widen: int = 3, seed: int = 0) -> DataFrame:
    """(src, dst, d2, rank) of about the k nearest neighbours by squared distance, distances exact.

    The descent keeps widen * k neighbours a row, of which the nearest k are returned: data without structure
    needs the room. Rounds end when fewer than a share enough of all neighbours changed. Ids must be unique; rows without an
    id or a vector take no part.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = materialise(rows, "descent-rows")
    n, kind = rows.count(), rows.schema["id"].dataType.simpleString()
    out, asked, k = f"src {kind}, dst {kind}, d2 double", k, widen * k

    def start(table: pa.Table) -> pa.Table:
        i, j, d2 = _nearest(_matrix(table.column("v")), k)
        ids = table.column("id")
        return pa.table({"src": ids.take(pa.array(i)), "dst": ids.take(pa.array(j)), "d2": pa.array(d2)})

    def compared(table: pa.Table) -> pa.Table:
        x, place = _matrix(table.column("v")), table.column("p").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(place, kind="stable")
        parts: list[list[np.ndarray]] = [[], [], []]
        for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            i, j, d2 = _nearest(x[at], k)
            for part, v in zip(parts, (at[i], at[j], d2)):
                part.append(v)
        i, j, d2 = (np.concatenate(p) if p else np.array([], int) for p in parts)
        ids = table.column("q")
        return pa.table({"src": ids.take(pa.array(i.astype(np.int64))), "dst": ids.take(pa.array(j.astype(np.int64))), "d2": pa.array(d2.astype(float))})

    blocks = max(1, -(-n // START_ROWS))
    dealt = [rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(blocks)).alias("b")).groupBy("b").applyInArrow(start, out) for s in range(starts)]
    first = dealt[0]
    for more in dealt[1:]:
        first = first.unionByName(more)
    best = materialise(_best(first, k), "descent")
    groups = max(1, -(-n // GROUP_ROWS))
    for _ in range(rounds):
        ahead = best.select(F.col("src").alias("p"), F.col("dst").alias("q"))
        behind = best.select(F.col("dst").alias("p"), F.col("src").alias("q"), F.row_number().over(Window.partitionBy("dst").orderBy("d2", "src")).alias("n")).where(F.col("n") <= k)
        own = rows.select(F.col("id").alias("p"), F.col("id").alias("q"))
        near = ahead.unionByName(behind.select("p", "q")).unionByName(own).distinct()
        near = near.join(rows.select(F.col("id").alias("q"), "v"), "q").withColumn("g", F.pmod(F.xxhash64("p"), F.lit(groups)))
        found = near.select("g", "p", "q", "v").groupBy("g").applyInArrow(compared, out)
        new = materialise(_best(best.select("src", "dst", "d2").unionByName(found), k), "descent")
        changed = new.join(best.select("src", "dst"), ["src", "dst"], "left_anti").count()
        discard(best.sparkSession, best)
        best = new
        if changed <= enough * n * k:
            break
    return best.where(F.col("rank") <= asked)
