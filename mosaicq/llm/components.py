"""Connected components by alternating large-star and small-star rounds, on DataFrames alone.

A hub's neighbours are never gathered: a round is a minimum per node (combined before the shuffle and
written), joined back to the edges, so rows never outnumber edges and adaptive execution can split the
hub, as both sides of the join are plain shuffles. Each round is written to the shared folder, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import materialise

#: A key is heavy from so many rows, and from so great a share that no more than MOST_HEAVY keys can have it.
HEAVY_ROWS, MOST_HEAVY = 1024, 100_000


def heavy_from(n_rows: int) -> int:
    """The least rows of a heavy key, of a table of n_rows."""
    return max(HEAVY_ROWS, -(-n_rows // MOST_HEAVY))


def with_each(rows: DataFrame, key: str, each: DataFrame, n_rows: int, count_col: str = "n") -> DataFrame:
    """rows with the columns of each, which has one row a key and the number of rows (count_col) of that key.

    Rows of heavy keys meet their row of each by a broadcast of at most MOST_HEAVY rows, all others by a
    shuffle; rows whose key is null or not in each are dropped.
    """
    names = [c for c in each.columns if c not in (key, count_col)]
    limit = heavy_from(n_rows)
    heavy = each.where(F.col(count_col) >= limit).select(F.col(key).alias("_h"), *[F.col(c).alias(f"_h_{c}") for c in names])
    told = rows.join(F.broadcast(heavy), F.col(key) == F.col("_h"), "left")
    here = told.where("_h is not null").select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in names])
    light = each.where(F.col(count_col) < limit).select(F.col(key).alias("_k"), *names)
    rest = told.where("_h is null").select(*rows.columns)
    return here.unionByName(rest.join(light, F.col(key) == F.col("_k")).select(*rows.columns, *names))


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, least): edges with the least node among u and its neighbours in the table."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("least"))
    return edges.join(materialise(low, "components-least"), F.col("u") == F.col("k")).select("u", "v", "least")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of links, the component being its least node."""
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(pair, "components")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        seen = _least(large)
        small = seen.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(seen.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
