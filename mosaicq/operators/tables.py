"""Relational operators of the engine: distinct, top, sampling, sets, reshaping, completeness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import materialise


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def with_row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense ids 0, 1, ... in an explicit order: rows are dealt out by range, only the parts' counts are summed in one task."""
    parts = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "row-ids")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_o", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", own).join(before, "_p").withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_p", "_o", "_r")


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, which has one row a key; a key that right lacks raises an error."""
    found = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_found"), True).otherwise(missing)).drop("_found")


def side_by_side(frames: list[DataFrame], key: str, fill=0) -> DataFrame:
    """Tables joined by their key, one beside the other; what a table lacks is filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in out.columns if c != key])


def top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Draws are whole numbers below this.
DRAWS = 1 << 60


def draw_of(key: list[str], seed: int) -> Column:
    """A number from 0 to DRAWS, by MD5 of the seed and the key's values as text: another engine draws the same."""
    told = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    return F.conv(F.substring(told, 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """min(n, rows) rows by a seeded hash of their key: the same rows however the table is partitioned, if no two have one key."""
    return df.orderBy(draw_of(key, seed), *key).limit(n)


def sample_each(df: DataFrame, group: str, n: int, key: list[str], seed: int = 0) -> DataFrame:
    w = Window.partitionBy(group).orderBy(draw_of(key, seed), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def bootstrap(df: DataFrame, fraction: float, key: list[str], seed: int = 1) -> DataFrame:
    """Rows drawn with replacement: each comes as often as a Poisson draw of the fraction says, made from a seeded hash of its key."""
    draw = draw_of(key, seed) / float(DRAWS)
    term = total = math.exp(-fraction)
    ends, k = [], 0
    while total < 1 - 1e-12 and k < 1000:
        ends.append(total)
        k += 1
        term *= fraction / k
        total += term
    copies = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= draw))
    return df.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).drop("_copy")


def split_train(df: DataFrame, key: list[str], held: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a seeded hash of the key."""
    draw = draw_of(key, seed) / float(DRAWS)
    return df.where(draw >= held), df.where(draw < held)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stacked_distinct(frames: list[DataFrame]) -> DataFrame:
    return stacked(frames).distinct()


def missing_members(spark, seen: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Members of lo..hi that are not seen."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", col).join(seen.select(F.col(col).cast("long").alias(col)).distinct(), col, "left_anti")


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def exploded_members(df: DataFrame, col: str, separator: str = "+") -> DataFrame:
    """One row a member of a separated list."""
    return df.withColumn(col, F.explode(F.split(col, "\\" + separator if separator in "+|.*?" else separator)))


def pivot_counts(df: DataFrame, row: str, col: str, values: list, prefix: str = "") -> DataFrame:
    """Counts in wide form with the listed columns, absent ones 0."""
    wide = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def with_names(df: DataFrame, key: str, names: DataFrame, name: str, default: str) -> DataFrame:
    """Codebook lookup (names: key, name) with a default."""
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def replaced(df: DataFrame, col: str, table: dict[str, str]) -> DataFrame:
    return df.replace(table, subset=[col])


def group_lists(df: DataFrame, key: str, col: str) -> DataFrame:
    """Sorted names of each key (a stack's files; a key's list is bounded by the stack's depth)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(col)).alias("names"))


def records_to_wide(df: DataFrame, key: str, value: str, order: str, keys: list[str]) -> DataFrame:
    """key/value lines to one row a record: the n-th occurrence of each key belongs to record n."""
    n = df.withColumn("record", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    return n.groupBy("record").pivot(key, keys).agg(F.first(value))


def realigned(left: DataFrame, right: DataFrame, layer: str, key: str) -> DataFrame:
    """Join within layers on ids without their '-suffix'."""
    bare = F.element_at(F.split(F.col(key), "-"), 1)
    return left.withColumn("_k", bare).join(right.withColumn("_k", bare).drop(key), [layer, "_k"]).drop("_k")


def split_by(df: DataFrame, hit: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where hit, all others, null included)."""
    return df.where(hit), df.where(~F.coalesce(hit, F.lit(False)))


def depth_of_stacks(files: DataFrame) -> DataFrame:
    """Depth (largest z + 1) of each stack, and the largest of all."""
    out = files.groupBy("cycle", "tile", "channel").agg((F.max("z") + 1).alias("depth"))
    return out.withColumn("max_depth", F.max("depth").over(Window.partitionBy(F.lit(0))))


def padded_stacks(planes: DataFrame, keys: list[str] = ("cycle", "tile", "channel")) -> DataFrame:
    """Stacks of equal depth: shallower ones begin with blank planes (null pixels), their own moved back."""
    depth = planes.groupBy(*keys).agg((F.max("z") + 1).alias("_d"))
    depth = depth.crossJoin(F.broadcast(depth.agg(F.max("_d").alias("_m")))).withColumn("_pad", F.col("_m") - F.col("_d"))
    moved = planes.join(depth.select(*keys, "_pad"), list(keys)).withColumn("z", (F.col("z") + F.col("_pad")).cast("int")).drop("_pad")
    blank = depth.where("_pad > 0").select(*keys, F.explode(F.sequence(F.lit(0), (F.col("_pad") - 1).cast("int"))).alias("z"))
    return moved.unionByName(blank, allowMissingColumns=True)


def pasted(pixels: DataFrame, positions: DataFrame, height: int, width: int, tile_height: int, tile_width: int, bleed: int = 20) -> DataFrame:
    """(y, x, value) of a mosaic of tiles laid over each other, the later one on top.

    pixels: tile, y, x, value; positions: tile, y0, x0, grid_r, grid_c. A tile loses its outer bleed pixels
    towards the inside of the grid, and what lies beyond the mosaic's border.
    """
    ends = positions.agg(F.min("grid_r").alias("r0"), F.max("grid_r").alias("r1"), F.min("grid_c").alias("c0"), F.max("grid_c").alias("c1"))
    at = positions.crossJoin(F.broadcast(ends))
    low = {"y": F.when(F.col("grid_r") > F.col("r0"), bleed).otherwise(0), "x": F.when(F.col("grid_c") > F.col("c0"), bleed).otherwise(0)}
    high = {"y": F.when(F.col("grid_r") < F.col("r1"), tile_height - bleed).otherwise(tile_height), "x": F.when(F.col("grid_c") < F.col("c1"), tile_width - bleed).otherwise(tile_width)}
    at = at.select("tile", "y0", "x0", "grid_r", "grid_c", *[e.alias(f"{n}_{d}") for n, ends in (("low", low), ("high", high)) for d, e in ends.items()])
    inside = (F.col("y") >= F.col("low_y")) & (F.col("y") < F.col("high_y")) & (F.col("x") >= F.col("low_x")) & (F.col("x") < F.col("high_x"))
    laid = pixels.join(at, "tile").where(inside).select((F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "value", F.struct("grid_r", "grid_c", "tile").alias("order"))
    return laid.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy("y", "x").agg(F.max_by("value", "order").alias("value"))


def odd_cycles(cycles: DataFrame, with_zero: bool = False) -> DataFrame:
    return cycles.where((F.col("cycle") % 2 == 1) | ((F.col("cycle") == 0) & F.lit(with_zero)))


def combinations(spark, n: int, parts: int, total: int) -> DataFrame:
    """Non-negative integers below n that add up to the total, in columns k0, k1, ..."""
    out = spark.range(n).select(F.col("id").cast("int").alias("k0"))
    for i in range(1, parts):
        out = out.crossJoin(spark.range(n).select(F.col("id").cast("int").alias(f"k{i}")))
    return out.where(sum((F.col(f"k{i}") for i in range(1, parts)), F.col("k0")) == total)


def common_members(frames: list[DataFrame], col: str) -> DataFrame:
    """Members of the column that all tables have."""
    out = frames[0].select(col)
    for f in frames[1:]:
        out = out.intersect(f.select(col))
    return out.distinct()


def combing_grid(tiles: DataFrame, columns: int) -> DataFrame:
    """Row and column of tile numbers (from 1) laid in combing order from the upper right."""
    n = F.col("tile") - 1
    row = F.floor(n / columns)
    along = n % columns
    return tiles.withColumns({"grid_r": row.cast("int"), "grid_c": F.when(row % 2 == 0, columns - 1 - along).otherwise(along).cast("int")})


def mosaic(pixels: DataFrame, mode: str = "overlay") -> DataFrame:
    """One value a mosaic pixel (y, x, value, order[, weight]): last tile, mean, or weighted mean."""
    if mode == "overlay":
        value = F.max_by("value", "order")
    elif mode == "average":
        value = F.avg("value")
    else:
        value = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
    return pixels.groupBy("y", "x").agg(value.alias("value"))


def blend_weight(y: Column, x: Column, h: int, w: int, alpha: float = 1.5) -> Column:
    """Weight of a tile pixel by its distance to the nearest edges."""
    dy, dx = F.least(y + 1, F.lit(h) - y), F.least(x + 1, F.lit(w) - x)
    return F.pow((dy * dx).cast("double"), F.lit(alpha))


def sampled_pixels(points: DataFrame, pixels: DataFrame, channels: list[str], too_bright: int | None = None) -> DataFrame:
    """Intensity of every channel at each point (pixels: channel, y, x, value), outside null."""
    value = F.when(F.col("value") > too_bright, 0).otherwise(F.col("value")) if too_bright else F.col("value")
    hit = points.select("y", "x").distinct().join(pixels.withColumn("value", value), ["y", "x"])
    wide = hit.groupBy("y", "x").pivot("channel", channels).agg(F.first("value"))
    return points.join(wide, ["y", "x"], "left")
