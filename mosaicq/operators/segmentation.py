"""Cells of stained images of any size by a watershed that does not depend on how the image is cut.

An image is strips of whole rows. Every stage works strip by strip on what it needs of its neighbours' rows,
and what is global is a table: the ceiling of the threshold, objects across borders, the nearest background
above and below a strip, seeds, and the flood itself. Flooding from the highest pixel down is the maximum
spanning forest of the pixels' graph, rooted in the seeds, an edge being as high as its lower end; as all
edges differ (depth, then place), there is one such forest. Strips contract what surely belongs to it, each
pixel to its highest neighbour; rounds of joins and aggregates over the basins do the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.functions import kernels
from mosaicq.operators.graph import connected_components, spanning_forest
from mosaicq.operators.spatial import within
from mosaicq.workspace import broadcast_if_few, materialise

#: Decimals of a threshold: what rounding leaves would depend on nothing but noise.
_DECIMALS = 6


def _plane(raw: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width)


def _mapped(strips: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(row) gives a frame for every strip."""

    def run(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                yield f(r)

    return strips.mapInPandas(run, schema)


def _haloed(strips: DataFrame, planes: dict[str, str], rows: int, halo: int, height: int, f: Callable, schema: str) -> DataFrame:
    """f(image, top, core, planes) for strips of so many rows with a halo; core is the slice of the strip's own rows.

    Strips send what others need; a task joins one strip's rows.
    """
    last = -(-height // rows) - 1

    def cut(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                parts = {k: _plane(getattr(r, k), kind, r.width) for k, kind in planes.items()}
                n = len(next(iter(parts.values())))
                for s in range(max(0, (r.row0 - halo) // rows), min(last, (r.row0 + n - 1 + halo) // rows) + 1):
                    a, b = max(s * rows - halo, r.row0), min((s + 1) * rows + halo, r.row0 + n)
                    if a < b:
                        out.append((r.image, s, a, r.width, *(p[a - r.row0 : b - r.row0].tobytes() for p in parts.values())))
            yield pd.DataFrame(out, columns=["image", "strip", "top", "width", *planes])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("top")
        width, top, s = int(frame["width"].iloc[0]), int(frame["top"].iloc[0]), int(frame["strip"].iloc[0])
        whole = {k: np.concatenate([_plane(x, kind, width) for x in frame[k]]) for k, kind in planes.items()}
        return f(frame["image"].iloc[0], top, slice(s * rows - top, min((s + 1) * rows, height) - top), *whole.values())

    kinds = "image string, strip int, top int, width int" + "".join(f", {k} binary" for k in planes)
    return strips.select("image", "row0", "width", *planes).mapInPandas(cut, kinds).groupBy("image", "strip").applyInPandas(joined, schema)


def _strip(image: str, row0: int, width: int, **planes: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([{"image": image, "row0": row0, "width": width, **{k: np.ascontiguousarray(p).tobytes() for k, p in planes.items()}}])


_OF = "image string, row0 int, width int"


def thresholds(strips: DataFrame, rows: int, height: int, block: int, offset: float) -> DataFrame:
    """(image, row0, width, pixels, level): each pixel's Gaussian neighbourhood, edges mirrored, plus the offset."""
    kernel = kernels.gaussian_kernel((block - 1) / 6)
    reach = len(kernel) // 2

    def f(image, top, core, pixels):
        level = kernels.convolved(pixels.astype(float), kernel, above=reach - core.start, below=reach - (len(pixels) - core.stop))
        return _strip(image, top + core.start, pixels.shape[1], pixels=pixels[core], level=np.round(level + offset, _DECIMALS))

    return _haloed(strips, {"pixels": "<u2"}, rows, reach, height, f, f"{_OF}, pixels binary, level binary")


def ceilings(levels: DataFrame, q: float) -> DataFrame:
    """(image, ceiling): the exact q-quantile of an image's levels; counts by whole numbers first, then the values around it."""

    def bins(r):
        k, n = np.unique(np.floor(np.frombuffer(r.level, "<f8")).astype(np.int64), return_counts=True)
        return pd.DataFrame({"image": r.image, "bin": k, "n": n})

    counts = materialise(_mapped(levels.select("image", "level"), bins, "image string, bin long, n long").groupBy("image", "bin").agg(F.sum("n").alias("n")), "level-bins")
    by = Window.partitionBy("image").orderBy("bin")
    at = (F.sum("n").over(Window.partitionBy("image")) - 1) * q
    told = counts.withColumns({"to": F.sum("n").over(by), "at": at})
    near = told.where((F.col("to") > F.floor("at")) & (F.col("to") - F.col("n") <= F.ceil("at")))
    span = near.groupBy("image").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.min(F.col("to") - F.col("n")).alias("below"), F.max("at").alias("at"))

    def values(r):
        level = np.frombuffer(r.level, "<f8")
        v, n = np.unique(level[(level >= r.lo) & (level < r.hi + 1)], return_counts=True)
        return pd.DataFrame({"image": r.image, "below": r.below, "at": r.at, "v": v, "n": n})

    inside = _mapped(levels.select("image", "level").join(broadcast_if_few(span), "image"), values, "image string, below long, at double, v double, n long")
    inside = inside.groupBy("image", "below", "at", "v").agg(F.sum("n").alias("n"))
    to = F.col("below") + F.sum("n").over(Window.partitionBy("image").orderBy("v"))
    inside = inside.withColumn("to", to)

    def ranked(rank):
        return F.min(F.when(F.col("to") > rank, F.col("v")))

    low, high = ranked(F.floor("at")), ranked(F.ceil("at"))
    return inside.groupBy("image").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("ceiling"))


def masks(levels: DataFrame, ceiling: DataFrame, rows: int, height: int, dilate: int, erode: int) -> DataFrame:
    """(image, row0, width, mask): pixels above their level or the ceiling, dilated and eroded by discs; beyond the image is nothing."""

    def above(r):
        mask = np.frombuffer(r.pixels, "<u2") > np.minimum(np.frombuffer(r.level, "<f8"), r.ceiling)
        return _strip(r.image, r.row0, r.width, mask=mask.astype("u1"))

    def f(image, top, core, mask):
        closed = kernels.disc_filter(kernels.disc_filter(mask, dilate, True), erode, False)
        return _strip(image, top + core.start, mask.shape[1], mask=closed[core])

    plain = _mapped(levels.join(broadcast_if_few(ceiling), "image"), above, f"{_OF}, mask binary")
    return _haloed(plain, {"mask": "u1"}, rows, dilate + erode, height, f, f"{_OF}, mask binary")


def large_objects(masked: DataFrame, least: int) -> DataFrame:
    """(image, row0, width, mask) without the objects (touching sides) of fewer than so many pixels, whatever strips they cross."""

    def number(r):
        labels = kernels.labelled(_plane(r.mask, "u1", r.width) > 0)
        return _strip(r.image, r.row0, r.width, labels=labels.astype("<i4"))

    def areas(r):
        n = np.bincount(np.frombuffer(r.labels, "<i4"))
        at = np.flatnonzero(n)
        at = at[at > 0]
        return pd.DataFrame({"image": r.image, "row0": r.row0, "label": at, "n": n[at]})

    def edges(r):
        a = _plane(r.labels, "<i4", r.width)
        rows = [(r.row0 - 1, a[0], True), (r.row0 + len(a) - 1, a[-1], False)]  # named by the row above the border
        return pd.concat([pd.DataFrame({"image": r.image, "border": y, "x": np.flatnonzero(v), "row0": r.row0, "label": v[v > 0], "lower": low}) for y, v, low in rows])

    numbered = materialise(_mapped(masked, number, f"{_OF}, labels binary"), "object-labels")
    name = F.concat_ws(":", "image", "row0", "label")
    size = _mapped(numbered, areas, "image string, row0 int, label int, n long").withColumn("node", name)
    ends = materialise(_mapped(numbered, edges, "image string, border int, x int, row0 int, label int, lower boolean").select("image", "border", "x", name.alias("node"), "lower"), "object-borders")
    links = ends.where("lower").withColumnRenamed("node", "src").join(ends.where("not lower").withColumnRenamed("node", "dst"), ["image", "border", "x"]).select("src", "dst").distinct()
    size = size.join(connected_components(links), "node", "left").withColumn("whole", F.coalesce("component", "node"))
    size = materialise(size.select("image", "row0", "label", "n", "whole"), "object-sizes")
    small = size.groupBy("whole").agg(F.sum("n").alias("n")).where(F.col("n") < least)
    gone = size.drop("n").join(small, "whole").groupBy("image", "row0").agg(F.collect_list("label").alias("gone"))

    def kept(r):
        labels = _plane(r.labels, "<i4", r.width)
        away = np.zeros(labels.max() + 1, bool)
        away[[0, *([] if r.gone is None else r.gone)]] = True
        return _strip(r.image, r.row0, r.width, mask=(~away[labels]).astype("u1"))

    return _mapped(numbered.join(gone, ["image", "row0"], "left"), kept, f"{_OF}, mask binary")


def depths(masked: DataFrame, height: int, width: int) -> DataFrame:
    """(image, row0, width, mask, depth): exact squared Euclidean distance to the background, 0 outside the mask.

    Along columns the nearest background above and below a strip comes from the other strips; along rows the
    parabolas over these distances are laid side by side until no further one can be lower.
    """
    far = height + width

    def ends(r):
        empty = _plane(r.mask, "u1", r.width) == 0
        some = empty.any(0)
        first, last = r.row0 + empty.argmax(0), r.row0 + len(empty) - 1 - empty[::-1].argmax(0)
        return pd.DataFrame({"image": r.image, "row0": r.row0, "x": np.arange(r.width), "first": np.where(some, first, -1), "last": np.where(some, last, -1)})

    seen = _mapped(masked, ends, "image string, row0 int, x int, first long, last long")
    seen = seen.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("first", "last")})
    column = Window.partitionBy("image", "x").orderBy("row0")
    above = F.max("last").over(column.rowsBetween(Window.unboundedPreceding, -1))
    below = F.min("first").over(column.rowsBetween(1, Window.unboundedFollowing))
    beside = seen.select("image", "row0", "x", above.alias("above"), below.alias("below")).groupBy("image", "row0")
    beside = beside.agg(F.sort_array(F.collect_list(F.struct("x", F.coalesce("above", F.lit(-far)).alias("above"), F.coalesce("below", F.lit(height + far)).alias("below")))).alias("b"))
    beside = beside.select("image", "row0", F.col("b.above").alias("above"), F.col("b.below").alias("below"))

    def f(r):
        mask = _plane(r.mask, "u1", r.width) > 0
        depth = kernels.squared_depth(mask, r.row0 - np.asarray(r.above, np.int64), np.asarray(r.below, np.int64) - (r.row0 + len(mask) - 1), far)
        return _strip(r.image, r.row0, r.width, mask=mask.astype("u1"), depth=depth)

    return _mapped(masked.join(beside, ["image", "row0"]), f, f"{_OF}, mask binary, depth binary")


def basins(deep: DataFrame, rows: int, height: int, distance: int) -> DataFrame:
    """(image, row0, width, depth, peak, basin): seeds' pixels, and of each masked pixel the place where its climb ends.

    A peak is the deepest pixel within the distance, in both directions, and so far from the image's edge. A
    climb goes to the highest neighbour (depth, then the earlier place) and ends at peaks and where that
    neighbour is another strip's; places are y * width + x.
    """

    def f(image, top, core, depth):
        width = depth.shape[1]
        peak = kernels.peaks_within(depth, distance)
        y = top + np.arange(len(depth))
        peak[(y < distance) | (y >= height - distance)] = False
        basin = kernels.climbs(depth, peak, core) + np.int64(top) * width
        basin[depth == 0] = -1
        return _strip(image, top + core.start, width, depth=depth[core], peak=peak[core].astype("u1"), basin=basin[core])

    return _haloed(deep, {"depth": "<i8"}, rows, max(distance, 1), height, f, f"{_OF}, depth binary, peak binary, basin binary")


def _passes(found: DataFrame, rows: int, height: int) -> DataFrame:
    """(image, a, b, low, lowAt, high, highAt): the highest edge between each two basins that touch; places count negatively."""
    names = ["image", "a", "b", "low", "lowAt", "high", "highAt"]

    def f(image, top, core, depth, basin):
        width = depth.shape[1]
        place = (top + np.arange(len(depth)))[:, None] * np.int64(width) + np.arange(width)
        out = []
        for one, other in (((slice(core.start, core.stop), slice(None, -1)), (slice(core.start, core.stop), slice(1, None))), ((slice(core.start, min(core.stop, len(depth) - 1)), slice(None)), (slice(core.start + 1, min(core.stop, len(depth) - 1) + 1), slice(None)))):
            a, b = basin[one], basin[other]
            at = (a != b) & (a >= 0) & (b >= 0)
            d, e, p, q = depth[one][at], depth[other][at], -place[one][at], -place[other][at]
            swap = (d > e) | ((d == e) & (p > q))
            low, lp, high, hp = np.where(swap, e, d), np.where(swap, q, p), np.where(swap, d, e), np.where(swap, p, q)
            out.append(np.stack([np.minimum(a[at], b[at]), np.maximum(a[at], b[at]), low, lp, high, hp]))
        t = np.concatenate(out, axis=1)
        t = t[:, np.lexsort((-t[5], -t[4], -t[3], -t[2], t[1], t[0]))]
        first = np.ones(t.shape[1], bool)
        first[1:] = (t[:2, 1:] != t[:2, :-1]).any(0)
        return pd.DataFrame({"image": image, **dict(zip(names[1:], t[:, first]))}, columns=names)

    return _haloed(found, {"depth": "<i8", "basin": "<i8"}, rows, 1, height, f, "image string, " + ", ".join(f"{c} long" for c in names[1:]))


def _seeds(found: DataFrame, distance: int) -> DataFrame:
    """(node: image and place, seed: place): peaks of one depth that lie within the distance of each other are one seed."""

    def f(r):
        at = np.argwhere(_plane(r.peak, "u1", r.width) > 0)
        depth = _plane(r.depth, "<i8", r.width)[tuple(at.T)]
        return pd.DataFrame({"image": r.image, "y": at[:, 0] + r.row0, "x": at[:, 1], "depth": depth, "id": (at[:, 0] + r.row0) * np.int64(r.width) + at[:, 1]})

    peaks = materialise(_mapped(found.select("image", "row0", "width", "peak", "depth"), f, "image string, y long, x long, depth long, id long"), "image-peaks")
    pairs = within(peaks, peaks, ["y", "x"], distance * 1.4142136 + 1e-6)
    same = (F.col("l.image") == F.col("r.image")) & (F.col("l.depth") == F.col("r.depth")) & (F.abs(F.col("l.y") - F.col("r.y")) <= distance) & (F.abs(F.col("l.x") - F.col("r.x")) <= distance)
    node = F.struct("image", "id")
    links = pairs.where(same & (F.col("l.id") < F.col("r.id"))).select(F.struct("l.image", "l.id").alias("src"), F.struct("r.image", "r.id").alias("dst"))
    joined = peaks.select(node.alias("node")).join(connected_components(links), "node", "left")
    return joined.select("node", F.coalesce("component", "node").getField("id").alias("seed"))


def watershed_cells(strips: DataFrame, keys: list[str], height: int, width: int, rows: int = 512, block: int = 51, offset: float = 0.0, ceiling_q: float = 0.98, min_region: int = 20, dilate: int = 2, erode: int = 2, min_distance: int = 5, min_area: int = 20) -> DataFrame:
    """(keys, y, x, label) of the cells' pixels of images (keys, row0, height, width, pixels) cut into strips of whole rows.

    A cell's label is the place y * width + x of its first seed pixel; objects without a seed and cells below
    min_area are left out. rows is the number of rows a task holds, and changes nothing else.
    """
    image = F.to_json(F.struct(*keys))
    named = materialise(strips.select(image.alias("image"), *keys).distinct(), "image-names")
    raw = strips.select(image.alias("image"), F.col("row0").cast("int").alias("row0"), "width", "pixels")
    levels = materialise(thresholds(raw, rows, height, block, offset), "image-levels")
    mask = materialise(masks(levels, ceilings(levels, ceiling_q), rows, height, dilate, erode), "image-masks")
    mask = materialise(large_objects(mask, min_region), "image-objects")
    found = materialise(basins(depths(mask, height, width), rows, height, min_distance), "image-basins")
    edges = _passes(found, rows, height)
    order = F.struct("low", "lowAt", "high", "highAt")
    edges = edges.groupBy("image", "a", "b").agg(F.max(order).alias("weight"))
    edges = edges.select(F.struct("image", F.col("a").alias("id")).alias("src"), F.struct("image", F.col("b").alias("id")).alias("dst"), "weight")
    tree = spanning_forest(edges, _seeds(found, min_distance).withColumnRenamed("seed", "root"))

    def pixels(r):
        basin = _plane(r.basin, "<i8", r.width)
        at = np.argwhere(basin >= 0)
        return pd.DataFrame({"image": r.image, "y": (at[:, 0] + r.row0).astype(np.int32), "x": at[:, 1].astype(np.int32), "basin": basin[tuple(at.T)]})

    told = tree.select(F.col("node.image").alias("image"), F.col("node.id").alias("basin"), F.col("root").alias("label"))
    out = materialise(_mapped(found.select("image", "row0", "width", "basin"), pixels, "image string, y int, x int, basin long").join(told, ["image", "basin"]).select("image", "y", "x", "label"), "image-cells")
    large = out.groupBy("image", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_area)
    kept = out.join(large.select("image", "label"), ["image", "label"], "left_semi")
    return kept.join(broadcast_if_few(named), "image").select(*keys, "y", "x", "label")
