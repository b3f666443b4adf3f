"""Relational envelopes of the image kernels: what is a row, a group and a column of the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.functions import kernels
from mosaicq.operators.spatial import suppress_within, within
from mosaicq.operators.stats import exact_quantile
from mosaicq.sources.images import to_array
from mosaicq.workspace import materialise

_TILE = "height int, width int, pixels binary"


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _column(value, n: int) -> np.ndarray:
    """One value n times, texts as plain objects."""
    return np.full(n, value, dtype=object if isinstance(value, str) else None)


def _packed(image: np.ndarray) -> dict:
    out = np.clip(np.rint(image), 0, 65535).astype("<u2")
    return {"height": out.shape[0], "width": out.shape[1], "pixels": out.tobytes()}


#: Ways to one image of a stack: weighted by sharpness, plane by plane, by the sharpest plane, the largest value, the mean.
FOCUS = {"fused": kernels.fused_focus, "pairwise": kernels.pairwise_focus, "sharpest": kernels.sharpest, "max": lambda stack: stack.max(0), "mean": lambda stack: stack.mean(0)}


def focus_stacked(planes: DataFrame, keys=("cycle", "tile", "channel"), mode: str = "fused") -> DataFrame:
    """One all-in-focus image a stack (a stack's planes are one task's memory, as one stack must be); mode is one of FOCUS."""
    keys, merge = list(keys), FOCUS[mode]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("z")
        stack = np.array([to_array(*r) for r in zip(rows["pixels"], rows["height"], rows["width"])])
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, **_packed(merge(stack))}])

    return planes.groupBy(*keys).applyInPandas(run, f"{_kinds(planes, keys)}, {_TILE}")


def per_image(images: DataFrame, f, keep: list[str]) -> DataFrame:
    """Images mapped one by one: f(array, row) returns an array."""

    def run(batches):
        for frame in batches:
            rows = [{**{k: getattr(r, k) for k in keep}, **_packed(f(to_array(r.pixels, r.height, r.width), r))} for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keep, "height", "width", "pixels"])

    return images.mapInPandas(run, f"{_kinds(images, keep)}, {_TILE}")


#: The side to which each channel's chromatic scale takes a tile of 2304 pixels.
CHROMATIC_SIDES = {"cy3": 2302, "TxRed": 2303, "FAM": 2301, "DAPI": 2300}


def chromatic_resized(images: DataFrame, keep=("cycle", "tile", "channel"), side: int = 2304) -> DataFrame:
    """Each channel scaled to its own size, then centred on the common one."""

    def run(a: np.ndarray, row) -> np.ndarray:
        new = CHROMATIC_SIDES.get(row.channel)
        if new is None:
            return a
        size = tuple(max(1, round(n * new / side)) for n in a.shape)
        return kernels.centred_on(kernels.resized(a, size), a.shape)

    return per_image(images, run, list(keep))


#: Fixed value: places of an image, about, at which its illumination is fitted.
ILLUMINATION_PLACES = 9400


def working_size(height: int, width: int, places: int = ILLUMINATION_PLACES) -> tuple[int, int]:
    """The size of an image scaled down to about so many places; smaller ones keep theirs."""
    scale = min(1.0, (places / (height * width)) ** 0.5)
    return max(1, round(height * scale)), max(1, round(width * scale))


def illumination_models(images: DataFrame, keys=("cycle", "channel"), places: int = ILLUMINATION_PLACES, strip_rows: int = 4, rounds: int = 500) -> DataFrame:
    """(keys, m_height, gain, offset as float32) over all tiles of a cycle and channel.

    Tiles are scaled down and cut into strips where they are; a task sorts one strip of all tiles and keeps
    STANDARD_QUANTILES quantiles, so that the fit of a model, one task, holds places * quantiles numbers
    however many tiles there are. The fitted surfaces are scaled up to the tiles' size.
    """
    keys = list(keys)

    def cut(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                a = kernels.resized(to_array(r.pixels, r.height, r.width), working_size(r.height, r.width, places))
                rows += [(*(getattr(r, k) for k in keys), r.height, r.width, y, a.shape[1], a[y : y + strip_rows].astype("<f4").tobytes()) for y in range(0, len(a), strip_rows)]
            yield pd.DataFrame(rows, columns=[*keys, "height", "width", "row0", "across", "part"])

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        stack = np.array([np.frombuffer(x, "<f4").reshape(-1, first["across"]) for x in frame["part"]])
        order = kernels.order_statistics(stack)
        return pd.DataFrame([{**{k: first[k] for k in [*keys, "height", "width", "row0", "across"]}, "tiles": len(stack), "part": order.astype("<f8").tobytes()}])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("row0")
        first, n = rows.iloc[0], min(int(rows["tiles"].iloc[0]), kernels.STANDARD_QUANTILES)
        order = np.concatenate([np.frombuffer(x, "<f8").reshape(n, -1, first["across"]) for x in rows["part"]], axis=1)
        size = int(first["height"]), int(first["width"])
        gain, offset = (kernels.resized(x, size).astype("<f4").tobytes() for x in kernels.fitted_illumination(order, int(first["tiles"]), rounds))
        return pd.DataFrame([{**{k: first[k] for k in keys}, "m_height": size[0], "gain": gain, "offset": offset}])

    kinds = _kinds(images, keys)
    of = f"{kinds}, height int, width int, row0 int, across int"
    strips = images.select(*keys, "height", "width", "pixels").mapInPandas(cut, f"{of}, part binary")
    orders = strips.groupBy(*keys, "row0").applyInPandas(ordered, f"{of}, tiles int, part binary")
    return orders.groupBy(*keys).applyInPandas(fitted, f"{kinds}, m_height int, gain binary, offset binary")


def illumination_corrected(images: DataFrame, models: DataFrame, keep=("cycle", "tile", "channel"), keys=("cycle", "channel"), mode: str = "zero") -> DataFrame:
    def run(a: np.ndarray, row) -> np.ndarray:
        gain, offset = (np.frombuffer(x, "<f4").reshape(a.shape) for x in (row.gain, row.offset))
        return kernels.illumination_corrected(a.astype(float), gain, offset, mode)

    return per_image(images.join(models, list(keys)), run, list(keep))


def registered(images: DataFrame, reference_cycle: int, reference_channel: str, upsample: int = 100) -> tuple[DataFrame, DataFrame]:
    """(offsets: cycle, tile, dy, dx; images moved by the fractional rest), all channels by one channel's shift."""
    one = images.where(F.col("channel") == reference_channel)
    ref = one.where(F.col("cycle") == reference_cycle).select("tile", F.col("pixels").alias("ref"))
    pairs = one.where(F.col("cycle") != reference_cycle).join(ref, "tile")

    def shifts(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                s = kernels.phase_shift(to_array(r.ref, r.height, r.width).astype(float), to_array(r.pixels, r.height, r.width).astype(float), upsample)
                whole, rest = kernels.split_shift(s)
                rows.append((r.cycle, r.tile, int(whole[0]), int(whole[1]), float(rest[0]), float(rest[1])))
            yield pd.DataFrame(rows, columns=["cycle", "tile", "dy", "dx", "ry", "rx"])

    found = pairs.select("cycle", "tile", "height", "width", "pixels", "ref").mapInPandas(shifts, "cycle int, tile int, dy int, dx int, ry double, rx double")
    moved = images.join(found.select("cycle", "tile", "ry", "rx"), ["cycle", "tile"], "left").na.fill(0.0, ["ry", "rx"])
    return found.select("cycle", "tile", "dy", "dx"), per_image(moved, lambda a, r: kernels.fourier_shifted(a, np.array([r.ry, r.rx])) if r.ry or r.rx else a, ["cycle", "tile", "channel"])


def tile_translations(tiles: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(i, j, dy, dx, corr) of neighbouring tiles (tile, height, width, pixels) by phase correlation."""
    a = tiles.select(F.col("tile").alias("i"), "height", "width", F.col("pixels").alias("p"))
    b = tiles.select(F.col("tile").alias("j"), F.col("pixels").alias("q"))

    def run(batches):
        for frame in batches:
            rows = [(r.i, r.j, *kernels.stitch_translation(to_array(r.p, r.height, r.width), to_array(r.q, r.height, r.width))) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["i", "j", "dy", "dx", "corr"])

    return neighbours.join(a, "i").join(b, "j").select("i", "j", "height", "width", "p", "q").mapInPandas(run, "i int, j int, dy int, dx int, corr double")


def repaired_translations(translations: DataFrame, least: float = 0.5, slack: int = 10) -> DataFrame:
    """Translations (i, j, side, line, dy, dx, corr) whose weak or odd ones take the median of their line, else of their side.

    side tells neighbours beside from those below, line the row or column of tiles; a translation is valid
    with a correlation of at least least and at most slack pixels from the median of its side.
    """
    strong = translations.where(F.col("corr") >= least)
    mid = {c: exact_quantile(strong, c, 0.5, ["side"]).withColumnRenamed("value", f"m_{c}") for c in ("dy", "dx")}
    told = translations.join(mid["dy"], "side", "left").join(mid["dx"], "side", "left")
    valid = (F.col("corr") >= least) & (F.abs(F.col("dy") - F.col("m_dy")) <= slack) & (F.abs(F.col("dx") - F.col("m_dx")) <= slack)
    told = materialise(told.withColumn("valid", F.coalesce(valid, F.lit(False))), "translations")
    for c in ("dy", "dx"):
        of_line = exact_quantile(told.where("valid"), c, 0.5, ["side", "line"]).withColumnRenamed("value", f"l_{c}")
        told = told.join(of_line, ["side", "line"], "left")
    fixed = {c: F.when(F.col("valid"), F.col(c)).otherwise(F.coalesce(F.rint(f"l_{c}"), F.rint(f"m_{c}"), F.col(c)).cast("int")) for c in ("dy", "dx")}
    return told.select("i", "j", "side", "line", fixed["dy"].alias("dy"), fixed["dx"].alias("dx"), "corr", "valid")


def climbed_translations(tiles: DataFrame, translations: DataFrame) -> DataFrame:
    """(i, j, dy, dx, corr): every translation moved uphill on the correlation of its two tiles."""
    a = tiles.select(F.col("tile").alias("i"), "height", "width", F.col("pixels").alias("p"))
    b = tiles.select(F.col("tile").alias("j"), F.col("pixels").alias("q"))

    def run(batches):
        for frame in batches:
            rows = [(r.i, r.j, *kernels.climbed_translation(to_array(r.p, r.height, r.width).astype(float), to_array(r.q, r.height, r.width).astype(float), int(r.dy), int(r.dx))) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["i", "j", "dy", "dx", "corr"])

    joined = translations.select("i", "j", "dy", "dx").join(a, "i").join(b, "j")
    return joined.mapInPandas(run, "i int, j int, dy int, dx int, corr double")


def tile_positions(translations: DataFrame) -> DataFrame:
    """(tile, y0, x0) along the maximum spanning forest of translations (i, j, dy, dx, corr), each component from (0, 0).

    In a round every tree takes its strongest edge out (ties: the lesser tiles), trees that hang together
    become one, and their tiles' places are counted from the leading tree's first tile: rounds are as many as
    the logarithm of the number of tiles, whatever the grid. Translations without a correlation count least.
    """
    strength = F.when(F.isnan("corr"), None).otherwise(F.col("corr"))
    pair = F.struct(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).alias("pair")
    turned = F.when(F.col("i") <= F.col("j"), 1).otherwise(-1)
    one = translations.where("i <> j").select(pair, F.struct(F.coalesce(strength, F.lit(float("-inf"))).alias("corr"), (turned * F.col("dy")).alias("dy"), (turned * F.col("dx")).alias("dx")).alias("t"))
    one = one.groupBy("pair").agg(F.max("t").alias("t")).select("pair.i", "pair.j", "t.corr", "t.dy", "t.dx")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "corr", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx")))
    both = materialise(both, "tile-edges")
    trees = materialise(both.select(F.col("i").alias("tile")).distinct().select("tile", F.col("tile").alias("tree"), F.lit(0).alias("y"), F.lit(0).alias("x")), "tile-trees")
    while True:
        a = trees.select(F.col("tile").alias("i"), F.col("tree").alias("ti"), F.col("y").alias("yi"), F.col("x").alias("xi"))
        b = trees.select(F.col("tile").alias("j"), F.col("tree").alias("tj"), F.col("y").alias("yj"), F.col("x").alias("xj"))
        out = both.join(a, "i").join(b, "j").where("ti <> tj")
        rank = F.struct("corr", (-F.least("i", "j")).alias("a"), (-F.greatest("i", "j")).alias("b"))
        step = F.struct(F.col("tj").alias("to"), (F.col("yj") - F.col("dy") - F.col("yi")).cast("int").alias("y"), (F.col("xj") - F.col("dx") - F.col("xi")).cast("int").alias("x"))
        best = out.groupBy(F.col("ti").alias("tree")).agg(F.max(F.struct(rank.alias("rank"), step.alias("step"))).alias("m")).select("tree", "m.step.*")
        best = materialise(best, "tile-steps")
        if best.isEmpty():
            break
        back = best.select(F.col("tree").alias("to"), F.col("to").alias("_back"))
        leads = (F.col("_back") == F.col("tree")) & (F.col("tree") < F.col("to"))
        chain = best.join(back, "to", "left").select("tree", F.when(leads, F.col("tree")).otherwise(F.col("to")).alias("to"), *[F.when(leads, 0).otherwise(F.col(c)).alias(c) for c in ("y", "x")])
        more = True
        while more:
            jump = chain.select(F.col("tree").alias("to"), F.col("to").alias("_on"), F.col("y").alias("_y"), F.col("x").alias("_x"))
            further = chain.join(jump, "to").select("tree", F.col("_on").alias("to"), (F.col("y") + F.col("_y")).alias("y"), (F.col("x") + F.col("_x")).alias("x"), (F.col("_on") != F.col("to")).alias("_more"))
            further = materialise(further, "tile-chains")
            more, chain = not further.where("_more").isEmpty(), further.drop("_more")
        moved = chain.select("tree", "to", F.col("y").alias("_y"), F.col("x").alias("_x"))
        trees = materialise(trees.join(moved, "tree").select("tile", F.col("to").alias("tree"), (F.col("y") + F.col("_y")).alias("y"), (F.col("x") + F.col("_x")).alias("x")), "tile-trees")
    least = trees.groupBy("tree").agg(F.min("y").alias("_y"), F.min("x").alias("_x"))
    return trees.join(least, "tree").select(F.col("tile").cast("int").alias("tile"), (F.col("y") - F.col("_y")).cast("int").alias("y0"), (F.col("x") - F.col("_x")).cast("int").alias("x0"))


def spots_of(images: DataFrame, keys: list[str], threshold: float = 0.0, times_mean: float = 8.0, hat: int = 7, distance: int = 2) -> DataFrame:
    """(keys, y, x, value, snr): peaks of the top-hat above min(threshold, times_mean * its mean)."""

    def run(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                a = to_array(r.pixels, r.height, r.width).astype(float)
                t = kernels.top_hat(a, (hat, hat))
                limit = min(threshold, times_mean * t.mean()) if threshold else times_mean * t.mean()
                at = kernels.local_peaks(t, limit, distance)
                snr = kernels.signal_to_noise(a)
                yield pd.DataFrame({**{k: _column(getattr(r, k), len(at)) for k in keys}, "y": at[:, 0].astype(np.int32), "x": at[:, 1].astype(np.int32), "value": t[tuple(at.T)], "snr": snr[tuple(at.T)]})

    return images.select(*keys, "height", "width", "pixels").mapInPandas(run, f"{_kinds(images, keys)}, y int, x int, value double, snr double")


#: Fit methods by the names of their users: whether they work in space, and how.
METHODS = {
    "3DMaskFull": (True, "mask"), "3DGaussianFit": (True, "fit"), "2DMaskOnLocalMaxProj": (True, "projection"),
    "2DGaussianMask": (False, "mask"), "2DGaussianFit": (False, "fit"), "mask": (False, "mask"), "fit": (False, "fit"),
}
BACKGROUNDS = {"localPlane": "plane", "localMedian": "median", "globalMedian": "global", "plane": "plane", "median": "median", "global": "global"}


def _candidates(a: np.ndarray, sigma: np.ndarray, level: float, units: str, most: int | None) -> np.ndarray:
    smooth = kernels.band_pass(a, tuple(sigma), tuple(2 * sigma))
    return kernels.isolated_maxima(smooth, kernels.detection_threshold(a, smooth, level, units), most)


def _fitted(a: np.ndarray, at: np.ndarray, sigma: np.ndarray, how: str, background: str, spread: str) -> tuple | None:
    """(centre, integrated intensity, residual) of the spot at a pixel; None if there is none."""
    middle = np.median(a) if background == "global" else None
    reach = np.ceil(3 * sigma).astype(int) + 2
    lo = np.maximum(at - reach, 0)
    crop, at = a[tuple(slice(p, q) for p, q in zip(lo, at + reach + 1))], at - lo
    inside = (np.abs(np.indices(crop.shape) - at.reshape(-1, *(1,) * crop.ndim)) <= np.ceil(2 * sigma).reshape(-1, *(1,) * crop.ndim)).all(0)
    if background == "global":
        flat = crop - middle
    elif background == "plane" and (~inside).sum() > crop.ndim + 1:
        flat = kernels.plane_background(crop, inside)
    else:
        flat = kernels.median_background(crop, inside if (~inside).any() else None)
    if how == "fit":
        fit = kernels.gaussian_fit(flat, at, sigma, spread)
        centre, total, residual, ok = fit["centre"], fit["integrated"], fit["residual"], True
    else:
        if how == "projection":
            flat = kernels.max_projection(flat, int(at[0]), int(np.ceil(2 * sigma[0])))
            centre, total, ok = kernels.gaussian_mask(flat, at[1:], sigma[1:], spread=spread)
            centre = np.concatenate([at[:1], centre])
        else:
            centre, total, ok = kernels.gaussian_mask(flat, at, sigma, spread=spread)
        d = flat.ndim
        model = total / kernels.spread_total(sigma[-d:], spread) * kernels.point_spread(flat.shape, centre[-d:], sigma[-d:], spread)
        residual = float(((flat - model) ** 2).sum()) if ok else 0.0
    return (lo + centre, total, residual) if ok and total > 0 else None


def _stacks(images: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f(array, keys' values) for every image, or for every stack if there is a column z (a stack is one task's memory)."""
    if "z" not in images.columns:
        return _planes(images.select(*keys, "height", "width", "pixels"), keys, f, schema)

    def stacked(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("z")
        return f(np.array([to_array(*r) for r in zip(rows["pixels"], rows["height"], rows["width"])], float), [frame[k].iloc[0] for k in keys])

    return images.select(*keys, "z", "height", "width", "pixels").groupBy(*keys).applyInPandas(stacked, schema)


def _widths(solid: bool, sigma: float, sigma_z: float | None) -> np.ndarray:
    return np.array([sigma if sigma_z is None else sigma_z, sigma, sigma] if solid else [sigma, sigma], float)


def spot_candidates(images: DataFrame, keys: list[str], sigma: float = 1.5, sigma_z: float | None = None, level: float = 3.0, units: str = "SD", most: int | None = None) -> DataFrame:
    """(keys, z of stacks, y, x) of the isolated maxima above the threshold; most keeps the brightest of an image, by default all."""
    solid = "z" in images.columns
    dims = ["z", "y", "x"] if solid else ["y", "x"]

    def run(a: np.ndarray, values: list) -> pd.DataFrame:
        at = _candidates(a, _widths(solid, sigma, sigma_z), level, units, most)
        return pd.DataFrame({**{k: _column(v, len(at)) for k, v in zip(keys, values)}, **{d: at[:, i].astype(np.int32) for i, d in enumerate(dims)}})

    return _stacks(images, keys, run, _kinds(images, keys) + "".join(f", {d} int" for d in dims))


def localised(images: DataFrame, keys: list[str], sigma: float = 1.5, level: float = 3.0, units: str = "SD", method: str = "mask", background: str = "plane", most: int | None = None, sigma_z: float | None = None, spread: str = "gaussian", candidates: DataFrame | None = None, shared: list[str] = ()) -> DataFrame:
    """Sub-pixel spots of images, or of stacks (a column z): maxima of the band pass, background removed, mask or fit; positive ones only.

    method is one of METHODS, background one of BACKGROUNDS, spread one of kernels.SPREADS. Methods of the
    plane take each plane of a stack by itself if z is among the keys. candidates (shared, [z,] y, x) replace
    the maxima: those of the same shared keys, for every channel, say. An image's candidates travel as one list.
    """
    solid, how = METHODS[method]
    dims = ["z", "y", "x"] if solid else ["y", "x"]
    ground, widths = BACKGROUNDS[background], _widths(solid, sigma, sigma_z)
    if solid and "z" not in images.columns:
        raise ValueError(f"{method} needs stacks: planes with a column z")
    names = ["x_in_pix", "y_in_pix", *(["z_in_pix"] if solid else []), "integratedIntensity", "residuals"]
    schema = _kinds(images, keys) + "".join(f", {c} double" for c in names)

    def run(a: np.ndarray, values: list, places=None) -> pd.DataFrame:
        at = _candidates(a, widths, level, units, most) if places is None else places
        found = [_fitted(a, np.array(p), widths, how, ground, spread) for p in at]
        return pd.DataFrame([(*values, *map(float, c[::-1]), float(total), float(rest)) for c, total, rest in filter(None, found)], columns=[*keys, *names])

    planes = images if solid else images.select(*keys, "height", "width", "pixels")
    if candidates is None:
        return _stacks(planes, keys, run, schema) if solid else _planes(planes, keys, run, schema)
    lists = candidates.groupBy(*shared).agg(F.sort_array(F.collect_list(F.struct(*dims))).alias("places"))
    joined = planes.join(lists, list(shared))

    def listed(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("z") if solid else frame
        a = np.array([to_array(*r) for r in zip(rows["pixels"], rows["height"], rows["width"])], float)
        places = [tuple(p[d] for d in dims) for p in rows["places"].iloc[0]]
        return run(a if solid else a[0], [frame[k].iloc[0] for k in keys], places)

    return joined.groupBy(*keys).applyInPandas(listed, schema)


def _planes(images: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f(array, keys' values) for every row."""

    def run(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                yield f(to_array(r.pixels, r.height, r.width).astype(float), [getattr(r, k) for k in keys])

    return images.mapInPandas(run, schema)


def blocks(strips: DataFrame, keys: list[str], height: int, width: int, side: int, halo: int) -> DataFrame:
    """(keys, tile_y, tile_x, top, left, height, width, pixels): squares of the side with a halo, cut at the image's edge.

    strips (keys, row0, height, width, pixels) are whole rows of an image from row0 on; an image of any
    size is as many strips as its rows of bytes allow. Strips are cut where they are, a task joins one block.
    """
    ny, nx = -(-height // side), -(-width // side)

    def cut(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                a = to_array(r.pixels, r.height, r.width)
                for ty in range(max(0, (r.row0 - halo) // side), min(ny - 1, (r.row0 + r.height - 1 + halo) // side) + 1):
                    top, end = max(ty * side - halo, r.row0, 0), min((ty + 1) * side + halo, r.row0 + r.height, height)
                    for tx in range(nx):
                        left, right = max(tx * side - halo, 0), min((tx + 1) * side + halo, width)
                        if top < end:
                            rows.append({**{k: getattr(r, k) for k in keys}, "tile_y": ty, "tile_x": tx, "top": top, "left": left, **_packed(a[top - r.row0 : end - r.row0, left:right])})
            yield pd.DataFrame(rows, columns=[*keys, "tile_y", "tile_x", "top", "left", "height", "width", "pixels"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("top")
        a = np.concatenate([to_array(*r) for r in zip(rows["pixels"], rows["height"], rows["width"])])
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in [*keys, "tile_y", "tile_x", "top", "left"]}, **_packed(a)}])

    schema = f"{_kinds(strips, keys)}, tile_y int, tile_x int, top int, left int, {_TILE}"
    pieces = strips.select(*keys, "row0", "height", "width", "pixels").mapInPandas(cut, schema)
    return pieces.groupBy(*keys, "tile_y", "tile_x").applyInPandas(joined, schema)


def tiled_spots(strips: DataFrame, keys: list[str], height: int, width: int, side: int = 2048, threshold: float = 0.0, times_mean: float = 8.0, hat: int = 7, distance: int = 2) -> DataFrame:
    """spots_of for images of any size: the same spots however the image is cut.

    Blocks overlap by what the filters reach, the threshold comes from the whole image's mean (a first pass
    over the blocks), and a spot belongs to the block whose core holds it.
    """
    halo = max(2 * (hat // 2) + distance, 5)
    cells = materialise(blocks(strips, keys, height, width, side, halo), "image-blocks")

    def core(r, a: np.ndarray) -> tuple[slice, slice]:
        y, x = r.tile_y * side - r.top, r.tile_x * side - r.left
        return slice(y, y + side), slice(x, x + side)

    def sums(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                t = kernels.top_hat(to_array(r.pixels, r.height, r.width).astype(float), (hat, hat))
                rows.append((*(getattr(r, k) for k in keys), float(t[core(r, t)].sum())))
            yield pd.DataFrame(rows, columns=[*keys, "total"])

    total = cells.mapInPandas(sums, f"{_kinds(strips, keys)}, total double").groupBy(*keys).agg((F.sum("total") / (height * width) * times_mean).alias("limit"))
    total = total.withColumn("limit", F.least("limit", F.lit(float(threshold)))) if threshold else total

    def peaks(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                a = to_array(r.pixels, r.height, r.width).astype(float)
                t = kernels.top_hat(a, (hat, hat))
                at = kernels.local_peaks(t, r.limit, distance)
                ys, xs = core(r, t)
                at = at[(at[:, 0] >= ys.start) & (at[:, 0] < ys.stop) & (at[:, 1] >= xs.start) & (at[:, 1] < xs.stop)]
                snr = kernels.signal_to_noise(a)
                yield pd.DataFrame({**{k: _column(getattr(r, k), len(at)) for k in keys}, "y": (at[:, 0] + r.top).astype(np.int32), "x": (at[:, 1] + r.left).astype(np.int32), "value": t[tuple(at.T)], "snr": snr[tuple(at.T)]})

    return cells.join(total, keys).mapInPandas(peaks, f"{_kinds(strips, keys)}, y int, x int, value double, snr double")


def signal_table(spots: DataFrame, channels: list[str], reach: int = 2, radius: float = 2.0) -> DataFrame:
    """(id, y, x, every channel, sum) from spots (channel, y, x, value): one row a place, the brightest within the radius.

    A channel's value is its largest spot at most reach pixels away in either direction, else 0.
    """
    at = spots.select("y", "x").distinct().withColumn("id", F.col("y").cast("long") * 10_000_000 + F.col("x"))
    near = within(at, spots.select("channel", "y", "x", "value"), ["y", "x"], reach * 1.4142136 + 1e-6)
    square = (F.abs(F.col("l.y") - F.col("r.y")) <= reach) & (F.abs(F.col("l.x") - F.col("r.x")) <= reach)
    wide = near.where(square).groupBy(F.col("l.id").alias("id"), F.col("l.y").alias("y"), F.col("l.x").alias("x")).pivot("r.channel", channels).agg(F.max("r.value")).na.fill(0.0)
    return suppress_within(wide.withColumn("sum", sum((F.col(f"`{c}`") for c in channels[1:]), F.col(f"`{channels[0]}`"))), radius)


def hull_filled(voxels: DataFrame, dims=("z", "y", "x")) -> DataFrame:
    """(label, dims) of all voxels inside the convex hull of each label's voxels (one label is one task's memory)."""
    dims = list(dims)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pts = frame[dims].to_numpy()
        lo, hi = pts.min(0), pts.max(0)
        grid = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(lo, hi)], indexing="ij"), -1).reshape(-1, len(dims))
        kept = grid[kernels.inside_hull(pts, grid)]
        return pd.DataFrame({"label": frame["label"].iloc[0], **{d: kept[:, k].astype(np.int32) for k, d in enumerate(dims)}})

    return voxels.groupBy("label").applyInPandas(run, _kinds(voxels, ["label"]) + "".join(f", {d} int" for d in dims))


#: Side of the squares into which images are cut for their crops.
CROP_SIDE = 1024


def crops(images: DataFrame, centres: DataFrame, half: int, keys: list[str], side: int = CROP_SIDE, once: bool = False) -> DataFrame:
    """(keys, y, x, height, width, pixels) of the square around each centre, zeros beyond the border.

    Images are cut once into squares with a margin of half; a task crops around the centres of one square.
    Centres beyond the image count to the nearest square. Equal centres are cut once; their rows are
    repeated after or, with once, are one row that says how many times.
    """
    kinds = _kinds(images, keys)

    def cut(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                a = to_array(r.pixels, r.height, r.width)
                for by in range(-(-r.height // side)):
                    rows = []
                    for bx in range(-(-r.width // side)):
                        top, left = max(0, by * side - half), max(0, bx * side - half)
                        rows.append({**{k: getattr(r, k) for k in keys}, "by": by, "bx": bx, "top": top, "left": left, **_packed(a[top : (by + 1) * side + half, left : (bx + 1) * side + half])})
                    yield pd.DataFrame(rows, columns=[*keys, "by", "bx", "top", "left", "height", "width", "pixels"])

    def around(points: pd.DataFrame, squares: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in squares.itertuples(index=False):
            a = to_array(s.pixels, s.height, s.width)
            for p in points.itertuples(index=False):
                out = np.zeros((2 * half + 1, 2 * half + 1), a.dtype)
                y, x = p.y - half - s.top, p.x - half - s.left
                part = a[max(y, 0) : max(y + 2 * half + 1, 0), max(x, 0) : max(x + 2 * half + 1, 0)]
                out[max(-y, 0) : max(-y, 0) + part.shape[0], max(-x, 0) : max(-x, 0) + part.shape[1]] = part
                rows.append({**{k: getattr(p, k) for k in keys}, "y": p.y, "x": p.x, "times": p.times, **_packed(out)})
        return pd.DataFrame(rows, columns=[*keys, "y", "x", "times", "height", "width", "pixels"])

    squares = images.select(*keys, "height", "width", "pixels").mapInPandas(cut, f"{kinds}, by int, bx int, top int, left int, {_TILE}")
    sizes = images.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w"))
    points = centres.groupBy(*keys, "y", "x").agg(F.count("*").alias("times")).join(sizes, keys)
    by, bx = (F.floor(F.greatest(F.least(F.col(c), F.col(n) - 1), F.lit(0)) / side).cast("int") for c, n in (("y", "_h"), ("x", "_w")))
    points = points.select(*keys, "y", "x", "times", by.alias("by"), bx.alias("bx"))
    both = points.groupBy(*keys, "by", "bx").cogroup(squares.groupBy(*keys, "by", "bx"))
    found = both.applyInPandas(around, f"{kinds}, {_kinds(centres, ['y', 'x'])}, times long, {_TILE}")
    return found if once else found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
