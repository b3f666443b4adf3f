"""Images cut into blocks give what whole images give; spots in space; stitching's repair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicq.functions import kernels as K
from mosaicq.operators import images, segmentation


def row(a):
    a = np.asarray(np.rint(a), "<u2")
    return a.shape[0], a.shape[1], a.tobytes()


def strips(spark, images_by_channel, rows=40):
    out = []
    for channel, a in images_by_channel.items():
        out += [(channel, r, *row(a[r : r + rows])) for r in range(0, a.shape[0], rows)]
    return spark.createDataFrame(out, "channel string, row0 int, height int, width int, pixels binary")


@pytest.fixture(scope="module")
def mosaic():
    rng = np.random.default_rng(5)
    out = {}
    for k, channel in enumerate(("r", "g")):
        a = rng.integers(90, 110, (150, 170)).astype(float)
        for y, x in zip(rng.integers(0, 150, 60), rng.integers(0, 170, 60)):
            a += 900 * K.point_spread(a.shape, np.array([y, x]), np.array([1.2, 1.2])) * (1 + k)
        out[channel] = np.minimum(a, 60000)
    return out


def test_blocks_hold_the_image(spark, mosaic):
    got = images.blocks(strips(spark, {"r": mosaic["r"]}, 37), ["channel"], 150, 170, 64, 9).collect()
    assert len(got) == 9
    for b in got:
        a = np.frombuffer(b.pixels, "<u2").reshape(b.height, b.width)
        y0, x0 = max(0, b.tile_y * 64 - 9), max(0, b.tile_x * 64 - 9)
        assert (b.top, b.left) == (y0, x0)
        assert (a == np.rint(mosaic["r"])[y0 : min(150, (b.tile_y + 1) * 64 + 9), x0 : min(170, (b.tile_x + 1) * 64 + 9)]).all()


def test_same_spots_however_the_image_is_cut(spark, mosaic):
    whole = {}
    for channel, a in mosaic.items():
        df = spark.createDataFrame([(channel, *row(a))], "channel string, height int, width int, pixels binary")
        whole[channel] = sorted((r.y, r.x, r.value, round(r.snr, 9)) for r in images.spots_of(df, ["channel"], threshold=300).collect())
    assert all(len(v) > 20 for v in whole.values())
    for side in (170, 85, 43, 22):  # 1, 4, 16 and more than 49 tiles
        got = images.tiled_spots(strips(spark, mosaic), ["channel"], 150, 170, side, threshold=300).collect()
        for channel in mosaic:
            assert sorted((r.y, r.x, r.value, round(r.snr, 9)) for r in got if r.channel == channel) == whole[channel]


def test_signals_of_all_channels(spark):
    rows = [("r", 10, 10, 50.0), ("g", 12, 8, 70.0), ("g", 13, 10, 5.0), ("r", 30, 30, 9.0), ("r", 33, 30, 8.0), ("g", 60, 60, 1.0)]
    got = images.signal_table(spark.createDataFrame(rows, "channel string, y int, x int, value double"), ["r", "g"]).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.r, r.g, r["sum"]) for r in got] == [(10, 10, 50.0, 70.0, 120.0), (12, 8, 50.0, 70.0, 120.0), (13, 10, 0.0, 70.0, 70.0), (30, 30, 9.0, 0.0, 9.0), (33, 30, 8.0, 0.0, 8.0), (60, 60, 0.0, 1.0, 1.0)]


def test_cells_across_seams_are_one(spark):
    a = np.full((120, 130), 50.0)
    centres = [(30, 60), (60, 64), (95, 20), (90, 110)]
    for y, x in centres:
        yy, xx = np.indices(a.shape)
        a[(yy - y) ** 2 + (xx - x) ** 2 <= 81] = 1000
    got = segmentation.watershed_cells(strips(spark, {"r": a}), ["channel"], 120, 130, rows=25, block=41, ceiling_q=1.0, min_area=30).collect()
    at = {(r.y, r.x): r.label for r in got}
    discs = [{at[y + p, x + q] for p in range(-8, 9) for q in range(-8, 9) if p * p + q * q <= 64} for y, x in centres]
    assert [len(d) for d in discs] == [1] * 4 and len(set.union(*discs)) == 4 and len(at) == len(got)


def test_point_spreads():
    for spread in K.SPREADS:
        sigma = np.array([2.0, 1.1, 1.1])
        a = K.point_spread((41, 31, 31), np.array([20, 15, 15]), sigma, spread)
        assert abs(a[20, 15, 15] - 1) < 1e-12 and abs(a.sum() - K.spread_total(sigma, spread)) < 1e-6


@pytest.mark.parametrize("method", list(images.METHODS))
@pytest.mark.parametrize("background", ["localPlane", "localMedian", "globalMedian"])
def test_spots_in_space_and_plane(spark, method, background):
    solid = images.METHODS[method][0]
    for spread in K.SPREADS if background == "localPlane" else K.SPREADS[:1]:
        sigma = np.array([1.8, 1.3, 1.3]) if solid else np.array([1.3, 1.3])
        points = [(9.3, 20.6, 14.2), (12.1, 40.3, 43.7)] if solid else [(20.6, 14.2), (40.3, 43.7)]
        a = np.full((22, 60, 60) if solid else (60, 60), 100.0)
        for p in points:
            a += 5000 * K.point_spread(a.shape, np.array(p), sigma, spread)
        planes = [(1, z, *row(p)) for z, p in enumerate(a)] if solid else [(1, *row(a))]
        df = spark.createDataFrame(planes, "tile int, " + "z int, " * solid + "height int, width int, pixels binary")
        got = images.localised(df, ["tile"], sigma=1.3, sigma_z=1.8, level=8 if solid else 3, method=method, background=background, spread=spread).collect()
        assert len(got) == 2
        for r, p in zip(sorted(got, key=lambda r: r.x_in_pix), points):
            assert abs(r.x_in_pix - p[-1]) < 0.1 and abs(r.y_in_pix - p[-2]) < 0.1
            assert not solid or abs(r.z_in_pix - p[0]) < (0.6 if method == "2DMaskOnLocalMaxProj" else 0.15)
            if method in ("3DMaskFull", "3DGaussianFit", "2DGaussianFit", "2DGaussianMask"):
                assert abs(r.integratedIntensity / (5000 * K.spread_total(sigma, spread)) - 1) < 0.1


def test_shared_candidates(spark):
    a = np.full((12, 40, 40), 100.0) + 4000 * K.point_spread((12, 40, 40), np.array([6, 20, 21]), np.array([1.5, 1.3, 1.3]))
    b = np.full((12, 40, 40), 100.0) + 400 * K.point_spread((12, 40, 40), np.array([6, 20, 21]), np.array([1.5, 1.3, 1.3]))
    rows = [(1, c, z, *row(p)) for c, s in (("a", a), ("b", b)) for z, p in enumerate(s)]
    df = spark.createDataFrame(rows, "tile int, channel string, z int, height int, width int, pixels binary")
    found = images.spot_candidates(df.where("channel = 'a'"), ["tile"], 1.3, 1.5, level=8)
    assert [(r.z, r.y, r.x) for r in found.collect()] == [(6, 20, 21)]
    got = {r.channel: r.integratedIntensity for r in images.localised(df, ["tile", "channel"], sigma=1.3, sigma_z=1.5, method="3DMaskFull", candidates=found, shared=["tile"]).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] / got["b"] - 10) < 0.5


def test_translations_are_repaired_and_climbed(spark):
    rng = np.random.default_rng(6)
    scene = K.gaussian(rng.random((120, 400)) * 4000, 1.5)
    steps = [(0, 0), (2, 70), (1, 141), (3, 210)]
    tiles = [(k, *row(scene[8 + y : 88 + y, x : x + 100])) for k, (y, x) in enumerate(steps)]
    tiles = spark.createDataFrame(tiles, "tile int, height int, width int, pixels binary")
    rows = [(0, 1, "beside", 0, 2, 70, 0.95), (1, 2, "beside", 0, -1, 71, 0.9), (2, 3, "beside", 0, 40, 3, 0.1)]
    fixed = images.repaired_translations(spark.createDataFrame(rows, "i int, j int, side string, line int, dy int, dx int, corr double"))
    got = {r.i: (r.dy, r.dx, r.valid) for r in fixed.collect()}
    assert got[0] == (2, 70, True) and got[2][2] is False and abs(got[2][1] - 70) <= 1
    climbed = {r.i: (r.dy, r.dx) for r in images.climbed_translations(tiles, fixed).collect()}
    assert climbed == {0: (2, 70), 1: (-1, 71), 2: (2, 69)}


def test_positions_of_a_grid(spark):
    """616 tiles whose translations don't agree: along the same spanning tree as one machine's, and components apart."""
    rng = np.random.default_rng(4)
    rows = []
    for r in range(22):
        for c in range(28):
            k = r * 28 + c
            rows += [(k, j, int(rng.integers(-9, 9)) + 90 * (j - k > 1), int(rng.integers(-9, 9)) + 100 * (j - k == 1), float(rng.integers(0, 50) / 50)) for j in ([k + 1] if c < 27 else []) + ([k + 28] if r < 21 else [])]
    kind = "i int, j int, dy int, dx int, corr double"
    want = K.spanning_positions(616, sorted(rows))
    got = {r.tile: (r.y0, r.x0) for r in images.tile_positions(spark.createDataFrame(rows, kind).repartition(5)).collect()}
    assert got == want
    two = [(1, 2, 5, 5, 0.9), (2, 1, 7, 7, 0.2), (8, 9, -3, 4, float("nan")), (9, 8, 3, -4, None)]
    assert {r.tile: (r.y0, r.x0) for r in images.tile_positions(spark.createDataFrame(two, kind)).collect()} == {1: (0, 0), 2: (5, 5), 8: (3, 0), 9: (0, 4)}
    assert images.tile_positions(spark.createDataFrame([], kind)).count() == 0
