import numpy as np
import pytest

from mosaicq.functions import kernels as K
from mosaicq.operators import images as I
from mosaicq.sources import images as codec


def spot_image(at, shape=(48, 48), sigma=1.5, height=800.0, base=100.0):
    yy, xx = np.indices(shape)
    a = np.full(shape, base)
    for y, x in at:
        a += height * np.exp(-0.5 * (((yy - y) / sigma) ** 2 + ((xx - x) / sigma) ** 2))
    return a


def rows(spark, arrays, **cols):
    data = [(*[v[i] for v in cols.values()], *a.shape, a.astype("<u2").tobytes()) for i, a in enumerate(arrays)]
    names = ", ".join(f"{k} {'string' if isinstance(v[0], str) else 'int'}" for k, v in cols.items())
    return spark.createDataFrame(data, f"{names}, height int, width int, pixels binary")


def test_top_hat_and_peaks():
    a = spot_image([(12, 15), (30, 33)])
    hat = K.top_hat(a)
    assert hat.min() >= 0 and {tuple(p) for p in K.local_peaks(hat, 8 * hat.mean())} == {(12, 15), (30, 33)}
    spread = K.spread_maxima(hat, np.array([[12, 15]]))
    assert (spread[10:15, 13:18] == hat[12, 15]).all() and (spread > 0).sum() == 25
    assert np.isinf(K.signal_to_noise(np.array([[0.0, 1.0]]))).all()


def test_localisation():
    a = spot_image([(20.3, 24.7)]) - 100
    centre, total, ok = K.gaussian_mask(a, np.array([20, 25]), np.array([1.5, 1.5]))
    assert ok and np.allclose(centre, (20.3, 24.7), atol=0.1) and total == pytest.approx(800 * 2 * np.pi * 1.5**2, rel=0.05)
    fit = K.gaussian_fit(spot_image([(20.3, 24.7)]), np.array([20.0, 25.0]), np.array([2.0, 2.0]))
    assert np.allclose(fit["centre"], (20.3, 24.7), atol=0.01) and np.allclose(fit["sigma"], 1.5, atol=0.02)
    volume, background = K.rotated_gaussian_volume(spot_image([(20.3, 24.7)]))
    assert volume == pytest.approx(800 * 2 * np.pi * 1.5**2, rel=0.02) and background == pytest.approx(100, abs=2)
    assert K.rotated_gaussian_volume(np.ones((5, 5))) == (0.0, 0.0)


def test_registration():
    rng = np.random.default_rng(1)
    a = K.gaussian(rng.random((64, 64)) * 1000, 1.5)
    moved = K.fourier_shifted(a, np.array([3.25, -5.5])).astype(float)
    assert np.allclose(K.phase_shift(a, moved), (-3.25, 5.5), atol=0.06)
    whole, rest = K.split_shift(np.array([-3.25, 5.6]))
    assert whole.tolist() == [-3, 6] and np.allclose(rest, (-0.25, -0.4))
    big = K.gaussian(rng.random((120, 120)) * 1000, 1)
    assert K.stitch_translation(big[:80, :80], big[10:90, 30:110])[:2] == (10, 30)
    at = K.spanning_positions(3, [(0, 1, 0, 70, 0.9), (1, 2, 60, 0, 0.9), (0, 2, 5, 5, 0.1)])
    assert at == {0: (0, 0), 1: (0, 70), 2: (60, 70)}


def test_focus():
    rng = np.random.default_rng(2)
    sharp = rng.random((40, 40)) * 1000
    stack = np.array([K.gaussian(sharp, 3), sharp, K.gaussian(sharp, 3)])
    fused = K.fused_focus(stack)
    assert np.abs(fused - sharp).mean() < 0.4 * np.abs(stack.mean(0) - sharp).mean()


def test_segmentation_and_hull():
    assert K.labelled(np.array([[1, 0, 1], [1, 0, 1], [0, 0, 1]], bool)).max() == 2
    square = np.array([[0, 0], [0, 4], [4, 0], [4, 4]])
    grid = np.argwhere(np.ones((6, 6)))
    assert K.inside_hull(square, grid).sum() == 25
    cube = np.argwhere(np.ones((2, 2, 2))) * 4
    assert K.inside_hull(cube, np.argwhere(np.ones((6, 6, 6)))).sum() == 125


def test_codec_round_trip():
    a = np.arange(35, dtype=np.uint16).reshape(5, 7) * 1800
    (b,) = codec.decode_tiff(codec.encode_tiff(a))
    assert (a == b).all()


def test_image_operators(spark, tmp_path):
    a, b = spot_image([(12, 15)]), spot_image([(30, 33)])
    tiles = rows(spark, [a, b], tile=[1, 2])
    got = I.spots_of(tiles, ["tile"], threshold=300).collect()
    assert {(r.tile, r.y, r.x) for r in got} == {(1, 12, 15), (2, 30, 33)}
    loc = I.localised(tiles, ["tile"]).collect()
    assert {(r.tile, round(r.y_in_pix), round(r.x_in_pix)) for r in loc if r.integratedIntensity > 5000} == {(1, 12, 15), (2, 30, 33)}
    planes = rows(spark, [a, a, a], cycle=[1, 1, 1], tile=[1, 1, 1], channel=["cy3"] * 3, z=[0, 1, 2])
    assert I.focus_stacked(planes).count() == 1
    named = tiles.selectExpr("concat('t', tile, '.tif') as name", "height", "width", "pixels")
    from mosaicq.sources import sinks

    assert sinks.write_images(named, f"file://{tmp_path}/im").count() == 2
    back = codec.read_tiles(spark, f"file://{tmp_path}/im")
    assert back.count() == 2 and bytes(back.where("path like '%t1.tif'").first().pixels) == a.astype("<u2").tobytes()
    spark.dataSource.register(codec.TileSource)
    assert spark.read.format("tiles").option("path", f"file://{tmp_path}/im").load().count() == 2
    assert codec.to_pixels(tiles, ["tile"]).where("tile = 1 and y = 12 and x = 15").first().value == int(a[12, 15])
    cut = I.crops(tiles, spark.createDataFrame([(1, 12, 15), (2, 0, 0)], "tile int, y int, x int"), 3, ["tile"]).collect()
    assert {(r.height, r.width) for r in cut} == {(7, 7)}
    hull = I.hull_filled(spark.createDataFrame([(1, 0, 0), (1, 0, 4), (1, 4, 0), (1, 4, 4)], "label int, y int, x int"), dims=("y", "x"))
    assert hull.count() == 25


def test_registration_operator(spark):
    rng = np.random.default_rng(3)
    a = K.gaussian(rng.random((48, 48)) * 1000, 1.5)
    df = rows(spark, [a, K.fourier_shifted(a, np.array([4, -2]))], cycle=[1, 3], tile=[7, 7], channel=["cy3", "cy3"])
    offsets, moved = I.registered(df, 1, "cy3")
    row = offsets.first()
    assert (row.cycle, row.tile, row.dy, row.dx) == (3, 7, -4, 2) and moved.count() == 2


def test_curves_and_rendering():
    x = np.linspace(0, 10, 200)
    y = 3 * np.exp(-0.5 * ((x - 2) / 0.4) ** 2) + 1.5 * np.exp(-0.5 * ((x - 6) / 0.8) ** 2)
    (h1, a1, b1), (h2, a2, b2) = K.peak_intervals(x, y, [2.3, 5.5], z=1.0)
    assert np.allclose([h1, a1, b1, h2, a2, b2], [3, 1.6, 2.4, 1.5, 5.2, 6.8], atol=0.02)
    drawn = K.rendered(np.array([[3.0, 3.0], [50.0, 1.0]]), np.array([2.0, 1.0]), (8, 8))
    assert drawn[3, 3] == drawn[2, 3] == 1.0 and drawn[0, 0] == 0
    assert K.max_projection(np.arange(4)[:, None, None] * np.ones((4, 2, 2)), 1, 1).max() == 2
