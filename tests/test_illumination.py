"""The regularised illumination fit: planted surfaces, its gradient, and strips against whole images."""

import numpy as np

from mosaicq.functions import kernels as K
from mosaicq.operators import images

H, W, OFFSET = 48, 40, 120.0
_Y, _X = np.indices((H, W))
GAIN = 1.2 - 0.8 * (((_Y - 20) / H) ** 2 + ((_X - 25) / W) ** 2)
GAIN /= np.median(GAIN)


def planted(n, outliers, seed=1):
    """Tiles of grainy brightness under GAIN and OFFSET; outliers have a bright spot that the light doesn't explain."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        t = OFFSET + GAIN * rng.uniform(200, 1500) * rng.gamma(60, 1 / 60, (H, W))
        if k < outliers:
            t = t + rng.uniform(3000, 9000) * np.exp(-((_Y - rng.uniform(0, H)) ** 2 + (_X - rng.uniform(0, W)) ** 2) / 200)
        out.append(t)
    return np.array(out)


def plain_slope(tiles, smooth):
    """Least squares of sorted values over their mean, then a blur."""
    order = np.sort(tiles, axis=0)
    typical = order.mean((1, 2))
    slope = K.gaussian(np.tensordot(typical - typical.mean(), order, 1), smooth)
    return slope / np.median(slope)


def test_planted_light_comes_back():
    for outliers in (0, 20):
        tiles = planted(200, outliers)
        v, z = K.illumination_model(tiles)
        assert np.abs(v / np.median(v) / GAIN - 1).mean() < 0.02
        assert abs(z.mean() - OFFSET) < 0.02 * 1300 and z.std() < 15
    assert all(np.abs(plain_slope(tiles, s) / GAIN - 1).mean() > 0.04 for s in (1, 3, 10, 20))
    for mode in ("zero", "range", "direct"):
        flat = K.illumination_corrected(OFFSET + GAIN * 700, v, z, mode)
        assert flat.std() / flat.mean() < 0.03 < (OFFSET + GAIN * 700).std() / (OFFSET + GAIN * 700).mean()


def test_exposure_does_not_matter():
    tiles = planted(60, 6)
    (v, z), (v2, z2) = K.illumination_model(tiles, 60), K.illumination_model(tiles * 4, 60)
    assert np.allclose(v, v2, rtol=1e-3) and np.allclose(4 * z, z2, rtol=1e-2, atol=1)


def test_quasi_newton_finds_the_minimum():
    def valley(x):
        a, b = x[1:] - x[:-1] ** 2, 1 - x[:-1]
        g = np.zeros_like(x)
        g[:-1] = -400 * x[:-1] * a - 2 * b
        g[1:] += 200 * a
        return float((100 * a**2 + b**2).sum()), g

    assert np.allclose(K.quasi_newton(valley, np.zeros(8), 500, tolerance=0.0), 1, atol=1e-4)


def test_quantiles_are_bounded():
    stack = np.random.default_rng(0).random((1000, 3, 4))
    got = K.order_statistics(stack)
    assert got.shape == (200, 3, 4) and np.allclose(got, np.quantile(stack, np.linspace(0, 1, 200), axis=0))


def test_strips_and_tiles_give_one_model(spark):
    tiles = np.rint(planted(40, 4)).astype("<u2")
    rows = [(c, "x", t, H, W, a.tobytes()) for c in (1, 2) for t, a in enumerate(tiles[: 41 - c])]
    df = spark.createDataFrame(rows, "cycle int, channel string, tile int, height int, width int, pixels binary").repartition(5)
    for places, strip_rows in ((9400, 4), (9400, 48), (500, 3)):
        got = {r.cycle: r for r in images.illumination_models(df, places=places, strip_rows=strip_rows, rounds=30).collect()}
        for c in (1, 2):
            size = images.working_size(H, W, places)
            small = np.array([K.resized(a, size).astype("<f4") for a in tiles[: 41 - c]])
            gain, offset = (K.resized(x, (H, W)) for x in K.illumination_model(small, 30))
            assert size == (H, W) or size[0] * size[1] < 600
            assert got[c].m_height == H and np.allclose(np.frombuffer(got[c].gain, "<f4").reshape(H, W), gain, rtol=1e-4) and np.allclose(np.frombuffer(got[c].offset, "<f4").reshape(H, W), offset, rtol=1e-3, atol=1e-1)
    fixed = images.illumination_corrected(df.where("tile < 2"), images.illumination_models(df, rounds=30))
    assert fixed.count() == 4


def test_query_against_plain_fits(spark, sf_dir):
    from mosaicq.plans import readout

    stacks = {}
    for r in readout._light_tiles(spark, sf_dir).collect():
        stacks.setdefault(r.channel, []).append(np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width))
    got = {(r.channel, r.y, r.x): (r.gain, r.offset) for r in readout.illumination_surfaces(spark, sf_dir).collect()}
    assert len(got) == sum(s[0].size for s in stacks.values())
    for c, s in stacks.items():
        gain, offset = K.illumination_model(np.array(s, "<f4"), readout.LIGHT_ROUNDS)
        for (y, x), v in np.ndenumerate(gain):
            assert abs(got[c, y, x][0] - v) < 1e-3 * max(1, v) and abs(got[c, y, x][1] - offset[y, x]) < 0.5
