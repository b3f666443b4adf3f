"""Selective and pairwise focus fusion against slow versions, pixel by pixel."""

import math

import numpy as np

from mosaicq.functions import kernels as K


def slow_fused(stack, window=9, alpha=0.2, trust=13.0, step=2):
    n, h, w = stack.shape
    half = window // 2
    clip = lambda v, top: min(max(v, 0), top - 1)
    around = lambda a, y, x: [a[clip(y + dy, h)][clip(x + dx, w)] for dy in range(-half, half + 1) for dx in range(-half, half + 1)]
    every = [(y, x) for y in range(h) for x in range(w)]

    def mean(a):
        return [[sum(around(a, y, x)) / window**2 for x in range(w)] for y in range(h)]

    sharp = []
    for p in stack.astype(float):
        m = mean(p.tolist())
        sharp.append(mean([[(p[y, x] - m[y][x]) ** 2 for x in range(w)] for y in range(h)]))
    rest, top = [[0.0] * w for _ in range(h)], [[0.0] * w for _ in range(h)]
    for y, x in every:
        f = [s[y][x] + 1e-12 for s in sharp]
        top[y][x] = max(f)
        best = f.index(max(f))
        mid = min(max(best, step), n - 1 - step)
        y2, y13 = math.log(f[mid]), math.log(f[mid + step] if best < step else f[mid - step])
        # A Gaussian through (mid - step, y13), (mid, y2), (mid + step, y13).
        for z in range(n):
            rest[y][x] += abs(f[z] - math.exp(min(700, y2 + (y13 - y2) * ((z - mid) / step) ** 2)))
        rest[y][x] /= n * top[y][x]
    ratio = [[20 * math.log10(1 / v) if v > 0 else math.inf for v in line] for line in mean(rest)]
    phi = [[0.5 * (1 + math.tanh(alpha * (v - trust))) / alpha for v in line] for line in ratio]
    out = np.zeros((h, w))
    for y, x in every:
        near = sorted(phi[v][u] if 0 <= v < h and 0 <= u < w else 0.0 for v in range(y - 1, y + 2) for u in range(x - 1, x + 2))
        weights = [0.5 + 0.5 * math.tanh(near[4] * ((s[y][x] + 1e-12) / top[y][x] - 1)) for s in sharp]
        out[y, x] = sum(a * float(p[y, x]) for a, p in zip(weights, stack)) / sum(weights)
    return out


def slow_pairwise(stack):
    h, w = stack[0].shape
    mirror = lambda v, n: -v if v < 0 else 2 * n - 2 - v if v >= n else v
    slope, smooth = (-1, -2, 0, 2, 1), (1, 4, 6, 4, 1)

    def edges(a):
        out = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                gx = gy = 0.0
                for i in range(5):
                    for j in range(5):
                        v = a[mirror(y + i - 2, h), mirror(x + j - 2, w)]
                        gx += smooth[i] * slope[j] * v
                        gy += slope[i] * smooth[j] * v
                out[y, x] = abs(gx) + abs(gy)
        return out

    image = stack[0] / 65535
    for plane in stack[1:] / 65535:
        d, new = edges(image) - edges(plane), np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                s = sum(d[v, u] for v in range(max(0, y - 1), min(h, y + 2)) for u in range(max(0, x - 1), min(w, x + 2)))
                k = 1 / (1 + math.exp(-0.1 * s))
                new[y, x] = k * image[y, x] + (1 - k) * plane[y, x]
        image = new
    return image * 65535


def blurred(planes=7, seed=3):
    """A slanted scene: left in focus in the first planes, right in the last; a flat band in the middle."""
    rng = np.random.default_rng(seed)
    scene = rng.random((26, 30)) * 20000 + 5000
    scene[10:17] = 9000
    depth = np.linspace(0, planes - 1, 30)
    out = []
    for z in range(planes):
        levels = np.array([K.gaussian(scene, s) if s else scene for s in (0, 0.7, 1.4, 2.1, 2.8, 3.5, 4.2)])
        out.append(np.take_along_axis(levels, np.minimum(np.abs(np.rint(depth) - z), 6).astype(int)[None, None].repeat(26, 1), 0)[0])
    return scene, np.rint(np.array(out))


def test_selective_fusion_equals_the_slow_version():
    scene, stack = blurred()
    for s in (stack, stack[:5], stack[::-1], np.full((6, 12, 11), 700.0)):
        assert np.allclose(K.fused_focus(s), slow_fused(s), rtol=1e-9)
    fused = K.fused_focus(stack)
    textured = np.r_[0:8, 19:26]
    assert np.abs(fused - scene)[textured].mean() < 0.5 * np.abs(stack.mean(0) - scene)[textured].mean()
    assert np.allclose(K.fused_focus(stack[:2]), stack[:2].mean(0)) and np.allclose(K.fused_focus(stack[:1]), stack[0])


def test_pairwise_fusion_equals_the_slow_version():
    _, stack = blurred()
    for s in (stack[:, :14, :13], np.full((3, 8, 9), 700.0)):
        assert np.allclose(K.pairwise_focus(s), slow_pairwise(s), rtol=1e-9)


def test_query_against_slow_versions(spark, sf_dir):
    from mosaicq.plans import readout

    stacks = {}
    for r in readout._stacks(spark, sf_dir).orderBy("channel", "z").collect():
        stacks.setdefault(r.channel, []).append(np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width))
    got = {(r.mode, r.channel, r.y, r.x): r.value for r in readout.focused_stacks(spark, sf_dir).collect()}
    assert len(got) == 2 * sum(s[0].size for s in stacks.values())
    for c, s in stacks.items():
        for mode, slow in (("fused", slow_fused), ("pairwise", slow_pairwise)):
            for (y, x), v in np.ndenumerate(slow(np.array(s, float))):
                assert abs(got[mode, c, y, x] - v) <= 0.5 + 1e-6
