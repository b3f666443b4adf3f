"""The watershed of strips against a plain one of the whole image, for any number of strips; spanning forests."""

import numpy as np

from mosaicq.functions import kernels as K
from mosaicq.operators import graph, segmentation


def plain_cells(a, block, offset, q, min_region, dilate, erode, m, min_area):
    """Whole image: direct sums, distances to every background pixel, union-find over all edges from the highest down."""
    h, w = a.shape
    sigma = (block - 1) / 6
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    wide = np.pad(a.astype(float), r, mode="symmetric")
    k2 = np.outer(k, k) / k.sum() ** 2
    level = np.array([[(wide[y : y + 2 * r + 1, x : x + 2 * r + 1] * k2).sum() for x in range(w)] for y in range(h)]) + offset
    level = np.round(level, 6)
    mask = a > np.minimum(level, np.quantile(level, q))

    def disc(mask, radius, any_):
        out = np.empty_like(mask)
        for y in range(h):
            for x in range(w):
                near = [mask[v, u] for v in range(max(0, y - radius), min(h, y + radius + 1)) for u in range(max(0, x - radius), min(w, x + radius + 1)) if (v - y) ** 2 + (u - x) ** 2 <= radius**2]
                out[y, x] = any(near) if any_ else all(near)
        return out

    mask = disc(disc(mask, dilate, True), erode, False)
    labels = K.labelled(mask)
    mask &= np.bincount(labels.ravel())[labels] >= min_region
    if not mask.any():
        return {}
    empty = np.argwhere(~mask)
    depth = np.zeros(a.shape, np.int64)
    for y, x in np.argwhere(mask):
        depth[y, x] = ((empty - (y, x)) ** 2).sum(1).min() if len(empty) else (h + w) ** 2
    peaks = [(y, x) for y, x in np.argwhere(mask) if m <= y < h - m and m <= x < w - m and depth[y, x] == depth[max(0, y - m) : y + m + 1, max(0, x - m) : x + m + 1].max()]
    parent = {(y, x): (y, x) for y, x in map(tuple, np.argwhere(mask))}

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    seed = {}
    for p in map(tuple, peaks):
        seed[p] = p[0] * w + p[1]
    for p in peaks:  # peaks of one depth near each other are one
        for s in peaks:
            if depth[tuple(p)] == depth[tuple(s)] and max(abs(p[0] - s[0]), abs(p[1] - s[1])) <= m:
                a_, b_ = find(tuple(p)), find(tuple(s))
                if a_ != b_:
                    parent[a_] = b_
    least = {}
    for p in seed:
        least[find(p)] = min(least.get(find(p), h * w), seed[p])
    key = lambda p: (depth[p], -(p[0] * w + p[1]))
    edges = [(p, n) for p in list(parent) for n in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if n in parent]
    for p, n in sorted(edges, key=lambda e: (min(map(key, e)), max(map(key, e))), reverse=True):
        a_, b_ = find(p), find(n)
        if a_ != b_ and not (a_ in least and b_ in least):
            if a_ in least:
                a_, b_ = b_, a_
            parent[a_] = b_
    out = {p: least[find(p)] for p in parent if find(p) in least}
    sizes = {}
    for v in out.values():
        sizes[v] = sizes.get(v, 0) + 1
    return {p: v for p, v in out.items() if sizes[v] >= min_area}


def strips(spark, images, rows):
    out = []
    for name, a in images.items():
        out += [(name, r, *a[r : r + rows].shape, a[r : r + rows].astype("<u2").tobytes()) for r in range(0, a.shape[0], rows)]
    return spark.createDataFrame(out, "channel string, row0 int, height int, width int, pixels binary")


def blobs(h, w, n, seed):
    """Cells of all sizes, some over the edge, some touching; noise that makes flat places uneven."""
    rng = np.random.default_rng(seed)
    a = rng.integers(40, 60, (h, w)).astype(float)
    yy, xx = np.indices(a.shape)
    for y, x, s in zip(rng.uniform(-2, h + 2, n), rng.uniform(-2, w + 2, n), rng.uniform(2, 6, n)):
        a += rng.uniform(300, 900) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))
    return np.rint(a)


def test_same_cells_however_the_image_is_cut(spark):
    images = {"dense": blobs(64, 56, 22, 1), "sparse": blobs(64, 56, 5, 2), "flat": np.full((64, 56), 70.0)}
    options = dict(block=21, offset=3.0, ceiling_q=0.9, min_region=12, dilate=2, erode=2, min_distance=3, min_area=15)
    want = {(c, y, x): v for c, a in images.items() for (y, x), v in plain_cells(a, 21, 3.0, 0.9, 12, 2, 2, 3, 15).items()}
    assert len({(c, v) for (c, _, _), v in want.items()}) > 10
    for side, given in ((64, 64), (16, 7), (4, 64), (1, 10)):  # 1, 4, 16 and 64 strips
        got = segmentation.watershed_cells(strips(spark, images, given), ["channel"], 64, 56, rows=side, **options).collect()
        assert len(got) == len(want) and {(r.channel, r.y, r.x): r.label for r in got} == want


def test_distances_are_exact():
    rng = np.random.default_rng(3)
    for density in (0.1, 0.5, 0.97):
        mask = rng.random((30, 41)) < density
        far = 71
        empty = np.argwhere(~mask)
        want = np.array([[((empty - (y, x)) ** 2).sum(1).min() for x in range(41)] for y in range(30)])
        assert (K.squared_depth(mask, np.full(41, far), np.full(41, far), far) == want).all()


def test_spanning_forest(spark):
    rng = np.random.default_rng(7)
    n = 60
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08]
    weight = rng.permutation(len(pairs))
    roots = {3: 3, 17: 17, 40: 40}
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    tops = dict(roots)
    for (i, j), _ in sorted(zip(pairs, weight), key=lambda e: -e[1]):
        a, b = find(i), find(j)
        if a != b and not (a in tops and b in tops):
            if a in tops:
                a, b = b, a
            parent[a] = b
    want = {i: tops[find(i)] for i in range(n) if find(i) in tops}
    edges = spark.createDataFrame([(*p, int(w)) for p, w in zip(pairs, weight)], "src int, dst int, weight int")
    got = graph.spanning_forest(edges, spark.createDataFrame(list(roots.items()), "node int, root int"))
    assert {r.node: r.root for r in got.collect()} == want


def test_query_against_plain_cells(spark, sf_dir):
    from mosaicq.plans import readout

    o = readout.CELLS
    want = {}
    for r in readout._images(spark, sf_dir).collect():
        a = np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width)
        want |= {(r.channel, y, x): v for (y, x), v in plain_cells(a, o["block"], o["offset"], 0.98, o["min_region"], o["dilate"], o["erode"], o["min_distance"], o["min_area"]).items()}
    got = readout.segmented_tiles(spark, sf_dir).collect()
    assert want and len(got) == len(want) and {(r.channel, r.y, r.x): r.label for r in got} == want
