"""The hull in space against every plane through three corners that has all others on one side."""

import itertools

import numpy as np

from mosaicq.functions import kernels as K


def plain(corners, grid):
    ok = np.ones(len(grid), bool)
    for a, b, c in itertools.combinations(corners, 3):
        n = np.cross(b - a, c - a)
        side = (corners - a) @ n
        if n.any() and (side <= 0).all():
            ok &= (grid - a) @ n <= 0
        if n.any() and (side >= 0).all():
            ok &= (grid - a) @ n >= 0
    return ok


def turned(sides):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))
    at = np.array(list(itertools.product(*[(0, s) for s in sides]))) @ q.T
    return np.rint(at - at.min(0)).astype(int)


def test_hull_in_space_is_exact():
    rng = np.random.default_rng(1)
    solids = [turned((20, 20, 20)), turned((30, 30, 8)), *[rng.integers(0, 12, (n, 3)) for n in (4, 5, 9, 14)]]
    solids.append(np.array(list(itertools.product((0, 2, 4), repeat=3))))
    for corners in solids:
        grid = np.argwhere(np.ones(corners.max(0) + 2))
        want = plain(corners, grid)
        assert (K.inside_hull(corners, grid) == want).all()
        assert (K.inside_hull(grid[want], grid) == want).all()  # the solid's voxels as points
        assert (K.inside_hull(corners + 0.25, grid + 0.25) == want).all()


def test_flat_hulls():
    grid = np.argwhere(np.ones((6, 6, 6)))
    line, flat = np.array([[1, 1, 1], [3, 3, 3]]), np.array([[0, 0, 0], [0, 4, 4], [4, 0, 0], [4, 4, 4]])
    assert grid[K.inside_hull(line, grid)].tolist() == [[1, 1, 1], [2, 2, 2], [3, 3, 3]]
    assert K.inside_hull(flat, grid).sum() == 25 and K.inside_hull(line[:1], grid).sum() == 1 and not K.inside_hull(line[:0], grid).any()
