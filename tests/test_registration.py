"""Rigid registration: derivatives against differences, blocks against whole volumes, planted turns and shifts."""

import numpy as np

from mosaicq.functions import kernels as K
from mosaicq.operators import registration as R

SHAPE = (22, 44, 40)


def scene(points, seed=1):
    """Smooth blobs at any places of space."""
    rng = np.random.default_rng(seed)
    out = np.full(len(points), 200.0)
    for c, s, h in zip(rng.uniform(0, 1, (70, 3)) * SHAPE, rng.uniform(2, 5, 70), rng.uniform(500, 3000, 70)):
        out += h * np.exp(-((points - c) ** 2).sum(1) / (2 * s * s))
    return out


def volumes(angles, shift):
    """(fixed, moving, truth): the fixed one is the scene, the moving one is the scene seen so that truth takes places to it."""
    truth = R.Rigid((np.array(SHAPE) - 1) / 2, np.radians(angles), np.array(shift, float))
    grid = np.indices(SHAPE).reshape(3, -1).T.astype(float)
    back = (grid - truth.centre - truth.shift) @ truth.matrix() + truth.centre  # the inverse turn
    return np.rint(scene(grid)).reshape(SHAPE), np.rint(60000 / (1 + np.exp(-scene(back) / 1500)) - 29000).reshape(SHAPE), truth


def planes(spark, stacks):
    rows = [(k, z, *p.shape, p.astype("<u2").tobytes()) for k, a in stacks.items() for z, p in enumerate(a)]
    return spark.createDataFrame(rows, "tile int, z int, height int, width int, pixels binary").repartition(5)


def test_gradient_is_the_change_of_information():
    fixed, moving, _ = volumes((1, -2, 1.5), (0.5, 1, -1))
    t = R.Rigid((np.array(SHAPE) - 1) / 2, np.array([0.01, 0.02, -0.015]), np.array([0.3, -0.2, 0.4]))
    whole = (fixed, np.zeros(3, int), moving, np.zeros(3, int))
    span = (fixed.min(), fixed.max(), moving.min(), moving.max())
    _, g = R.mutual_information(R.joint_sums(*whole, t, span, 32))
    inner = (fixed[4:-4, 8:-8, 8:-8], np.array([4, 8, 8]), moving, np.zeros(3, int))  # no place leaves the volume
    _, g = R.mutual_information(R.joint_sums(*inner, t, span, 32))
    for k in range(6):
        e = np.eye(6)[k] * (1e-5 if k < 3 else 1e-4)
        up, down = (R.mutual_information(R.joint_sums(*inner, t.moved(d), span, 32))[0] for d in (e, -e))
        assert abs((up - down) / (2 * e[k]) - g[k]) < 0.02 * max(1e-3, abs(g[k])) + 1e-3 * np.abs(g).max()


def test_blocks_add_up_to_the_volume():
    fixed, moving, t = volumes((2, 1, -1), (1, -2, 3))
    span = (fixed.min(), fixed.max(), moving.min(), moving.max())
    want = R.joint_sums(fixed, np.zeros(3, int), moving, np.zeros(3, int), t, span, 20)
    got = sum(R.joint_sums(fixed[z : z + 8, y : y + 17], np.array([z, y, 0]), moving, np.zeros(3, int), t, span, 20) for z in range(0, 22, 8) for y in range(0, 44, 17))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_planted_turns_and_shifts_come_back(spark):
    planted = {1: ((3, -2, 1), (1.5, -4, 5)), 2: ((-1, 2.5, -3), (-2, 3, 0.5))}
    made = {k: volumes(*v) for k, v in planted.items()}
    fixed, moving = (planes(spark, {k: v[i] for k, v in made.items()}) for i in (0, 1))
    found = R.rigid_transforms(fixed, moving, ["tile"], side=24, margin=3.0, rounds=70)
    for k, (f, _, truth) in made.items():
        got = found[k,]
        assert np.abs(np.degrees(got.angles - truth.angles)).max() < 0.1 and np.abs(got.shift - truth.shift).max() < 0.2
    back = {(r.tile, r.z): np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width) for r in R.resampled(fixed, moving, ["tile"], found, side=24).collect()}
    assert len(back) == 2 * SHAPE[0]
    for k, (f, m, _) in made.items():
        inner = np.array([back[k, z] for z in range(SHAPE[0])])[6:-6, 8:-8, 8:-8].astype(float)
        want = 60000 / (1 + np.exp(-f / 1500)) - 29000
        assert np.abs(inner - want[6:-6, 8:-8, 8:-8]).mean() < 0.03 * np.ptp(want)


def test_a_key_without_its_moving_volume_is_left_out(spark):
    a = K.gaussian(np.random.default_rng(0).random((6, 12, 12)) * 900, 1)
    found = R.rigid_transforms(planes(spark, {1: a, 2: a}), planes(spark, {1: a}), ["tile"], rounds=2, side=8)
    assert set(found) == {(1,)}
