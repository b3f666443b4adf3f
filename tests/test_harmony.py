"""Batch integration against a plain version that holds all memberships, and on planted batches and clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicq.operators import harmony as H


def planted(n=240, seed=2):
    """Three clusters in two batches; the second batch is shifted, each cluster a little differently."""
    rng = np.random.default_rng(seed)
    centres = np.array([[6, 0, 0, 0], [0, 6, 0, 0], [0, 0, 6, 0]], float)
    kind, batch = rng.integers(0, 3, n), (rng.random(n) < 0.4).astype(int)
    z = centres[kind] + rng.normal(0, 0.5, (n, 4)) + batch[:, None] * (np.array([0.5, 0.5, 0.5, 3.0]) + 0.5 * centres[kind][:, ::-1] / 6)
    return z, kind, batch


def plain(z, batch, block, s, sample):
    """One array of memberships for all cells, updated block by block."""
    shares = np.bincount(batch) / len(batch)
    y = H.first_centres(sample, s.clusters)
    now, last = z.copy(), None
    phi = np.eye(batch.max() + 1)[batch]
    for _ in range(s.corrections):
        u = now / np.linalg.norm(now, axis=1)[:, None]
        r = np.exp(-2 * (1 - u @ y.T) / s.sigma)
        r /= r.sum(1)[:, None]
        for _ in range(s.rounds):
            y = r.T @ u
            y /= np.linalg.norm(y, axis=1)[:, None]
            for b in sorted(set(block)):
                rest = r[block != b].T @ phi[block != b]
                expected = np.outer(rest.sum(1), shares)
                pen = (((expected + 1) / (rest + 1)) ** s.theta)[:, batch[block == b]].T
                new = np.exp(-2 * (1 - u[block == b] @ y.T) / s.sigma) * pen
                r[block == b] = new / new.sum(1)[:, None]
        o = r.T @ phi
        e = np.outer(o.sum(1), shares)
        cost = (r * 2 * (1 - u @ y.T)).sum() + s.sigma * (r * np.log(np.maximum(r, 1e-300))).sum() + s.sigma * s.theta * (o * np.log((o + 1) / (e + 1))).sum()
        now = z.copy()
        design = np.c_[np.ones(len(z)), phi]
        for k in range(len(y)):
            a = design.T @ (design * r[:, k : k + 1]) + np.diag([0.0] + [s.ridge] * phi.shape[1])
            w = np.linalg.solve(a, design.T @ (z * r[:, k : k + 1]))
            w[0] = 0
            now -= r[:, k : k + 1] * (design @ w)
        if last is not None and abs(last - cost) <= s.tolerance * abs(last):
            break
        last = cost
    return now


@pytest.fixture(scope="module")
def cells(spark):
    z, kind, batch = planted()
    df = spark.createDataFrame([(i, "ab"[b], [float(x) for x in v]) for i, (v, b) in enumerate(zip(z, batch))], "id long, batch string, pcs array<double>")
    return df, z, kind, batch


def mixing(z, kind, batch, k=10):
    """(share of a cell's neighbours from the other batch, share of its neighbours of its own kind)."""
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    return (batch[near] != batch[:, None]).mean(), (kind[near] == kind[:, None]).mean()


def test_equals_the_plain_version(spark, cells):
    df, z, kind, batch = cells
    s = H.Settings(clusters=5, corrections=2, rounds=2, blocks=3)
    got = np.array([r.integrated for r in H.integrated(df, settings=s).orderBy("id").collect()])
    block = np.array([r[0] for r in df.orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(3))).collect()])
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(1)), "id").select("id").collect()]
    assert np.allclose(got, plain(z, batch, block, s, z[order]), atol=1e-8)
    before, after = mixing(z, kind, batch), mixing(got, kind, batch)
    assert before[0] < 0.1 and after[0] > 0.35 and after[1] > 0.98


def test_rows_without_vector_or_batch(spark, cells):
    df = cells[0].limit(30).unionByName(spark.createDataFrame([(900, None, [1.0] * 4), (901, "a", None)], cells[0].schema))
    s = H.Settings(clusters=2, corrections=1, rounds=1, blocks=2)
    got = {r.id: r.integrated for r in H.integrated(df, settings=s).collect()}
    assert len(got) == 32 and got[900] is None and got[901] is None and sum(v is not None for v in got.values()) == 30
    assert H.integrated(df.where("id > 1000"), settings=s).count() == 0
    with pytest.raises(ValueError):
        H.integrated(df, settings=H.Settings(clusters=10**8))


def test_query_against_the_plain_version(spark, sf_dir):
    from mosaicq.plans import catalog

    s = catalog.INTEGRATION
    rows = catalog._batches(spark, sf_dir).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(s.blocks))).orderBy("vec_id").collect()
    sample = [r.pcs for r in catalog._batches(spark, sf_dir).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(H.SAMPLE_ROWS).collect()]
    want = plain(np.array([r.pcs for r in rows]), np.array([int(r.batch[1:]) for r in rows]), np.array([r.block for r in rows]), s, np.array(sample))
    got = catalog.integrated_cells(spark, sf_dir).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [r.vec_id for r in rows] and np.allclose([r.integrated for r in got], want, atol=1e-5)
