"""Kernel densities against plain sums over all rows; draws of any key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicq.operators import spatial, stats, tables


def plain(x, at):
    width = x.std(0, ddof=1) * len(x) ** (-1 / (x.shape[1] + 4))
    u = (at[:, None] - x[None]) / width
    return (np.exp(-(u * u).sum(2) / 2).sum(1)) / (width * np.sqrt(2 * np.pi)).prod() / len(x)


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal((6, -3), 0.3, (300, 2))])
    return np.concatenate([x, x[:50], x[:50]])


@pytest.mark.parametrize("axes", [1, 2])
def test_density_at_own_and_other_points(spark, drawn, axes):
    x = drawn[:, :axes]
    cols = ["a", "b"][:axes]
    df = spark.createDataFrame(x.tolist(), cols)
    at = np.concatenate([x, np.full((1, axes), 500.0)])
    grid = spark.createDataFrame(at.tolist() + at[:5].tolist(), cols)
    got = {tuple(r)[:axes]: r.density for r in stats.kde(df, cols, grid).collect()}
    want = plain(x, at)
    assert len(got) == len({tuple(p) for p in at.tolist()})
    assert all(abs(got[tuple(p)] - d) <= 1e-12 + 1e-9 * d for p, d in zip(at.tolist(), want)) and got[(500.0,) * axes] == 0
    near = {tuple(r)[:axes]: r.density for r in stats.kde(df, cols, grid, steps=16).collect()}
    top = 1 / (x.std(0, ddof=1) * len(x) ** (-1 / (axes + 4)) * np.sqrt(2 * np.pi)).prod()
    assert all(abs(near[tuple(p)] - d) <= axes / (8 * 16**2) * top for p, d in zip(at.tolist(), want))


def test_density_of_few_rows(spark):
    grid = spark.createDataFrame([(0.0,), (1.0,)], ["a"])
    for rows in ([], [(1.0,)]):
        got = stats.kde(spark.createDataFrame(rows, "a double"), ["a"], grid).collect()
        assert sorted(r.a for r in got) == [0, 1] and all(r.density is None for r in got)
    some = spark.createDataFrame([(1.0,), (None,), (2.0,)], "a double")
    assert all(r.density > 0 for r in stats.kde(some, ["a"], grid).collect())


def test_draws_hold_for_any_partitioning_and_null_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), (F.col("id") % 3).alias("g"))
    a = tables.sample_rows(df.repartition(7), 50, ["k", "g"], seed=3).collect()
    assert sorted(a, key=str) == sorted(tables.sample_rows(df.coalesce(1), 50, ["k", "g"], seed=3).collect(), key=str) and len(a) == 50
    told = df.select(tables.draw_of(["k", "g"], 1).alias("d"))
    assert told.where((F.col("d") < 0) | (F.col("d") >= tables.DRAWS) | F.col("d").isNull()).isEmpty()
    assert abs(told.agg(F.avg(F.col("d") / float(tables.DRAWS))).first()[0] - 0.5) < 0.1


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted((r.src, r.dst) for r in spatial.knn(df, 2).collect()) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError, match="2 to 3"):
        spatial.knn(df.union(spark.createDataFrame([(5, [1.0, 2.0, 3.0])], df.schema)), 2)
    assert spatial.knn(df.limit(0), 2).count() == 0
