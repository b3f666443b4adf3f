"""The layout of neighbour graphs against a plain sequential version, whole and in blocks."""

import math
import random

import numpy as np
import pytest

from mosaicq.operators import cells, communities, layout, spatial


def test_curve():
    a, b = layout.curve(0.5, 1.0)
    assert abs(a - 0.583) < 2e-3 and abs(b - 1.334) < 2e-3
    a, b = layout.curve(0.1, 1.0)
    assert abs(a - 1.577) < 5e-3 and abs(b - 0.895) < 2e-3


def plain(edges, start, epochs, a, b, seed=0):
    """One edge after the other; both ends of an edge move, its negatives push the first."""
    rng = random.Random(seed)
    at = {k: list(v) for k, v in start.items()}
    most = max(w for *_, w in edges)
    ids = sorted(at)
    cut = lambda v: max(-4.0, min(4.0, v))
    for e in range(epochs):
        rate = 1 - e / epochs
        for i, j, w in edges:
            if rng.random() >= w / most:
                continue
            d = [p - q for p, q in zip(at[i], at[j])]
            d2 = d[0] ** 2 + d[1] ** 2
            if d2 > 0:
                g = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
                for k in (0, 1):
                    at[i][k] += rate * cut(g * d[k])
            for _ in range(5):
                j = rng.choice(ids)
                d = [p - q for p, q in zip(at[i], at[j])]
                d2 = d[0] ** 2 + d[1] ** 2
                if d2 > 0:
                    g = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
                    for k in (0, 1):
                        at[i][k] += rate * cut(g * d[k])
    return at


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 300")
    near = communities.fuzzy_weights(spatial.knn(e, 15, "vec_id", "embedding"))
    pcs = cells.principal_components(e.selectExpr("vec_id", "embedding AS v"), 2).collect()
    start = {r.vec_id: (r.pcs[0], r.pcs[1]) for r in pcs}
    edges = [(r.src, r.dst, r.weight) for r in near.collect()]
    vectors = {r.vec_id: r.embedding for r in e.collect()}
    return edges, start, vectors


@pytest.mark.parametrize("block_nodes", [1000, 80])
def test_as_trustworthy_as_the_plain_version(spark, graph, block_nodes):
    edges, start, vectors = graph
    a, b = layout.curve()
    ids = sorted(start)
    far = max(abs(v) for p in start.values() for v in p)
    want = plain(sorted(edges), {k: [v * 10 / far for v in p] for k, p in start.items()}, 60, a, b)
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(4)
    begin = spark.createDataFrame([(k, *map(float, p)) for k, p in start.items()], "id long, y double, x double")
    got = {r.id: (r.y, r.x) for r in layout.layout(df, begin, rounds=12, epochs=5, block_nodes=block_nodes).collect()}
    assert sorted(got) == ids and all(math.isfinite(v) for p in got.values() for v in p)
    x = np.array([vectors[i] for i in ids])
    ours, theirs = (layout.trustworthiness(x, np.array([p[i] for i in ids])) for p in (got, want))
    assert ours >= 0.98 * theirs


def test_planted_groups_are_parted(spark):
    """Groups that overlap in the plane of the start lie apart in the layout, in one block and in several."""
    rng = np.random.default_rng(5)
    kind = np.repeat(np.arange(4), 50)
    x = rng.normal(size=(200, 10)) + 8 * np.eye(10)[kind + 4]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    edges = communities.fuzzy_weights(spatial.knn(df, 10, "id", "v"))
    start = df.selectExpr("id", "v[0] AS y", "v[1] AS x")  # two directions without a difference between the groups
    for block_nodes in (1000, 60):
        got = layout.layout(edges, start, rounds=20, block_nodes=block_nodes).orderBy("id").collect()
        p = np.array([(r.y, r.x) for r in got])
        near = np.argsort(((p[:, None] - p[None]) ** 2).sum(2), axis=1)[:, 1:11]
        assert (kind[near] == kind[:, None]).mean() > 0.95


def test_trustworthiness():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    assert layout.trustworthiness(x, x * 3 + 1, 5) == 1.0
    assert 0.3 < layout.trustworthiness(x, rng.normal(size=(80, 2)), 5) < 0.7


def test_no_nodes(spark):
    none = spark.createDataFrame([], "id long, y double, x double")
    assert layout.layout(spark.createDataFrame([], "src long, dst long, weight double"), none).count() == 0
