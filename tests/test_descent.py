"""Neighbours by descent against exact ones: recall, distances, ranks."""

import numpy as np
import pytest

from mosaicq.operators import descent, spatial


def recall(got, want):
    return sum(len(want[i] & got.get(i, set())) for i in want) / sum(map(len, want.values()))


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.src, set()).add(r.dst)
    return out


def test_recall_on_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert recall(lists(descent.knn_descended(e, 10, "vec_id", "embedding")), lists(spatial.knn(e, 10, "vec_id", "embedding"))) >= 0.9


@pytest.mark.parametrize("dims", [3, 16])
def test_distances_and_recall(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(900, dims)) + 4 * rng.normal(size=(9, dims))[rng.integers(0, 9, 900)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "id long, v array<double>").repartition(4)
    rows = descent.knn_descended(df, 8).collect()
    got, ranks = {}, {}
    for r in rows:
        assert r.src != r.dst and abs(r.d2 - ((x[r.src] - x[r.dst]) ** 2).sum()) < 1e-9
        got.setdefault(r.src, set()).add(r.dst)
        ranks.setdefault(r.src, []).append((r.rank, r.d2))
    assert set(got) == set(range(900)) and all([k for k, _ in sorted(v)] == list(range(1, 9)) and sorted(v) == sorted(v, key=lambda t: t[1]) for v in ranks.values())
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    assert recall(got, {i: set(np.argsort(d2[i])[:8].tolist()) for i in range(900)}) >= 0.95


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id int, v array<double>")
    assert sorted((r.src, r.dst, r.rank) for r in descent.knn_descended(df, 5).collect()) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 2), (3, 2, 1)]
    assert descent.knn_descended(df.limit(1), 5).count() == 0 == descent.knn_descended(df.limit(0), 5).count()
