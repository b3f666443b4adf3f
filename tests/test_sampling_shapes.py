"""Samples by hashes, exact class borders, code joins, curves of any grid, crops across squares."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicq.operators import decode, images, stats, tables
from mosaicq.plans import catalog, readout  # noqa: F401  (readout registers its queries)


def test_sampled_rows_of_each_type(spark, sf_dir):
    events = {r.event_id: r.event_type for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").collect()}
    got = [tuple(r) for r in catalog.QUERIES["sampled_rows"](spark, sf_dir).collect()]
    sizes = Counter(events.values())
    assert len(set(got)) == len(got) and all(events[i] == t for i, t in got)
    assert Counter(t for _, t in got) == {t: min(20, n) for t, n in sizes.items()}
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    assert sorted(map(tuple, tables.sample_each(df.repartition(7), "event_type", 20, ["event_id"]).collect())) == sorted(got)
    few, other = tables.sample_rows(df, 33, ["event_id"]), tables.sample_rows(df.repartition(5), 33, ["event_id"])
    assert few.count() == 33 and sorted(map(tuple, few.collect())) == sorted(map(tuple, other.collect()))
    assert sorted(map(tuple, tables.sample_rows(df, 33, ["event_id"], seed=4).collect())) != sorted(map(tuple, few.collect()))


def test_train_split_parts_all_rows(spark, sf_dir):
    ids = [r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    got = [tuple(r) for r in catalog.QUERIES["train_split"](spark, sf_dir).select("event_id", "part").collect()]
    assert sorted(i for i, _ in got) == sorted(ids)
    assert 0.07 < sum(p == "held" for _, p in got) / len(got) < 0.13


@pytest.mark.parametrize("fraction", [0.3, 1.0, 2.5])
def test_drawn_with_replacement(spark, fraction):
    df = spark.range(4000)
    got = Counter(r.id for r in tables.bootstrap(df, fraction, ["id"]).collect())
    assert got == Counter(r.id for r in tables.bootstrap(df.repartition(3), fraction, ["id"]).collect())
    counts = np.array([got[i] for i in range(4000)])
    assert abs(counts.mean() - fraction) < 0.1 and abs(counts.var() - fraction) < 0.15 * max(1, fraction) and counts.max() > 1


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_class_borders_are_the_best(spark, classes):
    rng = np.random.default_rng(classes)
    hist = {g: {int(b): int(n) for b, n in zip(rng.choice(40, 14, False) - 10, rng.integers(1, 60, 14))} for g in "ab"}
    df = spark.createDataFrame([(g, b, n) for g, h in hist.items() for b, n in h.items()] + [("few", 1, 5), ("a", 99, 0)], "g string, bin long, n long")
    got = {r.g: tuple(r.thresholds) for r in stats.otsu_thresholds(df, classes, ["g"]).collect()}

    def spread(h, borders):
        edges = [-1000, *borders, 1000]
        mean = sum(b * n for b, n in h.items()) / sum(h.values())
        out = 0.0
        for lo, hi in zip(edges, edges[1:]):
            part = [(b, n) for b, n in h.items() if lo < b <= hi]
            if not part:
                return -1.0
            k = sum(n for _, n in part)
            out += k * (sum(b * n for b, n in part) / k - mean) ** 2
        return out

    assert set(got) == {"a", "b"}
    for g, h in hist.items():
        best = max(spread(h, c) for c in itertools.combinations(sorted(h), classes - 1))
        assert len(got[g]) == classes - 1 and abs(spread(h, got[g]) - best) < 1e-6
    whole = stats.otsu_thresholds(df.where("g = 'a'").select("bin", "n"), classes).first()
    assert tuple(whole.thresholds) == got["a"]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_codes_within_substitutions(spark, most):
    rng = np.random.default_rng(most)
    codes = ["".join(rng.choice(list("ACGT"), 9)) for _ in range(60)] + ["ACG", "ACT", ""]
    near = ["".join(rng.choice(list("ACGT")) if rng.random() < 0.25 else c for c in code) for code in codes]
    left = spark.createDataFrame(list(enumerate(codes)), "i int, a string")
    right = spark.createDataFrame(list(enumerate(near)), "j int, b string")
    want = {(i, j, d) for i, a in enumerate(codes) for j, b in enumerate(near) if len(a) == len(b) and (d := sum(x != y for x, y in zip(a, b))) <= most}
    got = [(r.i, r.j, r.d) for r in decode.within_substitutions(left, right, "a", "b", most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shares_below_any_grid(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 300, 900)]
    grid = [float(g) for g in range(-5, 310)] + [10.5, 10.5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = stats.ecdf(df, "v", spark.createDataFrame([(g,) for g in grid] + [(None,)], "g double")).collect()
    assert len(got) == len(grid) + 1
    for r in got:
        assert r.ecdf is None if r.g is None else abs(r.ecdf - sum(v < r.g for v in values) / 900) < 1e-12
    assert stats.ecdf(df.limit(0), "v", spark.createDataFrame([(1.0,)], "g double")).first().ecdf is None


@pytest.mark.parametrize("side", [7, 16, 1024])
def test_crops_across_squares(spark, side):
    a = np.arange(40 * 33).reshape(40, 33).astype("<u2")
    df = spark.createDataFrame([(1, 40, 33, a.tobytes())], "tile int, height int, width int, pixels binary")
    centres = [(1, y, x) for y in (0, 6, 7, 13, 39, 41, -2) for x in (0, 6, 15, 32, 36)] + [(2, 1, 1)]
    got = {(r.y, r.x): np.frombuffer(r.pixels, "<u2").reshape(r.height, r.width) for r in images.crops(df, spark.createDataFrame(centres, "tile int, y int, x int"), 3, ["tile"], side).collect()}
    wide = np.pad(a, 9)
    assert len(got) == 35
    for (y, x), crop in got.items():
        assert (crop == wide[y + 6 : y + 13, x + 6 : x + 13]).all()
