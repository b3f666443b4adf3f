import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mosaicq.operators import spatial


def cloud(n, seed, span, step=0.5):
    rng = random.Random(seed)
    return [(i, rng.randrange(-span, span) * step, rng.randrange(-span, span) * step, float(rng.randrange(5))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y double, x double, sum double")


def dist2(a, b):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2


@pytest.mark.parametrize("span", [4, 30])
def test_pairs_against_brute_force(spark, span):
    rows = cloud(150, span, span)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if dist2(a, b) <= 4}
    got = {(r.a, r.b) for r in spatial.radius_pairs(frame(spark, rows), 2).collect()}
    assert got == want


def test_nearest_is_strict_and_ties_take_the_lowest(spark):
    points = frame(spark, [(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0), (3, 50.0, 50.0, 0.0), (4, -0.5, -0.5, 0.0)])
    targets = spark.createDataFrame([(7, 0.0, 3.0), (5, 3.0, 0.0), (9, 10.0, 5.0), (8, -1.0, -1.0)], "cell_id long, y double, x double")
    got = {r.id: (r.cell_id, r.distance) for r in spatial.nearest_within(points, targets, 5).collect()}
    assert got[1] == (8, math.sqrt(2)) and 2 not in got and 3 not in got and got[4][0] == 8
    assert spatial.nearest_within(points, targets, 5, keep=True).count() == 4
    tie = spatial.nearest_within(points.where("id = 1"), targets.where("cell_id in (5, 7)"), 5).first()
    assert tie.cell_id == 5


def greedy(rows, r, group=lambda x: 0):
    kept = []
    for p in sorted(rows, key=lambda p: (-p[3], p[0])):
        if all(group(p) != group(q) or dist2(p, q) > r * r for q in kept):
            kept.append(p)
    return {p[0] for p in kept}


@pytest.mark.parametrize("span", [6, 40])
def test_suppression_is_the_greedy_one(spark, span):
    rows = cloud(120, span + 1, span)
    got = {r.id for r in spatial.suppress_within(frame(spark, rows), 2).collect()}
    assert got == greedy(rows, 2)
    assert {r.id for r in spatial.suppress_within(frame(spark, rows).repartition(7), 2).collect()} == got


def test_suppression_edge_cases(spark):
    assert spatial.suppress_within(frame(spark, []), 2).count() == 0
    assert spatial.suppress_within(frame(spark, [(1, 0.0, 0.0, 1.0)]), 2).count() == 1
    same = [(i, 1.0, 1.0, 2.0) for i in range(20)]
    assert [r.id for r in spatial.suppress_within(frame(spark, same), 2).collect()] == [0]
    grouped = frame(spark, same).withColumn("gene", F.col("id") % 2)
    assert sorted(r.id for r in spatial.suppress_within(grouped, 2, group=["gene"]).collect()) == [0, 1]


def test_tiling_does_not_change_points(spark):
    points = [(i, (i * 37) % 400, (i * 91) % 300) for i in range(500)]
    for volume in (10_000, 40_000, 10**6):
        tiles = spatial.tile_table(spark, 400, 300, volume, 40)
        df = spark.createDataFrame(points, "id long, y int, x int")
        inside = df.crossJoin(tiles).where("y between pad_y and pad_y + cut_y and x between pad_x and pad_x + cut_x").select("id", "tile_y", "tile_x", "y", "x")
        got = spatial.owned_by_tile(inside, tiles, trim=10).select("id").distinct().count()
        covered = {r.id for r in inside.collect()}
        assert got == len(covered)


def test_crops(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 5, 50), (3, 50, 50)], "id int, y int, x int")
    assert [r.id for r in df.where(spatial.in_box(F.col("y"), F.col("x"), 0, 0, 10, 10)).collect()] == [1]
    assert [r.id for r in df.where(spatial.off_both_axes(F.col("y"), F.col("x"), 0, 0, 10, 10)).collect()] == [3]
    assert [r.id for r in df.where(spatial.in_bounds({"y": 10, "x": 60})).collect()] == [1, 2]


def test_discard_keeps_other_labels(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.7, 0.7), (3, 2, 0.7, 0.7)], "id int, label int, cd_1 double, cd_2 double")
    mask = spark.createDataFrame([(1, int(0.8 * 100 / 1.4), 50)], "label int, row int, col int")
    got = spatial.mask_relabelled(points, mask, "discard", F.lit(True), 100, 100)
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_last_region_wins_and_shifts(spark):
    points = spark.createDataFrame([(1, 150, 250)], "id int, y int, x int")
    mask = spark.createDataFrame([("a", 1, 9, 2), ("b", 2, 9, 2)], "roi string, order int, row int, col int")
    assert spatial.roi_of_points(points, mask, 10).first().roi == "b"
    moved = spark.createDataFrame([(1, 1, 10, 10), (3, 1, 10, 10), (5, 2, 10, 10)], "cycle int, tile int, y int, x int")
    offsets = spark.createDataFrame([(1, 1, 9, 9), (3, 1, -3, 12)], "cycle int, tile int, dy int, dx int")
    assert {(r.cycle, r.y, r.x) for r in spatial.shifted_by_cycle(moved, offsets).collect()} == {(1, 10, 10), (3, 7, 22), (5, 10, 10)}


def test_neighbours_of_blocks_with_ties(spark):
    rng = random.Random(3)
    rows = [(f"i{i:03d}", [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)] + [("none", None), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    want = set()
    for i, p in rows[:300]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, q in rows[:300] if j != i)[:5]
        want |= {(i, j, d, n + 1) for n, (d, j) in enumerate(near)}
    for size in (64, 4096):
        assert {tuple(r) for r in spatial.knn(df, 5, block_rows=size).collect()} == want
    assert spatial.knn(df.limit(0), 5).count() == 0 and spatial.knn(df.where("id = 'i001'"), 5).count() == 0


def test_enrichment_of_separate_clusters(spark):
    labels = spark.createDataFrame([(i, i // 30) for i in range(60)], "id long, label int")
    edges = spark.createDataFrame([(i, 30 * (i // 30) + (i + d) % 30) for i in range(60) for d in (1, 2)], "src long, dst long")
    got = {(r.src_label, r.dst_label): r for r in spatial.enrichment(edges, labels, permutations=60).collect()}
    assert set(got) == {(0, 0), (1, 1)} and all(r.n_edges == 60 and r.z > 3 and 25 < r.expected < 33 for r in got.values())


def test_a_line_of_rising_priority_takes_few_rounds(spark, monkeypatch):
    """10^4 points, each beaten by the next: every second stays, decided in as many rounds as blocks are crossed."""
    df = spark.range(10_000).select("id", F.lit(0.0).alias("y"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("sum"))
    written = []
    plain = spatial.materialise
    monkeypatch.setattr(spatial, "materialise", lambda df, label: (written.append(label), plain(df, label))[1])
    got = sorted(r.id for r in spatial.suppress_within(df, 1.5).collect())
    assert got == list(range(1, 10_000, 2)) and written.count("suppress-decided") <= 3
    written.clear()
    monkeypatch.setattr(spatial, "_BLOCK_POINTS", 1000)
    monkeypatch.setattr(spatial, "_MOST_POINTS", 700)
    few = df.where("id < 600")
    assert sorted(r.id for r in spatial.suppress_within(few, 1.5).collect()) == list(range(1, 600, 2))
